"""Roll-ups of edits and of quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.sequences import locus_key


def span_length(positions: Column) -> Column:
    """Characters of "a" or "a-b", null unless 0 < a <= b."""
    start = F.regexp_extract(positions, r"^(\d+)(?:-\d+)?$", 1).try_cast("long")
    end = F.coalesce(F.regexp_extract(positions, r"^\d+-(\d+)$", 1).try_cast("long"), start)
    return F.when((start > 0) & (end >= start), end - start + 1)


def distinct_events(events: DataFrame) -> DataFrame:
    """Edits that agree in all columns count once."""
    return events.dropDuplicates()


def with_taxon(events: DataFrame) -> DataFrame:
    """events with taxon: the mapped id, else the id, else Unassigned; nt, aa and unknown: characters that an edit touches."""
    named = [F.when(F.col(c) != "NA", F.col(c)) for c in ("mapped_taxa_id", "taxa_id") if c in events.columns]
    nt, aa = (span_length(F.col(c)) if c in events.columns else F.lit(None).cast("long") for c in ("source_nt_positions", "source_aa_positions"))
    out = events.withColumns({"taxon": F.coalesce(*named, F.lit("Unassigned")), "nt": nt, "aa": aa})
    return out.withColumn("unknown", (F.col("nt").isNull() & F.col("aa").isNull()).cast("int"))


def audit_by_taxon(events: DataFrame) -> DataFrame:
    e = with_taxon(distinct_events(events))
    sequence = F.when(F.col("taxon") != "Unassigned", F.struct("input_file", "taxa_id"))
    return e.groupBy("taxon").agg(F.count(F.lit(1)).alias("events"), F.countDistinct(sequence).alias("affected_sequences"), F.sum("nt").alias("nt_characters"), F.sum("aa").alias("aa_characters"), F.sum("unknown").alias("events_without_coordinates"))


def audit_by_type(events: DataFrame) -> DataFrame:
    return distinct_events(events).groupBy("event", "action").agg(F.count(F.lit(1)).alias("n"))


def audit_cross(events: DataFrame) -> DataFrame:
    return with_taxon(distinct_events(events)).groupBy("taxon", "event").agg(F.count(F.lit(1)).alias("n"))


def duplicates_ignored(events: DataFrame) -> DataFrame:
    """One row: edits, different ones, and how many repeat another."""
    n = events.groupBy(*events.columns).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("events"), F.sum(F.col("n") - 1).alias("duplicates"))


def merge_events(*tables: DataFrame) -> DataFrame:
    """All edits; columns that some tables lack are NA there."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in first.columns])


def annotate(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """events with mapped_taxa_id from mapping (original_id, renamed_id), NA where it has none."""
    known = mapping.groupBy(F.col("original_id").alias("taxa_id")).agg(F.min("renamed_id").alias("mapped_taxa_id"))  # an event stays one
    return events.join(known, "taxa_id", "left").withColumn("mapped_taxa_id", F.coalesce("mapped_taxa_id", F.lit("NA")))


def relocate(events: DataFrame, source: str, destination: str) -> DataFrame:
    """events whose input_file lies in the folder source, with the folder destination instead."""
    name, folder = F.regexp_extract("input_file", r"([^/]*)$", 1), F.regexp_replace("input_file", r"/[^/]*$", "")
    moved = F.concat_ws("/", F.lit(destination.rstrip("/")), name)
    return events.withColumn("input_file", F.when(folder == source.rstrip("/"), moved).otherwise(F.col("input_file")))


def active_branches(branches: DataFrame, seqtype: str | None = None, notrim: bool = False) -> DataFrame:
    """The rows of branches (branch, a path of folders) that belong to the current kind of run."""
    if seqtype not in ("nucl", "prot", "codon", "pseudogene"):
        return branches
    parts = F.filter(F.split("branch", "/"), lambda x: x != "")
    kinds = F.array_intersect(parts, F.array(*map(F.lit, ("nucl", "prot", "codon"))))
    stays = F.array_contains(parts, "pseudogene") == F.lit(seqtype == "pseudogene")
    if notrim:
        stays = stays & (F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")) != "trimmed")
    if seqtype in ("codon", "pseudogene"):
        return branches.where(stays & (F.size(F.array_except(kinds, F.array(F.lit("codon"), F.lit("prot")))) == 0))
    return branches.where(stays & ~F.array_contains(parts, "paired") & ((F.size(kinds) == 0) | F.array_contains(kinds, seqtype)))


def branch_status(details: DataFrame, passed: DataFrame, failed: DataFrame, retained: DataFrame | None = None, thresholds: dict[str, int] | None = None) -> DataFrame:
    """(branch, locus, status, reasons): pass, fail or not_evaluated of every row of details, once a locus.

    details: branch, locus, seqtype, reasons (joined by ;) and parsimony_informative_sites; passed, failed, retained:
    branch, locus.  With retained that list alone decides, and a locus below its seqtype's threshold gets a reason more.
    """
    once = details.dropDuplicates(["branch", "locus"])
    named = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce("reasons", F.lit("")), ";"), lambda x: ~x.isin("", "NA"))))
    if retained is not None:
        once = once.join(retained.select("branch", "locus", F.lit(True).alias("__kept")).distinct(), ["branch", "locus"], "left")
        status = F.when(F.col("__kept"), "pass").otherwise("fail")
        least = F.coalesce(*[F.when(F.col("seqtype") == k, F.lit(v)) for k, v in (thresholds or {}).items()], F.lit(None).cast("int"))
        low = F.coalesce(F.col("parsimony_informative_sites") < least, F.lit(False))
        named = F.when(low, F.array_sort(F.array_union(named, F.array(F.lit("below_independent_PIS_threshold"))))).otherwise(named)
    else:
        lists = passed.select("branch", "locus", F.lit("pass").alias("__status")).unionByName(failed.select("branch", "locus", F.lit("fail").alias("__status")))
        once = once.join(lists.groupBy("branch", "locus").agg(F.max("__status").alias("__status")), ["branch", "locus"], "left")
        status = F.coalesce("__status", F.lit("not_evaluated"))
    found = once.select("branch", "locus", status.alias("status"), named.alias("__reasons"))
    reasons = F.when(F.col("status") == "fail", F.when(F.size("__reasons") == 0, F.array(F.lit("failure_reason_not_recorded"))).otherwise(F.col("__reasons")))
    return found.select("branch", "locus", "status", F.coalesce(reasons, F.array().cast("array<string>")).alias("reasons"))


def branch_rollup(status: DataFrame) -> DataFrame:
    """(branch, kind, name, n) of branch_status: loci by status, failed ones by reason (overlapping), combination and number of reasons."""
    failed = status.where("status = 'fail'")
    rows = status.select("branch", F.lit("status").alias("kind"), F.col("status").alias("name"))
    for kind, name in (("reason", F.explode("reasons")), ("combination", F.array_join("reasons", " + ")), ("multiplicity", F.size("reasons").cast("string"))):
        rows = rows.union(failed.select("branch", F.lit(kind), name))
    return rows.groupBy("branch", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


def overview(inputs: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row: listed input loci and different loci among the paths of alignment lists; both tables have a column path."""
    total = inputs.agg(F.count(F.lit(1)).alias("input_loci"))
    return total.join(aligned.agg(F.count_distinct(locus_key(F.col("path"))).alias("aligned_loci")), F.lit(True))  # one row each


def internal_stop_hint(gate: DataFrame) -> DataFrame:
    """One row: loci whose reasons (joined by ;) have internal_stop, and all loci."""
    return gate.agg(F.count_if(F.array_contains(F.split("reasons", ";"), "internal_stop")).alias("stopped"), F.count(F.lit(1)).alias("loci"))


def reason_rollup(gate: DataFrame) -> DataFrame:
    """(kind, name, n) from qc_gate rows: loci passed and failed, loci by reason (overlapping), by combination and by number of reasons."""
    reasons = F.array_distinct(F.split("reasons", ";"))
    failed = gate.where("not passed").withColumn("list", F.array_sort(reasons))
    kinds = [
        gate.select(F.lit("status").alias("kind"), F.when(F.col("passed"), "passed").otherwise("failed").alias("name")),
        failed.select(F.lit("reason"), F.explode("list")),
        failed.select(F.lit("combination"), F.array_join("list", " + ")),
        failed.select(F.lit("multiplicity"), F.size("list").cast("string")),
    ]
    every = kinds[0]
    for k in kinds[1:]:
        every = every.union(k)
    return every.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def provenance(events: DataFrame, seqtype: str = "codon") -> DataFrame:
    """(locus, seq_id, category, note): stops that preprocessing took out, as position-original joined by ; in order."""
    stops = events.where(F.col("event").isin("terminal_stop", "internal_stop", "protein_terminal_stop", "protein_internal_stop"))
    category = F.when(F.contains("event", F.lit("terminal")), "terminal").otherwise("internal")
    note = F.struct(F.col("start").alias("at"), F.concat_ws("-", "start", "original").alias("note"))
    return stops.groupBy("locus", "seq_id", category.alias("category")).agg(F.array_join(F.sort_array(F.collect_list(note))["note"], ";").alias("note"))
