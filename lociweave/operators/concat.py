"""Concatenating loci into a supermatrix, in long form: one fragment per taxon and locus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.running import running_before

POLICIES = ("pad-gaps", "skip-gene")
#: Taxa beyond this are refused: their list goes to all executors, and a locus may lack nearly all of them.
MOST_TAXA = 1 << 18


def taxa(records: DataFrame) -> DataFrame:
    """(taxon, first): all taxa and where they appear first, by locus and then record."""
    return records.groupBy(F.col("seq_id").alias("taxon")).agg(F.min(F.struct("locus", "record_order")).alias("first"))


def inclusion(records: DataFrame, policy: str = "pad-gaps") -> DataFrame:
    """(locus, length, status, missing): status is included, padded or skipped; missing, the taxa that the locus lacks, in order of appearance.

    A locus lacks what any other has, be that one skipped or not.  Loci without columns are skipped.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    # one row; a few more than MOST_TAXA are enough to tell that there are too many
    some = taxa(records).limit(MOST_TAXA + 1)
    every = some.agg(F.sort_array(F.collect_list(F.struct("first", "taxon")))["taxon"].alias("every"))
    every = every.select(F.when(F.size("every") <= MOST_TAXA, F.col("every")).otherwise(F.raise_error(F.lit(f"more than {MOST_TAXA} taxa"))).alias("every"))
    loci = records.groupBy("locus").agg(F.max(F.length("seq")).cast("long").alias("length"), F.collect_set("seq_id").alias("has"))
    with_all = loci.join(F.broadcast(every), F.lit(True))
    missing = F.array_except("every", "has")
    status = F.when(F.col("length") == 0, "skipped").when(F.size("missing") == 0, "included").otherwise("padded" if policy == "pad-gaps" else "skipped")
    return with_all.select("locus", "length", missing.alias("missing")).withColumn("status", status)


def partitions(records: DataFrame, policy: str = "pad-gaps") -> DataFrame:
    """(locus, start, end, length, missing) of the loci that stay: 1-based inclusive columns of the supermatrix."""
    stays = inclusion(records, policy).where("status != 'skipped'").drop("status")
    placed = running_before(stays, "locus", "length", "before")
    return placed.select("locus", (F.col("before") + 1).alias("start"), (F.col("before") + F.col("length")).alias("end"), "length", "missing")


def missing_blocks(records: DataFrame, policy: str = "pad-gaps") -> DataFrame:
    """(locus, taxon, start, end, length, fill_character): the padding, no rows for what is there."""
    return partitions(records, policy).select("locus", F.explode("missing").alias("taxon"), "start", "end", "length", F.lit("?").alias("fill_character"))


def supermatrix(records: DataFrame, policy: str = "pad-gaps") -> DataFrame:
    """(taxon, locus, start, end, fragment): per taxon the fragments make up its row; those of absent taxa are all ?."""
    parts = partitions(records, policy)
    seen = records.select("locus", F.col("seq_id").alias("taxon"), F.col("seq").alias("fragment")).join(parts.select("locus", "start", "end"), "locus")
    pad = missing_blocks(records, policy).select("locus", "taxon", F.expr("repeat('?', cast(length as int))").alias("fragment"), "start", "end")
    return seen.unionByName(pad).select("taxon", "locus", "start", "end", "fragment")


def duplicate_names(parts: DataFrame, name: Column) -> DataFrame:
    """(name, loci): partitions that would share a name, with their loci in order."""
    named = parts.select("locus", name.alias("name")).groupBy("name").agg(F.array_sort(F.collect_set("locus")).alias("loci"))
    return named.where(F.size("loci") > 1)


def check_names(parts: DataFrame, name: Column) -> None:
    """Raises if two partitions would share a name."""
    found = duplicate_names(parts, name).orderBy("name").first()
    if found:
        raise ValueError(f"duplicate partition name {found['name']}: {', '.join(map(str, found['loci']))}")


def rows(matrix: DataFrame) -> DataFrame:
    """(taxon, seq): whole rows, for sinks of formats that have a row on a line: a taxon's row has to fit in a task."""
    return matrix.groupBy("taxon").agg(F.array_join(F.sort_array(F.collect_list(F.struct("start", "fragment")))["fragment"], "").alias("seq"))


def coverage(records: DataFrame, policy: str = "pad-gaps") -> DataFrame:
    """(taxon, observed_loci, total_loci, artificial_characters) for every taxon."""
    kept = partitions(records, policy)
    total = kept.agg(F.count(F.lit(1)).alias("total_loci"))  # one row
    blocks = kept.select(F.explode("missing").alias("taxon"), "length").groupBy("taxon").agg(F.count(F.lit(1)).alias("blocks"), F.sum("length").alias("characters"))
    joined = taxa(records).join(blocks, "taxon", "left").join(F.broadcast(total), F.lit(True))
    return joined.select("taxon", (F.col("total_loci") - F.coalesce("blocks", F.lit(0))).alias("observed_loci"), "total_loci", F.coalesce("characters", F.lit(0)).alias("artificial_characters"))


def raw_and_trimmed(raw: DataFrame, trimmed: DataFrame) -> DataFrame:
    """One row: loci in both, in one only, and columns of either; both tables have locus and length."""
    joined = raw.select("locus", F.col("length").alias("r")).join(trimmed.select("locus", F.col("length").alias("t")), "locus", "full_outer")
    both = F.col("r").isNotNull() & F.col("t").isNotNull()
    return joined.agg(
        F.count_if(both).alias("common"), F.count_if(F.col("t").isNull()).alias("raw_only"), F.count_if(F.col("r").isNull()).alias("trimmed_only"),
        F.sum(F.when(both, F.col("r"))).alias("raw_columns"), F.sum(F.when(both, F.col("t"))).alias("trimmed_columns"),
    )
