"""Per-sequence and per-alignment checks and the gate made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.genetic_code import is_stop
from lociweave.functions.sequences import DNA, PROTEIN, characters, codons, occurrences, ratio
from lociweave.model import check_ratio, check_seqtype
from lociweave.operators.sites import site_profile


@dataclass(frozen=True)
class Gate:
    """Thresholds; a value fails only beyond its limit, equality passes."""

    seqtype: str = "nucl"
    table: int = 1
    min_length: int = 1
    max_n_ratio: float = 1.0
    max_x_ratio: float = 1.0
    max_gap_ratio: float = 1.0
    min_informative: int = 0
    allow_terminal_stop: bool = False
    allow_internal_stop: bool = False

    def __post_init__(self) -> None:
        check_seqtype(self.seqtype)
        check_ratio(max_n_ratio=self.max_n_ratio, max_x_ratio=self.max_x_ratio, max_gap_ratio=self.max_gap_ratio)
        if self.min_length < 0 or self.min_informative < 0:
            raise ValueError("length and site thresholds must not be negative")


def _summary(seqtype: str) -> list[Column]:
    seq, length = F.upper("seq"), F.length("seq")
    if seqtype == "codon":
        triplets = codons(F.translate(seq, "U", "T"))
        bad, all_ = F.sum(F.size(F.filter(triplets, lambda c: F.contains(c, F.lit("N"))))), F.sum(F.size(triplets))
    else:
        bad, all_ = F.sum(occurrences(seq, "X" if seqtype == "prot" else "N")), F.sum(length)
    total = F.sum(length)
    return [
        F.count(F.lit(1)).alias("sequence_count"),
        F.when(F.min(length) == F.max(length), F.max(length)).otherwise(0).cast("long").alias("alignment_length"),
        ratio(F.sum(occurrences(seq, "-")), total).alias("gap_ratio"),
        ratio(F.sum(occurrences(seq, "?")), total).alias("missing_ratio"),
        ratio(bad, all_).alias("x_ratio" if seqtype == "prot" else "n_ratio"),
    ]


def alignment_summary(records: DataFrame, seqtype: str = "nucl") -> DataFrame:
    """Per locus: sequences, common length (0 if lengths differ) and ratios of gaps, missing and ambiguous characters.

    The ambiguous ratio is of N among characters (nucl), of X (prot), or of triplets with an N (codon).
    """
    check_seqtype(seqtype)
    return records.groupBy("locus").agg(*_summary(seqtype))


def _foreign(seqtype: str) -> Column:
    """The characters of a sequence outside the alphabet, sorted."""
    allowed = PROTEIN if seqtype == "prot" else DNA
    return F.array_join(F.array_sort(F.array_distinct(characters(F.translate(F.upper("seq"), allowed, "")))), "")


def sequence_stats(records: DataFrame, seqtype: str = "nucl") -> DataFrame:
    """Per record: length, counts and ratios of -, ?, N and X, and the characters outside the alphabet, sorted."""
    seq, n = F.upper("seq"), F.length("seq").cast("long")
    out = records.select("locus", "record_order", "seq_id", n.alias("length"), *[occurrences(seq, c).alias(f"{k}_count") for k, c in (("gap", "-"), ("missing", "?"), ("n", "N"), ("x", "X"))], _foreign(seqtype).alias("invalid"))
    return out.select("*", *[ratio(F.col(f"{k}_count"), F.col("length")).alias(f"{k}_ratio") for k in ("gap", "missing", "n", "x")])


def duplicate_ids(records: DataFrame) -> DataFrame:
    """(locus, seq_id, n) of ids that a locus has more than once."""
    return records.groupBy("locus", "seq_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _joined(pairs: Column) -> Column:
    """Ordered (at, what) structs as at-what;at-what, null if there are none."""
    text = F.array_join(F.transform(pairs, lambda x: F.concat_ws("-", x["at"], x["what"])), ";")
    return F.when(F.size(pairs) > 0, text)


def _with_stops(records: DataFrame, seqtype: str, table: int) -> DataFrame:
    """records with stops, the (at, what) of all stops in order, and last, the place of the last occupied unit; within the row.

    Codon records whose length isn't divisible by three have none.
    """
    if seqtype == "codon":
        units, empty, stop = codons(F.translate(F.upper("seq"), "U", "T")), ("---", "???"), lambda c: is_stop(c, table)
        units = F.when(F.length("seq") % 3 == 0, units).otherwise(F.array().cast("array<string>"))
    else:
        units, empty, stop = characters(F.upper("seq")), ("-", "?"), lambda c: c == "*"
    with_units = records.withColumn("__units", units)
    found = F.array_compact(F.transform("__units", lambda c, i: F.when(stop(c), F.struct((i + 1).alias("at"), c.alias("what")))))
    last = F.array_max(F.transform("__units", lambda c, i: F.when(~c.isin(*empty), i + 1)))
    return with_units.withColumns({"stops": found, "last": last}).drop("__units")


def stop_findings(records: DataFrame, seqtype: str = "codon", table: int = 1) -> DataFrame:
    """(locus, record_order, seq_id, terminal_stop, internal_stops) of the records with a stop, positions from 1.

    The last triplet but --- and ??? (the last residue but - and ?) is the terminal one.  Codon records whose length
    isn't divisible by three aren't looked at.  Dual-coding codons are not stops.  Nothing shuffles.
    """
    found = _with_stops(records, seqtype, table).where(F.size("stops") > 0)
    terminal = F.filter("stops", lambda x: x["at"] == F.col("last"))
    inner = F.filter("stops", lambda x: x["at"] != F.col("last"))
    return found.select("locus", "record_order", "seq_id", F.get(terminal, F.lit(0))["what"].alias("terminal_stop"), _joined(inner).alias("internal_stops"))


def reasons(records: DataFrame, gate: Gate = Gate(), audited_internal: DataFrame | None = None) -> DataFrame:
    """Per locus: the summary, site classes and reasons, a sorted array of why the locus fails.

    audited_internal: a column locus, of loci where preprocessing has masked internal stops.
    """
    seqtype = gate.seqtype
    check_seqtype(seqtype)
    whole = F.size(F.filter(codons(F.upper("seq")), lambda c: F.contains(c, F.lit("-")) & (c != "---"))) == 0
    found = {
        "invalid": F.bool_or(F.length(F.translate(F.upper("seq"), PROTEIN if seqtype == "prot" else DNA, "")) > 0),
        "empty": F.bool_or(F.length("seq") == 0),
        "mismatch": F.min(F.length("seq")) != F.max(F.length("seq")),
        "twice": F.count(F.lit(1)) > F.count_distinct(F.struct("seq_id")),
    }
    if seqtype == "codon":
        found["frame_error"] = F.bool_or(~((F.length("seq") % 3 == 0) & whole))
    if seqtype != "nucl":
        stops = _with_stops(records, seqtype, gate.table)
        found["ends"] = F.bool_or(F.exists("stops", lambda x: x["at"] == F.col("last")))
        found["within"] = F.bool_or(F.exists("stops", lambda x: x["at"] != F.col("last")))
    summary = _summary(seqtype)
    # one pass over records and one over cells, both dealt by locus in the end
    joined = (stops if seqtype != "nucl" else records).groupBy("locus").agg(*summary, *[c.alias(n) for n, c in found.items()])
    joined = joined.join(site_profile(records, seqtype), "locus", "left")
    aligned = F.col("alignment_length") > 0
    tests = {
        "duplicate_ids": F.col("twice"),
        "invalid_characters": F.col("invalid"),
        "empty_sequence": F.col("empty"),
        "length_mismatch": F.col("mismatch"),
        "all_gap_columns": aligned & (F.col("full_gap_columns") > 0),
        "gap_ratio": F.col("gap_ratio") > gate.max_gap_ratio,
        "short_alignment": F.floor(F.col("alignment_length") / (3 if seqtype == "codon" else 1)) < gate.min_length,
        "parsimony_informative_sites": F.when(aligned, F.col("parsimony_informative_sites")).otherwise(0) < gate.min_informative,
    }
    if seqtype == "prot":
        tests["X_ratio"] = F.col("x_ratio") > gate.max_x_ratio
    else:
        tests["N_ratio"] = F.col("n_ratio") > gate.max_n_ratio
    if seqtype != "nucl":
        within = F.col("within")
        if audited_internal is not None:
            joined = joined.join(audited_internal.select("locus", F.lit(True).alias("audited")).distinct(), "locus", "left")
            within = within | F.coalesce("audited", F.lit(False))
        if not gate.allow_terminal_stop:
            tests["terminal_stop"] = F.col("ends")
        if not gate.allow_internal_stop:
            tests["internal_stop"] = within
    if seqtype == "codon":
        tests["frame_error"] = F.col("frame_error")
    failed = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items()])))
    zero = ["constant_sites", "variable_sites", "parsimony_informative_sites", "singleton_sites"]
    return joined.select("locus", "sequence_count", "alignment_length", "gap_ratio", "missing_ratio", "x_ratio" if seqtype == "prot" else "n_ratio", *[F.when(aligned, F.col(c)).otherwise(0).alias(c) for c in zero], failed.alias("reasons"))


def qc_gate(records: DataFrame, gate: Gate = Gate(), audited_internal: DataFrame | None = None) -> DataFrame:
    """reasons() with passed, and the reasons joined by ;."""
    found = reasons(records, gate, audited_internal)
    return found.withColumns({"passed": F.size("reasons") == 0, "reasons": F.array_join("reasons", ";")})


def paired_decision(codon: DataFrame, protein: DataFrame, policy: str = "both", min_codon: int = 0, min_protein: int = 0) -> DataFrame:
    """Per locus of either side: whether the pair passes.

    codon, protein: locus, passed (without regard to informative sites) and parsimony_informative_sites.
    """
    if policy not in ("both", "either", "codon", "protein"):
        raise ValueError("policy must be both, either, codon or protein")
    pick = lambda df, name: df.select("locus", F.col("passed").alias(f"{name}_passed"), F.col("parsimony_informative_sites").alias(f"{name}_pis"))
    joined = pick(codon, "codon").join(pick(protein, "protein"), "locus", "full_outer")
    c, p = F.coalesce("codon_pis", F.lit(-1)) >= min_codon, F.coalesce("protein_pis", F.lit(-1)) >= min_protein
    enough = {"both": c & p, "either": c | p, "codon": c, "protein": p}[policy]
    both = F.coalesce("codon_passed", F.lit(False)) & F.coalesce("protein_passed", F.lit(False))
    return joined.withColumn("paired_passed", both & enough)
