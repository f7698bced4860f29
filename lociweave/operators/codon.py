"""Translation and what follows from the genetic code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions import columns
from lociweave.functions.genetic_code import code, fourfold_codons, residue_table
from lociweave.functions.sequences import characters, codons
from lociweave.operators.trim import apply_flags

KEY = ("locus", "record_order", "seq_id")


def translate_cds(records: DataFrame, table: int = 1) -> DataFrame:
    """Whole triplets to residues, within the row; a start codon at the beginning is M.  Records without a triplet aren't there."""
    letters, residues = residue_table(table)
    starts, digits = columns.codon_numbers(sorted(code(table)[2])), np.zeros(256, dtype=np.uint16)
    digits[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    residues = np.frombuffer(residues.encode(), dtype=np.uint8)

    def translated(seq: np.ndarray) -> np.ndarray:
        units = seq[: len(seq) // 3 * 3].reshape(-1, 3)
        a, b, c = columns.lookup(digits, units).T
        out = residues[(a * 7 + b) * 7 + c]
        if columns.triplets(units[0])[0] in starts:
            out[0] = ord("M")
        return out

    return columns.mapped(records.where(F.length("seq") > 2).select(*KEY, F.upper("seq").alias("seq")), 1, lambda seq: translated(columns.replaced(seq, "U", "T")))


def back_translate(protein: DataFrame, cds: DataFrame) -> DataFrame:
    """Aligned residues replaced by the triplets of the sequence they come from: the k-th residue by the k-th triplet, - by ---.

    Joined by locus and seq_id; records of one side only, or with a different number of residues and triplets,
    are left out and reported by back_translation_faults.
    """
    p = protein.select(*KEY, F.col("seq").alias("aligned"))
    c = cds.select("locus", "seq_id", F.col("seq").alias("cds"))
    both = p.join(c, ["locus", "seq_id"]).where(F.length(F.replace("aligned", F.lit("-"), F.lit(""))) == F.floor(F.length("cds") / 3))

    def filled(aligned: np.ndarray, cds: np.ndarray) -> np.ndarray:
        out = np.full((len(aligned), 3), ord("-"), dtype=cds.dtype)
        out[aligned != ord("-")] = cds[: len(cds) // 3 * 3].reshape(-1, 3)
        return out.ravel()

    return columns.mapped(both.select(*KEY, "aligned", "cds"), 2, filled)


def back_translation_faults(protein: DataFrame, cds: DataFrame) -> DataFrame:
    """(locus, seq_id, fault): missing from either side, or residues and triplets that differ in number."""
    p = protein.select("locus", "seq_id", F.length(F.replace("seq", F.lit("-"), F.lit(""))).alias("residues"))
    c = cds.select("locus", "seq_id", F.size(codons(F.col("seq"))).alias("triplets"))
    fault = F.when(F.col("residues").isNull(), "missing from protein alignment").when(F.col("triplets").isNull(), "missing from CDS").when(F.col("residues") != F.col("triplets"), "residue count")
    return p.join(c, ["locus", "seq_id"], "full_outer").select("locus", "seq_id", fault.alias("fault")).where("fault is not null")


def split_codon_positions(records: DataFrame) -> DataFrame:
    """(locus, record_order, seq_id, codon_position, seq): the first, second and third bases apart."""
    out = records.select(*KEY, F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("codon_position"), characters(F.col("seq")).alias("chars"))
    picked = F.filter("chars", lambda c, i: i % 3 == F.col("codon_position") - 1)
    return out.select(*KEY, "codon_position", F.array_join(picked, "").alias("seq"))


def _fourfold_sites(records: DataFrame, table: int, policy: str) -> DataFrame:
    if policy not in ("ignore-missing", "require-all"):
        raise ValueError("policy must be ignore-missing or require-all")
    fourfold, missing = columns.codon_numbers(fourfold_codons(table)), columns.codon_numbers(["???"])[0]

    def mark(units: np.ndarray, orders: np.ndarray) -> columns.Marks:
        counts = units != missing if policy == "ignore-missing" else np.ones(units.shape, dtype=bool)
        bad = counts & ~np.isin(units, fourfold)
        return {"bad": bad.any(axis=0).astype(np.uint64), "seen": columns.total(counts), **columns.one_number(np.where(counts, units >> np.uint64(21), 0).astype(np.uint64))}

    def finish(m: columns.Marks) -> tuple:
        return (columns.flags((m["bad"] == 0) & (m["differs"] == 0) & (m["seen"] >= (2 if policy == "ignore-missing" else 1))),)

    upper = records.select("locus", "record_order", F.translate(F.upper("seq"), "U", "T").alias("seq"))
    return columns.tallied(upper, columns.Tally({"bad": "or", "seen": "sum", "first": "first", "differs": "differs"}, mark, True), "keep string", finish)


def fourfold_mask(records: DataFrame, table: int = 1, policy: str = "ignore-missing") -> DataFrame:
    """(locus, pos) of triplet columns whose third bases are fourfold degenerate in all records, the first two bases alike.

    ignore-missing: ??? doesn't count, two other records at least; require-all: every record.
    """
    return columns.places(_fourfold_sites(records, table, policy))


def fourfold_sites(records: DataFrame, table: int = 1, policy: str = "ignore-missing") -> DataFrame:
    """The third bases of fourfold columns; records of loci without any are empty."""
    upper = records.withColumn("seq", F.translate(F.upper("seq"), "U", "T"))
    return apply_flags(upper, _fourfold_sites(records, table, policy), "codon", keep_empty=True, third=True)


def pairwise_4dtv(records: DataFrame, table: int = 1) -> DataFrame:
    """(locus, sequence1, sequence2, corrected_4dtv, raw_4dtv, sites, transversions) of loci with two records.

    sites: fourfold ones; transversions: among them; corrected is null where the correction has no value.  Loci that
    pair_faults() names aren't there.
    """
    records = records.join(pair_faults(records).select("locus"), "locus", "left_anti")
    folded = F.translate(F.upper("seq"), "U", "T")
    side = lambda k, name: records.where(F.col("record_order") == k).select("locus", folded.alias(name))
    fourfold, purine = columns.codon_numbers(fourfold_codons(table)), [ord("A"), ord("G")]

    def look(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        x, y = columns.triplets(x), columns.triplets(y)
        both = np.isin(x, fourfold) & np.isin(y, fourfold) & (x >> np.uint64(21) == y >> np.uint64(21))
        x, y = columns.base(x[both], 2), columns.base(y[both], 2)
        found = [len(x), (np.isin(x, purine) != np.isin(y, purine)).sum(), *[(x == ord(b)).sum() + (y == ord(b)).sum() for b in "ACGT"]]
        return tuple(np.array([n] if len(x) else [], dtype=np.int64) for n in found)

    pairs = columns.found(side(0, "x").join(side(1, "y"), "locus"), 2, look, dict.fromkeys(("sites", "transversions", *"ACGT"), "int"), ("locus",)).na.fill(0)
    sums = pairs.select("locus", *[F.col(c).cast("long").alias(c) for c in ("sites", "transversions")], *[(0.5 * F.col(b) / F.col("sites")).alias(b) for b in "ACGT"])
    sums = sums.withColumns({"raw": F.col("transversions") / F.col("sites"), "Y": F.col("T") + F.col("C"), "R": F.col("A") + F.col("G")})
    sums = sums.withColumns({"tc": F.expr("T*C"), "ag": F.expr("A*G")}).withColumns({"w": F.expr("case when Y > 0 and R > 0 then tc*R/Y + ag*Y/R end")})
    sums = sums.withColumns({"first": F.expr("case when A > 0 and C > 0 and G > 0 and T > 0 then 1 - raw*w/(2*(tc*R + ag*Y)) end"), "second": F.expr("case when Y > 0 and R > 0 then 1 - raw/(2*Y*R) end")})
    corrected = F.expr("case when first > 0 and second > 0 then -2*ln(first)*(tc/Y + ag/R) + 2*ln(second)*(w - Y*R) end")
    of = lambda k: F.min(F.when(F.col("record_order") == k, F.col("seq_id"))).alias(f"sequence{k + 1}")
    every = records.groupBy("locus").agg(of(0), of(1)).join(sums, "locus", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select("locus", "sequence1", "sequence2", (F.round(corrected, 9) + 0.0).alias("corrected_4dtv"), F.col("raw").alias("raw_4dtv"), count("sites"), count("transversions"))


def pair_faults(records: DataFrame) -> DataFrame:
    """(locus, fault): loci that don't have exactly two records, with different ids and one length, of whole triplets."""
    length = F.length("seq")
    found = records.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.min("seq_id").alias("a"), F.max("seq_id").alias("b"), F.min(length).alias("least"), F.max(length).alias("most"))
    fault = F.when(F.col("n") != 2, "not two sequences").when(F.col("a").eqNullSafe(F.col("b")), "equal ids").when(F.col("least") == 0, "empty sequence")
    fault = fault.when(F.col("least") != F.col("most"), "lengths differ").when(F.col("most") % 3 != 0, "not whole triplets")
    return found.select("locus", fault.alias("fault")).where("fault is not null")
