"""Taking sequences or columns out of alignments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions import columns
from lociweave.functions.sequences import characters, codons, occurrences, ratio, safe_id
from lociweave.model import check_ratio, check_seqtype, rebuilt


def apply_mask(units: DataFrame, mask: DataFrame) -> DataFrame:
    """records of the units (locus, record_order, seq_id, pos, raw) whose (locus, pos) the mask has; for masks from elsewhere."""
    return rebuilt(units.join(mask.select("locus", "pos"), ["locus", "pos"], "left_semi"), "pos", "raw")


def apply_flags(records: DataFrame, kept: DataFrame, seqtype: str, keep_empty: bool = False, third: bool = False) -> DataFrame:
    """The records less the columns (triplets for codon) that kept (locus, keep: a 1 for what stays and a 0 for the rest, a string) doesn't keep; with third only the third bases of triplets.

    The flags of a locus meet whole records: no cell is a row.  Loci that keep nothing aren't there, or with keep_empty
    have empty sequences.
    """
    codon = seqtype == "codon"

    def cut(seq: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
        if seq is None or keep is None:
            return np.zeros(0, dtype=np.uint8)
        units = seq[: len(seq) // 3 * 3].reshape(-1, 3) if codon else seq
        left = units[: len(keep)][keep[: len(units)] == 49]
        return (left[:, 2] if third else left).ravel()

    joined = records.join(kept if keep_empty else kept.where(F.contains("keep", F.lit("1"))), "locus", "left" if keep_empty else "inner")
    return columns.mapped(joined.select("locus", "record_order", "seq_id", "seq", "keep"), 2, cut)


def _picked(records: DataFrame, seqtype: str) -> DataFrame:
    """The characters (triplets for codon) at the places in the array at, in its order."""
    units = codons(F.col("seq")) if seqtype == "codon" else characters(F.col("seq"))
    at = F.coalesce("at", F.array().cast("array<int>"))
    # units as a variable of an outer function, so that they are cut once a record and not once a place
    kept = F.transform(F.array(units), lambda u: F.array_join(F.transform(at, lambda p: F.get(u, p - 1)), ""))
    return records.select("locus", "record_order", "seq_id", F.get(kept, F.lit(0)).alias("seq"))


def transfer_columns(records: DataFrame, columns: DataFrame, seqtype: str) -> DataFrame:
    """The columns (triplets for codon) that another program has kept: columns is (locus, pos from 1).

    The places of a locus meet whole records as one array.  See column_map_faults before.
    """
    check_seqtype(seqtype)
    places = columns.groupBy("locus").agg(F.sort_array(F.collect_set(F.col("pos").cast("int"))).alias("at"))
    return _picked(records.join(places, "locus"), seqtype)


def column_map_faults(columns: DataFrame, records: DataFrame) -> DataFrame:
    """(locus, fault): maps that name no locus, a column twice or one out of range; records are those of the mapped side."""
    length = records.groupBy("locus").agg(F.max(F.length("seq")).alias("length"))
    named = columns.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("different"), F.min("pos").alias("least"), F.max("pos").alias("most"))
    fault = F.when(F.col("length").isNull(), "unknown locus").when(F.col("n").isNull(), "no columns").when(F.col("n") != F.col("different"), "column twice")
    fault = fault.when((F.col("least") < 1) | (F.col("most") > F.col("length")), "out of range")
    return named.join(length, "locus", "full_outer").select("locus", fault.alias("fault")).where("fault is not null")


def _trim_sites(records: DataFrame, seqtype: str, max_gap: float, max_n: float, max_x: float, drop_invariant: bool) -> DataFrame:
    check_seqtype(seqtype)
    check_ratio(max_gap=max_gap, max_n=max_n, max_x=max_x)
    letter, most = ("X", max_x) if seqtype == "prot" else ("N", max_n)

    def mark(units: np.ndarray, orders: np.ndarray) -> columns.Marks:
        n = np.full(units.shape[1], len(units), dtype=np.uint64)
        found = {"n": n, "gap": columns.total(columns.has(units, "-")), "bad": columns.total(columns.has(units, letter))}
        return found | (columns.one_number(units) if drop_invariant else {})

    def finish(m: columns.Marks) -> tuple:
        stays = (m["gap"] / m["n"] <= max_gap) & (m["bad"] / m["n"] <= most)
        return (columns.flags(stays & (m["differs"] > 0) if drop_invariant else stays),)

    fields = {"n": "sum", "gap": "sum", "bad": "sum"} | ({"first": "first", "differs": "differs"} if drop_invariant else {})
    upper = records.select("locus", "record_order", F.upper("seq").alias("seq"))
    return columns.tallied(upper, columns.Tally(fields, mark, seqtype == "codon"), "keep string", finish)


def trim_mask(records: DataFrame, seqtype: str = "codon", max_gap: float = 0.2, max_n: float = 0.2, max_x: float = 0.2, drop_invariant: bool = False) -> DataFrame:
    """(locus, pos) of the columns, triplets for codon, that stay: a share beyond a limit goes, one at the limit stays."""
    return columns.places(_trim_sites(records, seqtype, max_gap, max_n, max_x, drop_invariant))


def trim(records: DataFrame, seqtype: str = "codon", max_gap: float = 0.2, max_n: float = 0.2, max_x: float = 0.2, drop_invariant: bool = False) -> DataFrame:
    """The records less trimmed columns; a locus that loses all of them isn't there (the caller decides if that is an error)."""
    return apply_flags(records, _trim_sites(records, seqtype, max_gap, max_n, max_x, drop_invariant), seqtype)


def paired_sites(codon: DataFrame, protein: DataFrame, max_gap: float = 0.2, max_n: float = 0.2, max_x: float = 0.2) -> DataFrame:
    """(locus, keep) of paired sites, flags as of apply_flags: one mask from gaps of either side, N of the triplet and X of the residue.

    Of a triplet and of a residue only one letter, which says what it has, is joined.
    """
    check_ratio(max_gap=max_gap, max_n=max_n, max_x=max_x)
    key = ["locus", "record_order", "seq_id"]

    def told(letter: str, codon: bool) -> Callable[[np.ndarray], np.ndarray]:
        def run(seq: np.ndarray) -> np.ndarray:
            units = columns.triplets(seq) if codon else seq
            return (97 + columns.has(units, "-") + 2 * columns.has(units, letter)).astype(np.uint8)

        return run

    c = columns.mapped(codon.where("seq is not null").select(*key, F.upper("seq").alias("seq")), 1, told("N", True)).withColumnRenamed("seq", "c")
    p = columns.mapped(protein.where("seq is not null").select(*key, F.upper("seq").alias("seq")), 1, told("X", False)).withColumnRenamed("seq", "p")
    n = F.least(F.length("c"), F.length("p"))
    both = c.join(p, key).select("locus", "record_order", F.concat(F.substring("c", F.lit(1), n), F.substring("p", F.lit(1), n)).alias("seq"))

    def mark(units: np.ndarray, orders: np.ndarray) -> columns.Marks:
        n = units.shape[1] // 2
        c, p = units[:, :n] - 97, units[:, n:] - 97
        return {"n": np.full(n, len(units), dtype=np.uint64), "gap": columns.total((c | p) & 1), "bad": columns.total(c >> 1), "x": columns.total(p >> 1)}

    def finish(m: columns.Marks) -> tuple:
        return (columns.flags((m["gap"] / m["n"] <= max_gap) & (m["bad"] / m["n"] <= max_n) & (m["x"] / m["n"] <= max_x)),)

    return columns.tallied(both, columns.Tally(dict.fromkeys(("n", "gap", "bad", "x"), "sum"), mark), "keep string", finish)


def paired_mask(codon: DataFrame, protein: DataFrame, **limits: float) -> DataFrame:
    """(locus, pos) of the sites that both sides keep."""
    return columns.places(paired_sites(codon, protein, **limits))


def trim_pair(codon: DataFrame, protein: DataFrame, **limits: float) -> tuple[DataFrame, DataFrame]:
    sites = paired_sites(codon, protein, **limits)
    return apply_flags(codon, sites, "codon"), apply_flags(protein, sites, "prot")


def drop_missing_columns(records: DataFrame, seqtype: str = "nucl") -> DataFrame:
    """The records less columns (triplets for codon) in which every record has N or - (X or - for prot); loci of unequal lengths stay as they are."""
    check_seqtype(seqtype)
    empty = {"nucl": ["N", "-"], "prot": ["X", "-"], "codon": ["NNN", "---"]}[seqtype]
    odd = columns.codon_numbers(empty) if seqtype == "codon" else np.array([ord(x) for x in empty])

    def mark(units: np.ndarray, orders: np.ndarray) -> columns.Marks:
        return {"full": (~np.isin(units, odd)).any(axis=0).astype(np.uint64)}

    upper = records.select("locus", "record_order", F.upper("seq").alias("seq"))
    sites = columns.tallied(upper, columns.Tally({"full": "or"}, mark, seqtype == "codon"), "keep string", lambda m: (columns.flags(m["full"] > 0),))
    even = records.groupBy("locus").agg((F.min(F.length("seq")) == F.max(F.length("seq"))).alias("even"))
    trimmed = apply_flags(records.join(even.where("even"), "locus", "left_semi"), sites, seqtype)
    rest = records.join(even.where("not even"), "locus", "left_semi").select("locus", "record_order", "seq_id", "seq")
    return trimmed.unionByName(rest)


def filter_sequences(
    records: DataFrame, seqtype: str = "nucl", min_length: int = 0, max_gap: float = 1.0, max_n: float = 1.0, max_x: float = 1.0, keep: DataFrame | None = None, remove: DataFrame | None = None
) -> DataFrame:
    """Records long enough and within the ratios, of the whole sequence, N by base for codon too; an empty one has ratio 1.

    keep, remove: tables with a column seq_id of records that may stay or must go.
    """
    check_seqtype(seqtype)
    check_ratio(max_gap=max_gap, max_n=max_n, max_x=max_x)
    seq, n = F.upper("seq"), F.length("seq").cast("long")
    share = lambda letter: F.when(n == 0, F.lit(1.0)).otherwise(ratio(occurrences(seq, letter), n))
    stays = (n >= min_length) & (share("-") <= max_gap) & ((share("X") <= max_x) if seqtype == "prot" else (share("N") <= max_n))
    out = records.where(stays)
    if keep is not None:
        out = out.join(keep.select("seq_id"), "seq_id", "left_semi")
    if remove is not None:
        out = out.join(remove.select("seq_id"), "seq_id", "left_anti")
    return out.select("locus", "record_order", "seq_id", "seq")


def rename(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ids made safe and then looked up in mapping (original_id, renamed_id); those it lacks stay.

    One record stays one: of several names for an id the smallest is taken, see mapping_conflicts and rename_faults.
    """
    known = mapping.groupBy(safe_id(F.col("original_id")).alias("__old")).agg(F.min("renamed_id").alias("renamed_id"))
    joined = records.join(known, safe_id(F.col("seq_id")) == F.col("__old"), "left")
    return joined.select("locus", "record_order", F.coalesce("renamed_id", safe_id(F.col("seq_id"))).alias("seq_id"), "seq")


def mapping_conflicts(mapping: DataFrame) -> DataFrame:
    """(original_id, n): ids that a mapping gives more than one name."""
    return mapping.groupBy(safe_id(F.col("original_id")).alias("original_id")).agg(F.countDistinct("renamed_id").alias("n")).where("n > 1")


def rename_faults(renamed: DataFrame) -> DataFrame:
    """(locus, seq_id, fault): ids of rename()'s records that are empty, have white space in them, or stand twice in a locus."""
    n = renamed.groupBy("locus", "seq_id").agg(F.count(F.lit(1)).alias("n"))
    fault = F.when(F.coalesce("seq_id", F.lit("")) == "", "empty id").when(F.col("seq_id").rlike(r"\s"), "white space in id").when(F.col("n") > 1, "duplicate id")
    return n.select("locus", "seq_id", fault.alias("fault")).where("fault is not null")


def filter_faults(before: DataFrame, after: DataFrame, by_taxon: bool = False) -> DataFrame:
    """(locus, fault) of filtered loci that mustn't be written: nothing left, or by_taxon and fewer than two records."""
    left = before.select("locus").distinct().join(after.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("length")), "locus", "left")
    fault = F.when(F.col("n").isNull(), "no sequences remain").when(F.lit(by_taxon) & (F.col("n") < 2), "fewer than two sequences").when(F.col("length") == 0, "no sites remain")
    return left.select("locus", fault.alias("fault")).where("fault is not null")
