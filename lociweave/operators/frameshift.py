"""Alignments with frameshifts: what is wrong with their triplets, what becomes of them, and what was changed.

A ! stands for a base that the reading frame misses.  Records are aligned triplets; what is left over at the end of
a sequence of another length is not looked at.  All but the comparison of two tables works within a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions import columns
from lociweave.functions.genetic_code import stop_codons
from lociweave.functions.sequences import AMBIGUOUS_BASES, PROTEIN_STATES_REPORT, characters, codons

KEY = ("locus", "record_order", "seq_id")


_EVENTS = ("external_frameshift", "internal_frameshift", "terminal_stop", "internal_stop", "export_change")


def _kinds(seq: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """The triplets of upper-case letters and what is found in each: a place in _EVENTS, -1 for nothing.

    Outer triplets are the first and the last that aren't ---.
    """
    t = columns.triplets(seq)
    bare = columns.triplets(columns.replaced(seq, "U", "T")) if (seq == ord("U")).any() else t
    occupied = np.flatnonzero(t != columns.codon_numbers(["---"])[0])
    first, last = (occupied[0], occupied[-1]) if len(occupied) else (-1, -1)
    kind = np.where(np.isin(bare, columns.codon_numbers(stop_codons(table))), 3, -1).astype(np.int8)
    if last >= 0:
        kind[last] = 2 if bare[last] in columns.codon_numbers(stop_codons(table, True)) else -1
    shift = (seq[: len(t) * 3] == ord("!")).reshape(-1, 3).any(axis=1)
    kind[shift] = 1
    for k in (first, last):
        if k >= 0 and shift[k]:
            kind[k] = 0
    return t, kind


def _upper(records: DataFrame) -> DataFrame:
    return records.select(*KEY, F.upper("seq").alias("seq"))


def frame_findings(aligned: DataFrame, table: int = 1) -> DataFrame:
    """(locus, record_order, seq_id, event, start, end, original): frameshifts, external in the outer triplets, and stops."""

    def look(seq: np.ndarray | None) -> tuple[np.ndarray, ...]:
        t, kind = _kinds(np.zeros(0, dtype=np.uint8) if seq is None else seq, table)
        at = np.flatnonzero(kind >= 0)
        return kind[at], at * 3 + 1, at * 3 + 3, t[at]

    return columns.found(_upper(aligned), 1, look, {"event": _EVENTS, "start": "int", "end": "int", "original": "text"})


def masked(aligned: DataFrame, table: int = 1) -> DataFrame:
    """records over A, C, G, T, N and - with all columns kept: triplets with a finding are NNN."""
    old, new = "U" + AMBIGUOUS_BASES + "?", "T" + "N" * (len(AMBIGUOUS_BASES) + 1)

    def clean(seq: np.ndarray | None) -> np.ndarray | None:
        if seq is None:
            return None
        _, kind = _kinds(seq, table)
        out = columns.replaced(seq[: len(kind) * 3], old, new).reshape(-1, 3)
        out[kind >= 0] = ord("N")
        return out.ravel()

    return columns.mapped(_upper(aligned), 1, clean)


def masked_pair(codon: DataFrame, protein: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both less what formats can't say: a residue beyond the 20, X and - becomes X, its triplet NNN, in all records that both have."""
    p = protein.select(*KEY, F.upper("seq").alias("aa"))
    both = codon.select(*KEY, codons(F.upper("seq")).alias("t"), "seq").join(p, list(KEY)).withColumn("a", characters(F.col("aa")))
    odd = lambda a: ~F.contains(F.lit(PROTEIN_STATES_REPORT + "X-"), a)
    triplets = F.array_join(F.zip_with("t", "a", lambda c, a: F.when(odd(a), "NNN").otherwise(c)), "")
    return both.select(*KEY, triplets.alias("seq")), both.select(*KEY, F.regexp_replace("aa", f"[^{PROTEIN_STATES_REPORT}X-]", "X").alias("seq"))


def triplet_edits(before: DataFrame, after: DataFrame, table: int = 1) -> DataFrame:
    """An event, as of normalize, for every triplet that differs: what was found in it before, else export_change."""
    changed = after.select(*KEY, F.upper("seq").alias("after"))

    def look(seq: np.ndarray | None, new: np.ndarray | None) -> tuple[np.ndarray, ...]:
        if seq is None or new is None:
            seq = new = np.zeros(0, dtype=np.uint8)
        (t, kind), u = _kinds(seq, table), columns.triplets(new)
        more = max(len(t), len(u))
        t, u, kind = (np.concatenate([x, np.full(more - len(x), fill, dtype=x.dtype)]) for x, fill in ((t, 0), (u, 0), (kind, -1)))
        at = np.flatnonzero(t != u)
        return np.where(kind[at] < 0, 4, kind[at]), at * 3 + 1, at * 3 + 3, t[at], u[at], np.zeros(len(at))

    fields = {"event": _EVENTS, "start": "int", "end": "int", "original": "text", "replacement": "text", "action": ("replace",)}
    return columns.found(_upper(before).join(changed, list(KEY)), 2, look, fields)


def content_faults(aligned: DataFrame, source: DataFrame) -> DataFrame:
    """(locus, seq_id, fault): records that one side lacks, and those whose bases an aligner changed; gaps and ! aside."""
    bare = lambda df, name: df.select("locus", "seq_id", F.translate(F.upper("seq"), "-!", "").alias(name))
    joined = bare(aligned, "now").join(bare(source, "then"), ["locus", "seq_id"], "full_outer")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "unexpected").when(F.col("now") != F.col("then"), "changed")
    return joined.select("locus", "seq_id", fault.alias("fault")).where("fault is not null")
