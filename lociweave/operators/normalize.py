"""Cleaning sequences, with an event for every edit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions import columns
from lociweave.functions.genetic_code import is_stop, stop_codons
from lociweave.functions.sequences import AMBIGUOUS_BASES, characters, codons, normalize_nucleotides, normalize_protein, normalize_rna

KEY = ("locus", "record_order", "seq_id")


def _event(kind: Column, start: Column, end: Column, original: Column, replacement: Column, action: Column) -> list[Column]:
    return [*KEY, kind.alias("event"), start.cast("int").alias("start"), end.cast("int").alias("end"), original.alias("original"), replacement.alias("replacement"), action.alias("action")]


def _bases(records: DataFrame) -> DataFrame:
    out = records.select(*KEY, F.posexplode(characters(F.col("seq"))).alias("at", "original"))
    return out.withColumns({"at": F.col("at") + 1, "upper": F.upper("original")})


def _base_events(bases: DataFrame, ambiguous: str, rna: bool = False) -> DataFrame:
    swapped = F.col("upper") == ("T" if rna else "U")
    bases = bases.where(swapped | F.col("upper").isin(list(ambiguous)))
    kind = F.when(swapped, "thymine_to_uracil" if rna else "uracil_to_thymine").otherwise("nucleotide_ambiguity")
    return bases.select(*_event(kind, F.col("at"), F.col("at"), F.col("original"), F.when(swapped, "U" if rna else "T").otherwise("N"), F.lit("replace")))


def clean_nucl(records: DataFrame) -> DataFrame:
    return records.select(*KEY, normalize_nucleotides(F.col("seq")).alias("seq"))


def nucl_events(records: DataFrame) -> DataFrame:
    """(locus, record_order, seq_id, event, start, end, original, replacement, action), positions from 1: U to T, IUPAC letters and ? to N."""
    return _base_events(_bases(records), AMBIGUOUS_BASES + "?")


def export_events(records: DataFrame, protein: bool = False) -> DataFrame:
    """Edits of an export: ? stays; a change of case alone is none."""
    if not protein:
        return _base_events(_bases(records), AMBIGUOUS_BASES)
    bases = _bases(records).where(~F.col("upper").rlike("^[ACDEFGHIKLMNPQRSTVWYX?-]$"))
    return bases.select(*_event(F.lit("protein_unsupported_residue"), F.col("at"), F.col("at"), F.col("original"), F.lit("X"), F.lit("replace")))


def clean_rna(records: DataFrame) -> DataFrame:
    """An RNA export: as clean_export, then T as U."""
    return records.select(*KEY, normalize_rna(F.col("seq")).alias("seq"))


def rna_events(records: DataFrame) -> DataFrame:
    """Edits of clean_rna: T to U, IUPAC letters to N; ? stays, and U is no edit."""
    return _base_events(_bases(records), AMBIGUOUS_BASES, rna=True)


def clean_export(records: DataFrame, protein: bool = False) -> DataFrame:
    seq = normalize_protein(F.col("seq")) if protein else normalize_nucleotides(F.col("seq"), keep_missing=True)
    return records.select(*KEY, seq.alias("seq"))


def clean_codon(records: DataFrame, table: int = 1) -> DataFrame:
    """Coding sequences of whole triplets: a stop at the end goes, one before becomes NNN, the rest over A, C, G, T, N and -.

    A locus with a record of which nothing is left is skipped whole; see codon_events for why.
    """
    source = lambda c: F.translate(F.upper(c), "U", "T")
    inner = lambda c: F.when(is_stop(source(c), table), "NNN").otherwise(normalize_nucleotides(c))
    cut = records.select(*KEY, codons(F.col("seq")).alias("t"))
    # the last triplet apart: inside transform, whatever tells it from the others would be worked out for each
    last = F.get("t", F.size("t") - 1)
    end = F.when(is_stop(source(last), table, terminal=True), "").otherwise(normalize_nucleotides(last))
    body = F.array_join(F.transform(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), inner), "")
    out = cut.select(*KEY, F.when(F.size("t") == 0, "").otherwise(F.concat(body, end)).alias("seq"))
    empty = out.where("seq = ''").select("locus").distinct()
    return out.join(empty, "locus", "left_anti").select(*KEY, "seq")


def codon_events(records: DataFrame, table: int = 1) -> DataFrame:
    """Events of clean_codon: partial triplets at the end, stops, and single bases of triplets that are no stops."""
    sets = [columns.codon_numbers(stop_codons(table, terminal)) for terminal in (False, True)]
    odd = [ord(c) for c in "U" + AMBIGUOUS_BASES + "?"]
    dash, n, t, nnn, na = (_number(x) for x in ("-", "N", "T", "NNN", "NA"))

    def look(seq: np.ndarray | None) -> tuple[np.ndarray, ...]:
        out = []
        add = lambda event, start, end, original, replacement, action: out.append([np.atleast_1d(x) for x in np.broadcast_arrays(event, start, end, np.asarray(original, dtype=np.uint64), np.asarray(replacement, dtype=np.uint64), action)])
        if seq is None:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
        up, size, rest = columns.upper(seq), len(seq), len(seq) % 3
        units, source = columns.triplets(seq), columns.triplets(columns.replaced(up, "U", "T"))
        stop = np.isin(source, sets[0])
        if len(units):
            stop[-1] = source[-1] in sets[1]
        if rest:
            add(0, size - rest + 1, size, _number(seq[size - rest :]), dash, 1)
        at = np.flatnonzero(stop)
        last = at == len(units) - 1
        add(np.where(last, 1, 2), at * 3 + 1, at * 3 + 3, units[at], np.where(last, dash, nnn), np.where(last, 1, 0))
        at = np.flatnonzero(np.isin(up[: len(units) * 3], odd) & ~np.repeat(stop, 3))
        swapped = up[at] == ord("U")
        add(np.where(swapped, 3, 4), at + 1, at + 1, seq[at].astype(np.uint64) << np.uint64(42), np.where(swapped, t, n), 0)
        if size < 3:
            add(5, 0, 0, na, na, 2)
        if len(units) == 1 and stop[0]:
            add(5, 0, 0, na, na, 3)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    events = ("terminal_partial_codon", "terminal_stop", "internal_stop", "uracil_to_thymine", "nucleotide_ambiguity", "validation_error")
    fields = {"event": events, "start": "int", "end": "int", "original": "text", "replacement": "text", "action": ("replace", "delete", "reject", "skip")}
    return columns.found(records.select(*KEY, "seq"), 1, look, fields)


def _number(text: str | np.ndarray) -> np.uint64:
    """A text of up to three letters as one number, as of columns.triplets()."""
    found = np.array([ord(c) for c in text], dtype=np.uint32) if isinstance(text, str) else text
    return columns.triplets(np.concatenate([found.astype(np.uint32), np.zeros(3 - len(found), dtype=np.uint32)]))[0]


def _protein_end(stop: str) -> Column:
    """Length without the stops and gaps at the end."""
    return F.length(F.rtrim(F.col("seq"), F.lit(stop + "-")))


def clean_protein(records: DataFrame, stop: str = "*") -> DataFrame:
    """Upper case; stops at the end go (gaps there stay), others and letters beyond the 20 residues, X and - become X; records of nothing else are rejected."""
    end = _protein_end(stop)
    body = F.regexp_replace(F.upper(F.substring("seq", F.lit(1), end)), "[^ACDEFGHIKLMNPQRSTVWYX-]", "X")
    tail = F.replace(F.substring("seq", end + 1, F.length("seq")), F.lit(stop), F.lit(""))
    return records.where(end > 0).select(*KEY, F.concat(body, tail).alias("seq"))


def protein_events(records: DataFrame, stop: str = "*") -> DataFrame:
    kept = records.where(_protein_end(stop) > 0)
    marked = kept.select(*KEY, _protein_end(stop).alias("stop_from"), F.posexplode(characters(F.col("seq"))).alias("at", "original"))
    is_stop_, terminal = F.col("original") == stop, F.col("at") >= F.col("stop_from")
    marked = marked.where(is_stop_ | ~F.upper("original").rlike("^[ACDEFGHIKLMNPQRSTVWYX-]$"))
    kind = F.when(is_stop_ & terminal, "protein_terminal_stop").when(is_stop_, "protein_internal_stop").otherwise("protein_unsupported_residue")
    gone = is_stop_ & terminal
    edits = marked.select(*_event(kind, F.col("at") + 1, F.col("at") + 1, F.col("original"), F.when(gone, "-").otherwise("X"), F.when(gone, "delete").otherwise("replace")))
    rejected = records.where(_protein_end(stop) == 0).select(*_event(F.lit("validation_error"), F.lit(None), F.lit(None), F.lit("NA"), F.lit("NA"), F.lit("reject")))
    return edits.unionByName(rejected)
