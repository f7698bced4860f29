"""What the columns of alignments say: states, patterns and gaps."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions import columns
from lociweave.functions.sequences import DNA_STATES, PROTEIN_STATES_QC, PROTEIN_STATES_REPORT


def _tally(seqtype: str, states: str = "", gaps: bool = False) -> columns.Tally:
    """Which states a column has, and which more than once; with gaps also its gaps and its cells."""
    table = columns.states_of(states, seqtype != "prot")

    def mark(units: np.ndarray, orders: np.ndarray) -> columns.Marks:
        found = columns.seen_and_again(columns.lookup(table, units)) if states else {}
        return found | ({"gap": columns.total(units == ord("-")), "n": np.full(units.shape[1], len(units), dtype=np.uint64)} if gaps else {})

    return columns.Tally(({"seen": "or", "again": "again"} if states else {}) | ({"gap": "sum", "n": "sum"} if gaps else {}), mark)


def _upper(records: DataFrame) -> DataFrame:
    return records.select("locus", "record_order", F.upper("seq").alias("seq"))


def _counts(m: columns.Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column: resolved states, those that occur twice or more, and those that occur once."""
    return tuple(np.bitwise_count(x) for x in (m["seen"], m["again"], m["seen"] & ~m["again"]))


_CLASSES = "constant_sites long, variable_sites long, parsimony_informative_sites long, singleton_sites long"
_GAPS = "max_gap_ratio double, full_gap_columns long"


def _classes_qc(m: columns.Marks) -> tuple[int, ...]:
    states, twice, once = _counts(m)
    variable, informative = states > 1, twice > 1
    return tuple(int(x.sum()) for x in (~variable, variable, variable & informative, variable & ~informative & (once > 0)))


def _states_qc(seqtype: str) -> str:
    return PROTEIN_STATES_QC if seqtype == "prot" else DNA_STATES


def site_classes_qc(records: DataFrame, seqtype: str = "nucl") -> DataFrame:
    """Per locus: constant (one state or none), variable, parsimony informative (two states twice) and singleton sites."""
    return columns.tallied(_upper(records), _tally(seqtype, _states_qc(seqtype)), _CLASSES, _classes_qc)


def site_profile(records: DataFrame, seqtype: str = "nucl") -> DataFrame:
    """site_classes_qc() and column_gaps() from one pass over the records."""
    return columns.tallied(_upper(records), _tally(seqtype, _states_qc(seqtype), gaps=True), f"{_CLASSES}, {_GAPS}", lambda m: _classes_qc(m) + _gap_sums(m))


def site_classes_report(records: DataFrame, seqtype: str = "nucl") -> DataFrame:
    """As above by the report's definitions: unresolved columns apart; singleton is exactly two states, the rarer once."""

    def finish(m: columns.Marks) -> tuple[int, ...]:
        states, twice, once = _counts(m)
        return tuple(int(x.sum()) for x in (states == 0, states == 1, states > 1, twice > 1, (states == 2) & (once > 0)))

    tally = _tally(seqtype, PROTEIN_STATES_REPORT if seqtype == "prot" else DNA_STATES)
    return columns.tallied(_upper(records), tally, "unresolved_only long, constant long, variable long, pis long, singleton long", finish)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1024)
def _letter_hashes(order: int, step: int, fold: bool) -> np.ndarray:
    """Hashes of the first 256 letters in the record of that place."""
    known = _mixed(_mixed((np.arange(256, dtype=np.uint64) | np.uint64(order) << np.uint64(32)) * np.uint64(step)) + np.uint64(step))
    if fold:
        known[ord("U")] = known[ord("T")]
    return known


def distinct_patterns(records: DataFrame, seqtype: str = "nucl") -> DataFrame:
    """Per locus how many different columns there are, all symbols counting.

    A column is known by 128 bits that its cells, each hashed with its place in two ways, give together in any order.
    """
    steps = {"h0": np.uint64(0x9E3779B97F4A7C15), "h1": np.uint64(0xD6E8FEB86659FD93)}

    def mark(units: np.ndarray, orders: np.ndarray) -> columns.Marks:
        out = {k: np.zeros(units.shape[1], dtype=np.uint64) for k in steps}
        for row, order in zip(units, orders.tolist(), strict=True):
            place = np.uint64(order) << np.uint64(32)
            for k, step in steps.items():
                known = _letter_hashes(order, int(step), seqtype != "prot")
                out[k] ^= known[row] if row.dtype == np.uint8 else np.where(row < 256, known[np.minimum(row, 255)], _mixed(_mixed((row.astype(np.uint64) | place) * step) + step))
        return out

    def finish(m: columns.Marks) -> tuple[int]:
        h0, h1 = (m[k][np.lexsort((m["h1"], m["h0"]))] for k in steps)
        return (1 + int(((h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])).sum()),)

    return columns.tallied(_upper(records), columns.Tally(dict.fromkeys(steps, "xor"), mark), "distinct_patterns long", finish)


def _gap_sums(m: columns.Marks) -> tuple[float, int]:
    ratio = m["gap"] / m["n"]
    return float(ratio.max()), int((ratio == 1).sum())


def column_gaps(records: DataFrame, seqtype: str = "nucl") -> DataFrame:
    """Per locus: the highest gap ratio of a column, and how many columns are nothing but gaps."""
    return columns.tallied(_upper(records), _tally(seqtype, gaps=True), _GAPS, _gap_sums)


def valid_codon_sites(records: DataFrame) -> DataFrame:
    """Per locus the triplets without - or ? in any record."""

    def mark(units: np.ndarray, orders: np.ndarray) -> columns.Marks:
        return {"odd": (columns.has(units, "-") | columns.has(units, "?")).any(axis=0).astype(np.uint64)}

    return columns.tallied(_upper(records), columns.Tally({"odd": "or"}, mark, True), "valid_sites long", lambda m: (int((m["odd"] == 0).sum()),))
