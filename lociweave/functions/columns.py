"""Columns of alignments added up as arrays, and records changed as arrays: no cell is ever a row.

Tasks add up what the records of a locus say of its columns; only these sums, a few bytes a column and one row per locus
and task, are shuffled and merged.  A row of sums is about as long as a record, which is one row as well, and a locus
with any number of records is never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Marks = dict[str, np.ndarray]
#: Bytes of Arrow rows that are looked at together, and of sums that a task keeps before it sends them on.
SLICE_BYTES, HELD_BYTES = 4 << 20, 32 << 20


@dataclass(frozen=True)
class Tally:
    """What is added up: mark makes arrays, an entry a column, from the units of some records (rows, columns; a number each) and their places; fields says how such arrays merge.

    sum, or, xor; again: set where two sides both have a bit of the field before; first: a number of any record, 0 for
    none, and differs: whether others have another number than the field before.
    """

    fields: dict[str, str]
    mark: Callable[[np.ndarray, np.ndarray], Marks]
    triplets: bool = False


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, size * batch.num_rows // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def letters(text: str | bytes) -> np.ndarray:
    """Code points: bytes of ASCII texts, else 32 bits each."""
    raw = text.encode() if isinstance(text, str) else text
    found = np.frombuffer(raw, dtype=np.uint8)
    return found if not len(found) or found.max() < 128 else np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)


def text_of(found: np.ndarray) -> str:
    """letters() undone."""
    return found.tobytes().decode("ascii") if found.dtype == np.uint8 else found.astype("<u4").tobytes().decode("utf-32-le")


def triplets(found: np.ndarray) -> np.ndarray:
    """Complete triplets of the letters along the last axis as one number each: the three letters from high to low bits, 21 each."""
    whole = found[..., : found.shape[-1] // 3 * 3].reshape(*found.shape[:-1], -1, 3).astype(np.uint64)
    return whole[..., 0] << np.uint64(42) | whole[..., 1] << np.uint64(21) | whole[..., 2]


def base(units: np.ndarray, k: int) -> np.ndarray:
    """The k-th letter (from 0) of triplets()."""
    return (units >> np.uint64(42 - 21 * k) & np.uint64((1 << 21) - 1)).astype(np.uint32)


def codon_numbers(codons: Iterable[str]) -> np.ndarray:
    return _codon_numbers(tuple(codons))


@lru_cache(256)
def _codon_numbers(codons: tuple[str, ...]) -> np.ndarray:
    return triplets(np.array([[ord(x) for x in c] for c in codons], dtype=np.uint32)).ravel()


def has(units: np.ndarray, letter: str) -> np.ndarray:
    """Whether units, letters or triplets, have a letter."""
    if units.dtype != np.uint64:
        return units == ord(letter)
    return (base(units, 0) == ord(letter)) | (base(units, 1) == ord(letter)) | (base(units, 2) == ord(letter))


def lookup(table: np.ndarray, units: np.ndarray) -> np.ndarray:
    """table, of 256 entries, at letters; those beyond have its last one."""
    return table[units if units.dtype == np.uint8 else np.minimum(units, 255)]


def _longer(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(n - len(a), dtype=a.dtype)])


def _merged(fields: dict[str, str], a: Marks, b: Marks) -> Marks:
    n, out, before = max(len(next(iter(a.values()))), len(next(iter(b.values())))), {}, None
    for name, how in fields.items():
        x, y = _longer(a[name], n), _longer(b[name], n)
        if how == "sum":
            out[name] = x + y
        elif how == "or":
            out[name] = x | y
        elif how == "xor":
            out[name] = x ^ y
        elif how == "first":
            out[name] = np.where(x > 0, x, y)
        else:
            p, q = before
            out[name] = x | y | (p & q if how == "again" else ((p > 0) & (q > 0) & (p != q)).astype(x.dtype))
        before = x, y
    return out


def _packed(a: np.ndarray) -> bytes:
    """The entries in as few bytes as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max()))).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"u{len(raw) // n}").astype(np.uint64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, letters of rows of one locus and length): ASCII records next to each other are one matrix, others come one by one."""
    text = batch.column(2).cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] else np.zeros(0, dtype=np.uint8)
    locus, sizes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), np.diff(offsets)
    cuts = np.flatnonzero((locus[1:] != locus[:-1]) | (sizes[1:] != sizes[:-1])) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)], strict=True):
        part = data[offsets[start] : offsets[stop]]
        if not len(part):
            continue
        if part.max() < 128:
            yield start, part.reshape(stop - start, -1)
        else:
            for k in range(start, stop):
                yield k, letters(data[offsets[k] : offsets[k + 1]].tobytes())[None]


def tallied(records: DataFrame, tally: Tally, schema: str, finish: Callable[[Marks], tuple]) -> DataFrame:
    """(locus, schema): finish of the merged sums of each locus of records (locus, record_order, seq); loci without a unit aren't there."""
    kind, names = dict(records.dtypes)["locus"], list(tally.fields)
    merge = tally.fields

    def emitted(held: dict) -> pa.RecordBatch:
        columns = [pa.array(list(held), arrow), pa.array([len(m[names[0]]) for m in held.values()], pa.int32())]
        return pa.RecordBatch.from_arrays(columns + [pa.array([_packed(m[k]) for m in held.values()], pa.binary()) for k in names], names=["locus", "width", *names])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow
        held, size = {}, 0
        for batch in slices(batches):
            arrow = batch.schema.field(0).type
            batch = batch.filter(batch.column(2).is_valid())
            loci, orders = batch.column(0).to_pylist(), batch.column(1).fill_null(0).to_numpy()
            for start, found in _runs(batch) if batch.num_rows else ():
                units = triplets(found) if tally.triplets else found
                if not units.shape[1]:
                    continue
                marks, locus = tally.mark(units, orders[start : start + len(units)]), loci[start]
                held[locus] = _merged(merge, held[locus], marks) if locus in held else marks
                size += sum(x.nbytes for x in marks.values())
            if size > HELD_BYTES:
                yield emitted(held)
                held, size = {}, 0
        if held:
            yield emitted(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow
        locus, marks, out = None, None, []
        for batch in slices(batches):
            arrow = batch.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = {k: _unpacked(raw, row[1]) for k, raw in zip(names, row[2:], strict=True)}
                if marks is not None and row[0] == locus:
                    marks = _merged(merge, marks, found)
                    continue
                if marks is not None:
                    out.append((locus, *finish(marks)))
                locus, marks = row[0], found
            if out:
                yield _rows(out, arrow, schema)
                out = []
        if marks is not None:
            yield _rows([(locus, *finish(marks))], arrow, schema)

    arrow = None
    partial = records.select("locus", "record_order", "seq").mapInArrow(add, ", ".join([f"locus {kind}", "width int", *[f"{k} binary" for k in names]]))
    return partial.repartition("locus").sortWithinPartitions("locus").mapInArrow(merged, f"locus {kind}, {schema}")


_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}


def _rows(rows: list[tuple], locus: pa.DataType, schema: str) -> pa.RecordBatch:
    kinds = [x.split() for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [locus, *[_ARROW[k] for _, k in kinds]], strict=True)], names=["locus", *[n for n, _ in kinds]])


def mapped(rows: DataFrame, inputs: int, change: Callable[..., np.ndarray | None], keep: tuple[str, ...] = ("locus", "record_order", "seq_id")) -> DataFrame:
    """keep and seq: rows whose sequence change makes from the letters of the inputs columns (strings; null for none) after keep."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = [batch.column(len(keep) + k).cast(pa.binary()).to_pylist() for k in range(inputs)]
            made = [change(*[None if x is None else letters(x) for x in row]) for row in zip(*columns, strict=True)]
            made = [None if m is None else text_of(m) for m in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.string())], names=[*keep, "seq"])

    return rows.mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keep], "seq string"]))


def _texts(numbers: np.ndarray) -> pa.Array:
    """Texts of up to three letters from triplets(), 0 for a letter that isn't there; null for 0."""
    found = np.stack([base(numbers, k) for k in range(3)], axis=1)
    if len(found) and found.max() > 127:
        return pa.array(["".join(map(chr, filter(None, x))) or None for x in found.tolist()], pa.string())
    ends = np.concatenate([[0], np.cumsum((found > 0).sum(axis=1))]).astype(np.int32)
    valid = pa.py_buffer(np.packbits(numbers > 0, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(found), [valid, pa.py_buffer(ends), pa.py_buffer(found[found > 0].astype(np.uint8))])


def found(rows: DataFrame, inputs: int, look: Callable[..., tuple[np.ndarray, ...]], fields: dict[str, str | tuple[str, ...]], keep: tuple[str, ...] = ("locus", "record_order", "seq_id")) -> DataFrame:
    """keep and fields: the rows that look finds in the letters of the inputs columns (strings; null for none) after keep.

    look gives an array a field, all as long as there are rows: numbers for int, 0 for null; triplets(), letters at the
    end left out as 0, for text; places in a tuple of texts for such a tuple.
    """
    kinds = dict(rows.dtypes)

    def made(kind: str | tuple[str, ...], values: np.ndarray) -> pa.Array:
        if kind == "int":
            return pa.array(values.astype(np.int32), pa.int32(), mask=values == 0)
        return _texts(values.astype(np.uint64)) if kind == "text" else pa.array(list(kind), pa.string()).take(pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES // 8):
            columns = [batch.column(len(keep) + k).cast(pa.binary()).to_pylist() for k in range(inputs)]
            seen = [look(*[None if x is None else letters(x) for x in row]) for row in zip(*columns, strict=True)]
            at = pa.array(np.repeat(np.arange(len(seen)), [len(x[0]) for x in seen]))
            values = [made(kind, np.concatenate(v)) for kind, v in zip(fields.values(), zip(*seen, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[: len(keep)]], *values], names=[*keep, *fields])

    return rows.mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keep], *[f"`{n}` {'int' if k == 'int' else 'string'}" for n, k in fields.items()]]))


def upper(found: np.ndarray) -> np.ndarray:
    """Letters as upper-case ones, where that is ASCII."""
    low = ((found >= 97) & (found <= 122)).astype(found.dtype) * found.dtype.type(32)
    if found.dtype == np.uint8:
        return found - low
    return np.where(found == 0x17F, ord("S"), np.where(found == 0x131, ord("I"), found - low)).astype(found.dtype)


@lru_cache(256)
def _replacing(old: str, new: str) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for a, b in zip(old, new, strict=True):
        table[ord(a)] = ord(b)
    return table


def replaced(found: np.ndarray, old: str, new: str) -> np.ndarray:
    """ASCII letters of old as those of new at the same places."""
    table = _replacing(old, new)
    return table[found] if found.dtype == np.uint8 else np.where(found < 256, table[np.minimum(found, 255)], found).astype(found.dtype)


def flags(keep: np.ndarray) -> str:
    """A 1 for every column that stays, a 0 for the others."""
    return (keep.astype(np.uint8) + 48).tobytes().decode("ascii")


def places(kept: DataFrame) -> DataFrame:
    """(locus, pos from 1) of flags (locus, keep)."""
    return kept.select("locus", F.posexplode(F.split("keep", "")).alias("at", "flag")).where("flag = '1'").select("locus", (F.col("at") + 1).alias("pos"))


def states_of(states: str, fold: bool) -> np.ndarray:
    """A table of letters to the bit of their state, 0 for others; with fold a U is a T."""
    table = np.zeros(256, dtype=np.uint64)
    for k, s in enumerate(states):
        table[ord(s)] = 1 << k
    if fold:
        table[ord("U")] = table[ord("T")]
    return table


def seen_and_again(bits: np.ndarray) -> Marks:
    """From a bit per cell: which bits a column has, and which more than once."""
    seen, again = bits[0].copy(), np.zeros_like(bits[0])
    for row in bits[1:]:
        again |= seen & row
        seen |= row
    return {"seen": seen, "again": again}


def one_number(units: np.ndarray) -> Marks:
    """first and differs of units; zero for units that don't count."""
    low = np.where(units > 0, units, np.iinfo(units.dtype).max).min(axis=0)
    high = units.max(axis=0)
    return {"first": high.astype(np.uint64), "differs": ((high > 0) & (low != high)).astype(np.uint64)}


def total(cells: np.ndarray) -> np.ndarray:
    return cells.sum(axis=0, dtype=np.uint64)
