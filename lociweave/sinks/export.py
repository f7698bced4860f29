"""Both export formats of alignments and the report of what they changed, from one scan.

Records are normalized once, with what they were and the number of their edits beside them in the row, and kept in a
table.  Its rows become the lines of all sinks in one plan, which one job writes; counts of what was written are observed
on the way.  Edits are found again where their lines are made: a letter is shuffled, never an edit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lociweave.functions import columns
from lociweave.functions.sequences import AMBIGUOUS_BASES, nexus_label, normalize_nucleotides, normalize_protein, normalize_rna
from lociweave.model import EVENT_FIELDS
from lociweave.sinks.lines import NEXUS_WIDTH

#: What NEXUS calls the kinds of sequences.
DATATYPES = {"DNA": "dna", "RNA": "rna", "protein": "protein"}
SINKS = ("phylip", "nexus", "changes")
#: Letters whose edits, and pieces of blocks, that become lines at a time.
BLOCK = 1 << 18


def _edit(kind: str, letter: str) -> tuple[str, str] | None:
    """Event and replacement of a letter, given in upper case: none if it stays."""
    if kind == "protein":
        return None if letter in "ACDEFGHIKLMNPQRSTVWYX?-" else ("protein_unsupported_residue", "X")
    if letter == ("T" if kind == "RNA" else "U"):
        return ("thymine_to_uracil", "U") if kind == "RNA" else ("uracil_to_thymine", "T")
    return ("nucleotide_ambiguity", "N") if letter in AMBIGUOUS_BASES else None


def _tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Of the letters of ASCII: what they become, and whether that is an edit (a change of case alone is none)."""
    edits = [_edit(kind, chr(k).upper()) for k in range(128)]
    return np.array([ord(e[1] if e else chr(k).upper()) for k, e in enumerate(edits)], dtype=np.uint8), np.array([e is not None for e in edits])


def _edited(kind: str, text: str) -> list[tuple[int, str, str, str]]:
    """(place from 1, original, event, replacement) of the edits of a text beyond ASCII."""
    found = columns.letters(text)
    up = columns.upper(found)
    told = {u: _edit(kind, chr(u)) for u in np.unique(up).tolist()}
    return [(k + 1, chr(found[k]), *told[int(up[k])]) for k in np.flatnonzero(np.isin(up, [u for u, e in told.items() if e])).tolist()]


def _sides(seq: Column, kind: str) -> list[Column]:
    """plain, texts of ASCII, which a table of letters normalizes; wide, others; and these normalized."""
    made = {"DNA": normalize_nucleotides(seq, keep_missing=True), "RNA": normalize_rna(seq), "protein": normalize_protein(seq)}[kind]
    wide = F.octet_length(seq) > F.length(seq)
    return [F.when(~wide, seq).alias("plain"), F.when(wide, seq).alias("wide"), F.when(wide, made).alias("made")]


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, one after the other, and where each begins and the last ends."""
    raw = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _texts(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """_flat() undone."""
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def prepared(records: DataFrame, kind: str = "DNA") -> DataFrame:
    """(locus, record_order, seq_id, seq, original, edits): normalized sequences, what they were, and how many letters that changed, other than in case."""
    if kind not in DATATYPES:
        raise ValueError(f"kind must be one of {', '.join(DATATYPES)}")
    table, changes = _tables(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in columns.slices(batches):
            plain, wide, made = batch.columns[3:]
            data, ends = _flat(plain)
            before = np.concatenate([[0], np.cumsum(changes[data])])
            edits = before[ends[1:]] - before[ends[:-1]]
            for k in np.flatnonzero(wide.is_valid()).tolist():
                edits[k] = len(_edited(kind, wide[k].as_py()))
            seq = pc.if_else(plain.is_valid(), _texts(table[data], ends), made)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], seq, pc.coalesce(plain, wide), pa.array(edits, pa.int32())], names=["locus", "record_order", "seq_id", "seq", "original", "edits"])

    kinds = dict(records.dtypes)
    keys = [f"{k} {kinds[k]}" for k in ("locus", "record_order", "seq_id")]
    return records.select("locus", "record_order", "seq_id", *_sides(F.col("seq"), kind)).mapInArrow(run, ", ".join([*keys, "seq string, original string, edits int"]))


def counts(spool: DataFrame) -> DataFrame:
    """(locus, ntax, nchar, edits, width, last, leader, fault) of prepared() records: width of the longest label, place of the last record, the id of one, and why a locus is no alignment (null if it is)."""
    n = F.length("seq")
    seen = spool.groupBy("locus").agg(
        F.count(F.lit(1)).alias("ntax"), F.max(n).alias("nchar"), F.min(n).alias("least"), F.count_distinct("seq_id").alias("ids"), F.sum("edits").alias("edits"),
        F.max(F.length(nexus_label(F.col("seq_id")))).alias("width"), F.max("record_order").alias("last"), F.max("seq_id").alias("leader"),
    )
    fault = F.when(F.col("ids") < F.col("ntax"), "duplicate ids").when(F.col("nchar") == 0, "empty").when(F.col("least") != F.col("nchar"), "unequal lengths")
    return seen.select("locus", "ntax", "nchar", "edits", "width", "last", "leader", fault.alias("fault"))


def _line(sink: str, major: Column, minor: Column, line: Column) -> Column:
    return F.struct(F.lit(sink).alias("sink"), major.cast("long").alias("major"), minor.cast("long").alias("minor"), line.alias("line"))


def export_lines(spool: DataFrame, counted: DataFrame, kind: str = "DNA", file: Column | None = None, width: int = NEXUS_WIDTH) -> DataFrame:
    """(locus, sink, major, minor, line): the lines of all sinks, in the order of major and minor, of loci without fault.

    A record's lines come out of its row: its PHYLIP line, its part of every NEXUS block, and a line per edit; with those
    of one record come the lines that the locus has as a whole.
    file: the name that edits are reported under, of locus; the locus if none is given.
    """
    name, table, changes = F.col("locus").cast("string") if file is None else file, *_tables(kind)
    after = F.floor((F.col("nchar") + width - 1) / width) + 1
    head = F.format_string(f"#NEXUS\n\nbegin data;\n  dimensions ntax=%d nchar=%d;\n  format datatype={DATATYPES[kind]} missing=? gap=- interleave;\n  matrix", F.col("ntax"), F.col("nchar"))
    protein = kind == "protein"
    names = "\t".join([*EVENT_FIELDS, *["source_aa_positions"] * protein])
    frame = F.array_compact(F.array(
        _line("phylip", F.lit(0), F.lit(0), F.concat_ws(" ", "ntax", "nchar")), _line("nexus", F.lit(0), F.lit(0), head), _line("nexus", after, F.lit(0), F.lit("  ;\nend;")),
        F.when(F.col("edits") > 0, _line("changes", F.lit(0), F.lit(0), F.lit(names))),
    ))
    joined = spool.select("locus", "record_order", "seq_id", "original").join(counted.where("fault is null").drop("fault"), "locus")
    rows = joined.select(
        "locus", F.col("record_order").cast("long").alias("at"), F.concat("seq_id", F.lit("  ")).alias("id"), F.concat(F.rpad(nexus_label(F.col("seq_id")), F.col("width"), F.lit(" ")), F.lit(" ")).alias("label"),
        F.when(F.col("record_order") == F.col("last"), "\n").otherwise("").alias("end"),  # a blank line follows the block
        F.concat_ws("\t", name, "seq_id", F.lit("")).alias("source"), F.when(F.col("seq_id") == F.col("leader"), frame).alias("frame"), *_sides(F.col("original"), kind),
    )

    def around(original: str, event: str, new: str) -> tuple[str, str]:
        """The fields of an edit before its place (given from and to) and after it."""
        fields = [original, new, "replace", "NA", "source"]
        return ("\t".join([event, "NA", *fields, ""]), "") if protein else (f"{event}\t", "\t".join(["", *fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [around(chr(k), *(_edit(kind, chr(k).upper()) or ("", ""))) for k in range(128)]
        left, right = (pa.array(side, pa.string()) for side in zip(*texts, strict=True))
        for batch in columns.slices(batches, columns.SLICE_BYTES // 8):
            locus, at, ids, label, end, source, frames, plain, wide, made = batch.columns
            order = at.to_numpy(zero_copy_only=False)

            def lines(rows, sink, major, minor, line):
                arrays = [locus.take(pa.array(rows)), pa.repeat(pa.scalar(sink), len(rows)), pa.array(major, pa.int64()), pa.array(minor, pa.int64()), line]  # noqa: B023
                return pa.RecordBatch.from_arrays(arrays, names=["locus", "sink", "major", "minor", "line"])

            whole = frames.flatten()
            yield pa.RecordBatch.from_arrays([locus.take(pc.list_parent_indices(frames)), *whole.flatten()], names=["locus", "sink", "major", "minor", "line"])
            data, ends = _flat(plain)
            normal = table[data]
            rows = np.flatnonzero(plain.is_valid())
            yield lines(rows, "phylip", order[rows] + 1, np.zeros(len(rows), dtype=np.int64), pc.binary_join_element_wise(ids, _texts(normal, ends), "").take(pa.array(rows)))

            pieces = -(-np.diff(ends) // width)
            row = np.repeat(np.arange(len(pieces)), pieces)
            block = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = np.append(ends[row] + width * block, len(data))  # pieces lie one after the other
            for k in range(0, len(row), BLOCK):
                some, bounds = row[k : k + BLOCK], starts[k : k + BLOCK + 1]
                text = _texts(normal[bounds[0] : bounds[-1]], bounds - bounds[0])
                yield lines(some, "nexus", block[k : k + BLOCK] + 1, order[some], pc.binary_join_element_wise(label.take(pa.array(some)), text, end.take(pa.array(some)), ""))

            for k in range(0, len(data), BLOCK):
                places = np.flatnonzero(changes[data[k : k + BLOCK]]) + k
                row_of, letter = np.searchsorted(ends, places, side="right") - 1, pa.array(data[places])
                pos = places - ends[row_of] + 1
                told = pa.array(pos).cast(pa.string())
                yield lines(row_of, "changes", order[row_of] + 1, pos, pc.binary_join_element_wise(source.take(pa.array(row_of)), left.take(letter), told, "-", told, right.take(letter), ""))

            for k in np.flatnonzero(wide.is_valid()).tolist():
                out, first = made[k].as_py(), order[k] + 1
                cut, edits = [out[i : i + width] for i in range(0, len(out), width)], _edited(kind, wide[k].as_py())
                own = [around(c, event, new) for _, c, event, new in edits]
                yield lines([k], "phylip", [first], [0], pa.array([ids[k].as_py() + out]))
                yield lines([k] * len(cut), "nexus", np.arange(len(cut)) + 1, [order[k]] * len(cut), pa.array([label[k].as_py() + piece + end[k].as_py() for piece in cut], pa.string()))
                yield lines([k] * len(own), "changes", [first] * len(own), [e[0] for e in edits], pa.array([f"{source[k].as_py()}{a}{e[0]}-{e[0]}{b}" for e, (a, b) in zip(edits, own, strict=True)], pa.string()))

    return rows.mapInArrow(run, f"locus {dict(spool.dtypes)['locus']}, sink string, major long, minor long, line string")


@dataclass(frozen=True)
class Exported:
    """What an export wrote: records and edits in all, and a row per locus (locus, ntax, nchar, edits)."""

    records: int
    edits: int
    loci: DataFrame


def export_formats(records: DataFrame, folder: str, kind: str = "DNA", file: Column | None = None, mode: str = "errorifexists") -> Exported:
    """Writes folder/sink=phylip, nexus and changes, each with a folder per locus whose files, in the order of their names, are the format.

    records are read once, into folder/spool, which stays for whoever wants the normalized records; then one job writes
    all sinks.  A locus that is no alignment raises before any sink is written.  A locus without edits has no changes.
    """
    spark, seen = records.sparkSession, Observation()
    observed = prepared(records, kind).observe(seen, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("edits"), F.lit(0)).alias("edits"))
    observed.write.mode(mode).parquet(f"{folder}/spool")
    spool = spark.read.parquet(f"{folder}/spool")
    counted = counts(spool)
    counted.write.mode(mode).parquet(f"{folder}/counts")
    counted = spark.read.parquet(f"{folder}/counts")
    if bad := counted.where("fault is not null").orderBy("locus").first():
        raise ValueError(f"locus {bad['locus']}: {bad['fault']}")
    order = ["sink", "locus", "major", "minor"]
    lines = export_lines(spool, counted, kind, file).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("sink", "locus", "line").write.mode(mode).partitionBy("sink", "locus").text(f"{folder}/lines")
    return Exported(seen.get["records"], seen.get["edits"], counted.select("locus", "ntax", "nchar", "edits"))
