"""Sequence files checked line by line, wherever their lines lie: no task needs a whole file or record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociweave.functions import columns
from lociweave.functions.ordered import PIECE

#: The most bytes of a header line, its end included.
HEADER_BYTES = 65_536
#: ASCII white space within a line.
BLANK = np.isin(np.arange(256), list(b" \t\x0b\f\r"))
#: What can be wrong with a line, the first that holds.
LINE_FAULTS = ("header is too long", "empty id", "sequence before the first header", "letters beyond ASCII")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of all files, numbered from 1; lines are counted where they are read, and only the pieces of files, one row each, are added up."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"), "value")
    sums = raw.groupBy("file", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("piece")) - F.col("n")
    placed = raw.join(sums.select("file", "piece", "first", before.alias("before")), ["file", "piece"])
    return placed.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def placed_parts(lines: DataFrame, piece: int = PIECE, header_bytes: int = HEADER_BYTES) -> DataFrame:
    """(file, record, line, seq_id, chunk, length, bad) of lines (file, line, value): neighbouring lines of a record, from its first on in a piece of the file's lines or in a batch.

    record: headers up to these lines, 0 before the first. seq_id: null where the header isn't among the lines. chunk: the
    sequence without white space. bad: (line, fault) of lines. Headers are counted within pieces of a file's lines; a file's
    pieces, one row each, are added up, and go before the lines of their piece, which are shuffled once.
    """
    marked = lines.select("file", F.floor(F.col("line") / piece).alias("piece"), F.col("line").cast("long").alias("line"), "value")
    sums = marked.groupBy("file", "piece").agg(F.count_if(F.startswith("value", F.lit(">"))).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("piece")) - F.col("n")
    starts = sums.select("file", "piece", F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("value"), before.alias("before")).where("before > 0")
    ordered = marked.withColumn("before", F.lit(None).cast("long")).unionByName(starts).repartition("file", "piece").sortWithinPartitions("file", "piece", F.asc_nulls_first("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place, record = None, None, 0  # of the last row so far
        for batch in columns.slices(batches):
            files, pieces, numbers, values, earlier = batch.columns
            pieces, ruled = pieces.to_numpy(zero_copy_only=False), numbers.is_valid().to_numpy(zero_copy_only=False)
            new = np.ones(len(pieces), dtype=bool)
            new[1:] = (pieces[1:] != pieces[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
            new[0] = place is None or pieces[0] != place or files[0].as_py() != file
            header = pc.starts_with(values, ">").fill_null(False).to_numpy(zero_copy_only=False)
            group, headers, first = np.cumsum(new), np.cumsum(header), np.flatnonzero(new)
            offsets = np.concatenate([[record], earlier.fill_null(0).to_numpy(zero_copy_only=False)[first] - headers[first] + header[first]])
            records = offsets[group] + headers
            file, place, record = files[-1].as_py(), pieces[-1], records[-1]
            at = np.flatnonzero(ruled)
            if not len(at):
                continue
            values, header, group, records = values.take(pa.array(at)).fill_null(""), header[at], group[at], records[at]
            numbers = numbers.to_numpy(zero_copy_only=False)[at].astype(np.int64)

            sizes, names = pc.binary_length(values).to_numpy(zero_copy_only=False), values.filter(pa.array(header))
            raw = pc.if_else(pa.array(header), "", values).cast(pa.large_binary())
            ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data, ends = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]
            total = lambda marks, ends: np.concatenate([[0], np.cumsum(marks)])[ends]
            if (blank := BLANK[data]).any():
                ends, data = total(~blank, ends), data[~blank]
            wide, letters = np.zeros(len(at), dtype=bool), ends
            if len(data) and data.max() > 127:
                wide, letters = np.diff(total(data > 127, ends)) > 0, total((data & 0xC0) != 0x80, ends)

            names = pc.struct_field(pc.extract_regex(names, r"^>[ \t\x0b\f\r\n]*(?P<id>[^ \t\x0b\f\r\n]+)"), "id").fill_null("")
            named = np.cumsum(header) - 1
            unnamed = np.zeros(len(at), dtype=bool)
            unnamed[header] = pc.equal(names, "").to_numpy(zero_copy_only=False)
            kind = np.select([header & (sizes + 1 > header_bytes), unnamed, (records == 0) & (np.diff(ends) > 0), wide], [1, 2, 3, 4], 0)
            bad = np.flatnonzero(kind)

            part = np.flatnonzero(header | (np.diff(group, prepend=group[0] - 1) != 0))
            faulty = pa.StructArray.from_arrays([pa.array(numbers[bad]), pa.array(LINE_FAULTS, pa.string()).take(pa.array(kind[bad] - 1))], names=["line", "fault"])
            bounds = np.append(part, len(at))
            chunks = pa.StringArray.from_buffers(len(part), pa.py_buffer(ends[bounds].astype(np.int32)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays(
                [
                    files.take(pa.array(at[part])), pa.array(records[part].astype(np.int64)), pa.array(numbers[part]), names.take(pa.array(named[part], mask=~header[part])), chunks,
                    pa.array(np.diff(letters[bounds]).astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.searchsorted(bad, bounds).astype(np.int32)), faulty),
                ],
                names=["file", "record", "line", "seq_id", "chunk", "length", "bad"],
            )

    return ordered.mapInArrow(run, f"file {dict(lines.dtypes)['file']}, record long, line long, seq_id string, chunk string, length long, bad array<struct<line: long, fault: string>>")


def spool_faults(lines: DataFrame, piece: int = PIECE, header_bytes: int = HEADER_BYTES) -> DataFrame:
    """(file, line, record, fault): why files of lines (file, line, value) are no matrices; faults of records are at their header, a file without records has line 0.

    Headers that are too long or have no id, sequence before the first header, letters beyond ASCII, ids that an earlier
    record of the file has, empty records, and records that aren't as long as the first.
    """
    parts = placed_parts(lines, piece, header_bytes)
    by_line = parts.select("file", "record", F.inline("bad")).select("file", "line", "record", "fault")
    records = parts.groupBy("file", "record").agg(F.min("line").alias("line"), F.max("seq_id").alias("seq_id"), F.sum("length").alias("length"))
    earliest = F.min("record").over(Window.partitionBy("file", "seq_id"))
    due = F.sum(F.when(F.col("record") == 1, F.col("length")))
    of_file = parts.groupBy("file").agg(due.alias("due"), F.max("record").alias("most"))
    joined = records.withColumn("earliest", earliest).join(of_file, "file")
    text, own = F.col("length") > 0, F.col("record") > 0
    tests = F.array_compact(F.array(
        F.when(F.col("most") == 0, "no records"), F.when(own & (F.col("seq_id") != "") & (F.col("record") > F.col("earliest")), "id of an earlier record"),
        F.when(own & ~text, "empty record"), F.when(own & text & (F.col("length") != F.col("due")), "not as long as the first record"),
    ))
    by_record = joined.select("file", F.when(own, F.col("line")).otherwise(0).alias("line"), "record", F.explode(tests).alias("fault"))
    return by_line.unionByName(by_record)


def spooled_records(lines: DataFrame, faults: DataFrame, piece: int = PIECE) -> DataFrame:
    """(file, record_order, seq_id, seq) of the files without faults."""
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("line", "chunk")))["chunk"], "")
    records = placed_parts(lines, piece).where("record > 0").groupBy("file", "record").agg(F.max("seq_id").alias("seq_id"), joined.alias("seq"))
    sound = records.join(faults.select("file").distinct(), "file", "left_anti")
    return sound.select("file", (F.col("record") - 1).cast("int").alias("record_order"), "seq_id", F.upper("seq").alias("seq"))
