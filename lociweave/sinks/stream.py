"""A supermatrix as PHYLIP rows, none of which is ever whole in a task.

A row is as long as all loci together.  Its fragments are put in order by ranges of (taxon, column), and every task
writes those of its range one after the other, so a row may begin in one part and end in another.  The parts, one
after the other, are the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Where the pieces of a row lie before the matrix: nothing sorts before this.
HEAD = -(1 << 62)


def phylip_pieces(matrix: DataFrame, taxa: DataFrame, parts: DataFrame, gap: str = " ") -> DataFrame:
    """(first_locus, first_record, start, text): in the order of these columns the texts, joined by nothing, are the file.

    matrix: concat.supermatrix(), taxa: concat.taxa(), parts: concat.partitions() of the same records.  The first
    fragment of a row brings the taxon and gap with it, the last one the end of the line; a matrix without columns has
    its dimensions alone.
    """
    sums = parts.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("nchar"))  # one row
    named = taxa.select("taxon", F.col("first.locus").alias("first_locus"), F.col("first.record_order").alias("first_record"))
    placed = matrix.join(named, "taxon").join(F.broadcast(sums), F.lit(True))
    begin = F.when(F.col("start") == 1, F.concat("taxon", F.lit(gap))).otherwise("")
    end = F.when(F.col("end") == F.col("nchar"), "\n").otherwise("")
    pieces = placed.select("first_locus", "first_record", "start", F.concat(begin, "fragment", end).alias("text"))
    dims = taxa.agg(F.count(F.lit(1)).alias("ntax")).join(F.broadcast(sums), F.lit(True))
    head = dims.select(F.lit(HEAD).alias("first_locus"), F.lit(0).alias("first_record"), F.lit(0).cast("long").alias("start"), F.format_string("%d %d\n", "ntax", "nchar").alias("text"))
    return head.unionByName(pieces.withColumn("first_locus", F.col("first_locus").cast("long")).withColumn("first_record", F.col("first_record").cast("int")))


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str | None
    size: int


class PieceWriter(DataSourceArrowWriter):
    """Writes the texts of a task one after the other; a part has its name once all tasks are done."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def _open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        store, folder = self._open()
        task = TaskContext.get()
        path, size = f"{folder}/_temporary/{task.partitionId():07d}-{task.taskAttemptId()}", 0
        out = None
        for batch in iterator:
            if batch.num_rows and out is None:
                store.create_dir(f"{folder}/_temporary", recursive=True)
                out = store.open_output_stream(path)
            for text in batch.column(0):
                if text.is_valid:
                    size += out.write(text.as_buffer())
        if out is not None:
            out.close()
        return _Part(task.partitionId(), path if out is not None else None, size)

    def commit(self, messages: list[_Part | None]) -> None:
        store, folder = self._open()
        store.create_dir(folder, recursive=True)
        old = [f.path for f in store.get_file_info(pyarrow.fs.FileSelector(folder)) if f.base_name.startswith("part-")]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} has parts already")
        for path in old:
            store.delete_file(path)
        parts = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.number)
        for k, part in enumerate(parts):
            store.move(part.path, f"{folder}/part-{k:07d}")
        self.abort(messages)
        with store.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Part | None]) -> None:
        store, folder = self._open()
        if store.get_file_info(f"{folder}/_temporary").type != pyarrow.fs.FileType.NotFound:
            store.delete_dir(f"{folder}/_temporary")


class PieceSink(DataSource):
    """spark.dataSource.register(PieceSink); df.write.format("lociweave-pieces").mode("append").save(path): one column of text, written without separators.

    path: of any store that pyarrow opens from all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "lociweave-pieces"

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        if len(schema.fields) != 1:
            raise ValueError("pieces are one column of text")
        return PieceWriter(self.options["path"], overwrite)


def write_pieces(pieces: DataFrame, path: str, *order: str, text: str = "text", overwrite: bool = False) -> None:
    """Writes pieces in order under path, as part-0000000 and on, which together are the file.  Parts that are there already raise unless overwrite is set."""
    pieces.sparkSession.dataSource.register(PieceSink)
    ranged = pieces.repartitionByRange(*order).sortWithinPartitions(*order).select(text)
    ranged.write.format("lociweave-pieces").mode("overwrite" if overwrite else "append").save(path)
