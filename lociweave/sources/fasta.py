"""Sequence files as a Spark data source with explicit record order.

    spark.dataSource.register(FastaDataSource)
    spark.read.format("lociweave-fasta").load("/loci/*.fasta")

A file is one partition: the order of its records and lines that belong together need one reader, and loci are many.
Files are listed and opened through Spark's binaryFile reader in records_from_files, for stores that only Spark
reads; the data source opens paths that executors see themselves, plain or gzip.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, file_order int, record_order int, seq_id string, seq string"


def parse(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(id, sequence) of FASTA lines: the id is the first word of the header, white space in sequences goes."""
    name, parts = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts)
            name, parts = (line[1:].split() or [""])[0], []
            if not name:
                raise ValueError("empty sequence identifier")
        elif line.strip():
            if name is None:
                raise ValueError("sequence before the first header")
            parts.append("".join(line.split()))
    if name is not None:
        yield name, "".join(parts)


class _File(InputPartition):
    def __init__(self, path: str, order: int):
        super().__init__((path, order))
        self.path, self.order = path, order


class FastaReader(DataSourceReader):
    def __init__(self, path: str):
        self.files = [p for x in path.split(",") for p in sorted(glob.glob(os.path.join(x, "*") if os.path.isdir(x) else x)) if os.path.isfile(p)]
        if not self.files:
            raise ValueError(f"no sequence files in {path}")

    def partitions(self) -> list[_File]:
        return [_File(p, k) for k, p in enumerate(self.files)]

    def read(self, partition: _File) -> Iterator[tuple]:
        opener = gzip.open if partition.path.endswith(".gz") else open
        with opener(partition.path, "rt", encoding="utf-8") as lines:
            for k, (name, seq) in enumerate(parse(lines)):
                yield partition.path, partition.order, k, name, seq


class FastaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lociweave-fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options["path"])


def records_from_files(spark: SparkSession, path: str, ends: tuple[str, ...] = ()) -> DataFrame:
    """(file, record_order, seq_id, seq) by Spark's own file reader, from any store; .gz files are unpacked.

    ends: of the names of files that are read, in any case; all if there are none.
    """

    def read(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                content = gzip.decompress(content) if file.endswith(".gz") else content
                rows += [(file, k, name, seq) for k, (name, seq) in enumerate(parse(io.StringIO(content.decode())))]
            yield pd.DataFrame(rows, columns=["file", "record_order", "seq_id", "seq"])

    files = spark.read.format("binaryFile").load(path)
    if ends:
        files = files.where(F.col("path").rlike("(?i)(" + "|".join(e.replace(".", r"\.") for e in ends) + ")$"))
    files = files.select("path", "content")
    return files.mapInPandas(read, "file string, record_order int, seq_id string, seq string")


def alignment_faults(records: DataFrame, codon: bool = False) -> DataFrame:
    """(locus, fault): loci that are no alignment: duplicate or unequal records, empty ones, lengths not divisible by three."""
    n = F.length("seq")
    seen = records.groupBy("locus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seq_id").alias("ids"), F.min(n).alias("least"), F.max(n).alias("most")
    )
    fault = F.when(F.col("ids") < F.col("n"), "duplicate ids").when(F.col("most") == 0, "empty").when(F.col("least") != F.col("most"), "unequal lengths")
    if codon:
        fault = fault.when(F.col("most") % 3 != 0, "length is not divisible by three")
    return seen.select("locus", fault.alias("fault")).where("fault is not null")


def input_faults(records: DataFrame, seqtype: str = "codon") -> DataFrame:
    """(locus, fault): unaligned input that can't be aligned: fewer than two records, duplicate ids, empty ones, letters outside the alphabet."""
    letters = "ACDEFGHIKLMNPQRSTVWYBXZJUO*-" if seqtype == "prot" else "ACGTURYSWKMBDHVN?" + ("-" if seqtype == "nucl" else "")
    seen = records.groupBy("locus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seq_id").alias("ids"), F.min(F.length("seq")).alias("least"), F.bool_or(F.translate(F.upper("seq"), letters, "") != "").alias("odd")
    )
    fault = F.when(F.col("n") < 2, "fewer than two records").when(F.col("ids") < F.col("n"), "duplicate ids").when(F.col("least") == 0, "empty sequence").when(F.col("odd"), "invalid characters")
    return seen.select("locus", fault.alias("fault")).where("fault is not null")
