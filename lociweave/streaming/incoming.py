"""Quality control of loci as their files arrive.

A locus is judged by its own records alone, so each micro-batch of files can be; what needs all loci, such as a
supermatrix, stays a batch job over the table that this stream fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lociweave.functions.sequences import locus_key
from lociweave.operators.qc import Gate, qc_gate
from lociweave.sources.fasta import parse


def arriving_records(spark: SparkSession, folder: str, glob: str = "*.fasta") -> DataFrame:
    """A stream of (locus, record_order, seq_id, seq), one file after the other."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)

    def read(batches):
        import io

        import pandas as pd

        for pdf in batches:
            rows = [(p, k, n, s) for p, c in zip(pdf["path"], pdf["content"], strict=True) for k, (n, s) in enumerate(parse(io.StringIO(c.decode())))]
            yield pd.DataFrame(rows, columns=["file", "record_order", "seq_id", "seq"])

    records = files.select("path", "content").mapInPandas(read, "file string, record_order int, seq_id string, seq string")
    return records.select(locus_key(F.col("file")).alias("locus"), "record_order", "seq_id", "seq")


def judge_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, gate: Gate = Gate()) -> StreamingQuery:
    """Appends the gate's verdict on every arriving locus to the Parquet table out, each micro-batch in a folder of its own so that a repeated one replaces itself."""

    def judge(batch: DataFrame, batch_id: int) -> None:
        qc_gate(batch, gate).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return arriving_records(spark, folder).writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
