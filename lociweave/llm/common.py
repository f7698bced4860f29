"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, as the contracts spell it: blank and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; only a session on one machine gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Per open tidy() the tables written inside.
_open: list[list[str]] = []


def saved(df: DataFrame, *partition: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(path) if partition else df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, *partition: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, outlives executors and is not computed again."""
    return saved(df, *partition)[0]


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that were written inside; what is to stay is taken off the list."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        remove(spark, _open.pop())


#: A key with more than one in so many rows is hot: there are fewer such keys than this, whatever the input.
HOT_ONE_IN = 1000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined to groups, which has one row a key and in size how many rows the key has.

    Hot keys don't meet in one task: their groups, fewer than HOT_ONE_IN, go to the rows, and no other key has more
    than one in HOT_ONE_IN rows to shuffle.  rows and groups are read twice.
    """
    most = (groups.agg(F.sum(size)).first()[0] or 0) / HOT_ONE_IN
    hot = F.broadcast(groups.where(F.col(size) > most))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) <= most), key)
    return rows.join(hot, key).unionByName(cold)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add under the same names (case aside)."""
    low = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores as no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Arrow bytes that a task turns into Python objects at a time.
SLICE_BYTES = 8 << 20


def give_back() -> None:
    """Returns memory that earlier tasks of a Python worker have freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task never holds Python copies of a whole Arrow batch of long texts."""
    give_back()
    for batch in batches:
        step = max(1, min(rows, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def extended(df: DataFrame, **kinds: str) -> StructType:
    """The schema of df with further columns; a new object, as df caches its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in kinds.items())).fields])
