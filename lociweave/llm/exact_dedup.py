"""Exact deduplication in two passes over Bloom filters, with Spark SQL functions only.

The first pass fills a once-seen and a twice-seen filter with hashes of the normalised texts.  The second probes
the twice-seen filter: rows that it doesn't suspect are kept as they are and never shuffle, the others are
grouped by a full SHA-256.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.bloom import flagged, parted
from lociweave.llm.common import WHITE, unused, with_groups, written


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null as the empty text."""
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def text_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal if they are without white space.  Of equal texts the row with the most code points stays, then
    the one with the smallest key (null before all others), then, of rows that agree in both, just one.  A null
    text counts as empty.  Columns of docs other than key and text aren't read.  Hashes are written and filters made
    when this is called.
    """
    code_points = F.length(F.coalesce(F.col(text), F.lit("")))
    narrow = docs.select(F.col(key).alias("id"), F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256)).alias("digest"), code_points.alias("length"))
    narrow = written(narrow.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("digest")}))
    probed = flagged(narrow, "h", "again")
    alone, suspected = probed.where("not again"), probed.where("again").select("id", "digest", "length", "row")
    rank = F.struct((-F.col("length")).alias("length"), "id", "row")
    groups = written(suspected.groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")))
    grouped = with_groups(suspected, groups, "digest", "n").select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "digest")
    passed = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return passed.union(grouped).select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay; rows that share a key and a text are one document and stay together.

    A key may be null or stand at several texts: each text keeps one document.  Rows whose key no filter suspects of
    having a text that goes don't move.
    """
    at, of = unused(docs, "__gone"), unused(docs, "__digest")
    gone = text_groups(docs, key, text).where(~F.col(key).eqNullSafe(F.col("keep_id"))).select(F.col(key).alias(at), F.col("text_sha256").alias(of)).distinct()
    gone = written(gone)
    passed, suspected = parted(docs, key, gone.select(at))
    own = F.sha2(normalised(F.col(f"`{text}`")).cast("binary"), 256)
    return passed.union(suspected.join(gone, F.col(f"`{key}`").eqNullSafe(F.col(at)) & (own == F.col(of)), "left_anti"))
