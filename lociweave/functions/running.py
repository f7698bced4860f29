"""Running totals over a whole table without a single-task window over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a range that one task goes through, and the most ranges: their totals pass through one window.
BUCKET, RANGES = 50_000, 4096


def _range_of(order: Column, quantiles: Column) -> Column:
    """How many of RANGES - 1 sorted quantiles are at most order: a binary search within the row."""
    step = lambda at, s: F.when(F.coalesce(F.get(quantiles, at + s - 1) <= order, F.lit(False)), at + s).otherwise(at)
    return F.aggregate(F.lit([1 << k for k in range((RANGES - 1).bit_length() - 1, -1, -1)]), F.lit(0), step)


def running_before(df: DataFrame, order: str, value: str, before: str, bucket: int = BUCKET) -> DataFrame:
    """df with the sum of value over all rows of smaller order; order is a unique integer, dense or not.

    Quantiles of order deal the rows to ranges of about bucket rows; rows are added up within ranges, and only the
    ranges, at most RANGES rows, pass through one window.
    """
    quantiles = F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 10 * RANGES)
    dealt = df.agg(F.least(F.lit(RANGES), F.ceil(F.count(order) / bucket)).alias("__many"), quantiles.alias("__quantiles"))  # one row
    at = F.floor(_range_of(F.col(order), F.col("__quantiles")) * F.col("__many") / RANGES)
    placed = df.join(F.broadcast(dealt), F.lit(True)).withColumn("__range", at).drop("__many", "__quantiles")
    totals = placed.groupBy("__range").agg(F.sum(value).alias("__sum"))
    offsets = totals.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__offset"))
    within = F.sum(value).over(Window.partitionBy("__range").orderBy(order)) - F.col(value)
    joined = placed.withColumn("__within", within).join(F.broadcast(offsets), "__range")
    return joined.withColumn(before, (F.col("__offset") + F.col("__within")).cast("long")).drop("__range", "__offset", "__within")


def numbered(df: DataFrame, order: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """df with a gapless number from 0 in the order of a unique integer column."""
    return running_before(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", name, bucket).drop("__one")
