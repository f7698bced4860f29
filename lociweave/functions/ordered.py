"""Texts of many rows joined in their order, by aggregates over bounded pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of the order that a piece spans: what one task sorts of a group at a time.
PIECE = 4096


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, separator: str = ";", piece: int = PIECE) -> DataFrame:
    """keys and text: per key the texts that aren't null, joined in the order of an integer column; ties by the text.

    Pieces of a key are put together where they lie, so a key with many rows is no single task's work; only its pieces,
    one row each, meet for the whole text.
    """
    joined = lambda at, what: F.array_join(F.sort_array(F.collect_list(F.struct(at, what)))[what], separator)
    told = df.where(F.col(text).isNotNull()).withColumn("__piece", F.floor(F.col(order) / piece))
    pieces = told.groupBy(*keys, "__piece").agg(joined(order, text).alias("__text"))
    return pieces.groupBy(*keys).agg(joined("__piece", "__text").alias(text))


def leading(df: DataFrame, count: str, key: list[str], k: int | None = None, group: list[str] | None = None) -> DataFrame:
    """df by falling count, then by rising key; the first k of all, or of each group, if k is given.

    key must tell the rows (of a group) apart, so that ties have one order.  With k every task keeps k rows (of a group)
    before anything is shuffled, however many there are.
    """
    order = [F.desc_nulls_last(count), *[F.asc_nulls_last(c) for c in key]]
    if not group:
        ranked = df.orderBy(*order)
        return ranked if k is None else ranked.limit(k)
    if k is None:
        return df.orderBy(*group, *order)
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)
