"""Finding the hashes that probably occur twice, without shuffling the rows that have them.

Bloom filters of 64-bit words: a hash picks one word and two bits in it.  Each task packs the places of its hashes
into one row per block of the filter; only these few rows move.  Where a block comes together, counting how often
each bit is set gives both filters at once: bits set at all are the once-seen filter, bits set again are the
twice-seen one.  A hash that occurs twice has both bits in the twice-seen filter, so nothing repeated is ever
missed; a hash that doesn't is taken for repeated only if others share both of its bits.

Filters have a bounded size: hashes are dealt to slices of about SLICE_ROWS rows, one filter after the other is made
and sent to all executors, and its rows are probed where they lie.  A small table is one slice; nothing else changes
with size.  Only functions of Spark SQL are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import saved, unused, written

BITS_PER_ROW = 16
#: Rows that share a filter: its twice-seen part has at most a quarter as many words of 16 bytes.
SLICE_ROWS = 1 << 24
#: Blocks of a filter: the packed rows that a task sends.
BLOCKS = 64
#: Words of the filter over keys in among(): beyond a quarter of so many keys it gets less selective, never larger.
KEY_WORDS = 1 << 20


def words_for(rows: int) -> int:
    return rows * BITS_PER_ROW // 64 + 1


def _word(h: Column, words: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 16), F.lit(words).cast("long"))


def _bits(h: Column) -> tuple[Column, Column]:
    first, second = (F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63)).cast("int") for n in (52, 58))
    return first, second


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _both(h: Column) -> Column:
    first, second = _bits(h)
    return _mask(first).bitwiseOR(_mask(second))


def twice_seen(hashes: DataFrame, h: str, words: int) -> DataFrame:
    """(word, mask): the twice-seen filter over the rows of hashes; words without any bit have no row."""
    size = -(-words // BLOCKS)  # words of a block
    word, (first, second) = _word(F.col(h), words), _bits(F.col(h))
    place = (F.pmod(word, F.lit(size)) * 4096 + first * 64 + second).cast("int").alias("place")  # blocks have at most 2^16 words
    placed = hashes.where(F.col(h).isNotNull()).select(F.floor(word / size).cast("int").alias("block"), place, F.spark_partition_id().alias("task"))
    packed = placed.groupBy("block", "task").agg(F.array_sort(F.collect_list("place")).alias("places"))
    # a place that a task has many times, as of a hash with a third of all rows, counts as two
    packed = packed.select("block", F.filter("places", lambda x, k: (k < 2) | (x != F.get("places", k - 2))).alias("places"))
    # blocks come together here; what follows groups by block and more, so nothing moves again
    each = packed.repartition("block").select("block", F.explode("places").alias("place"))
    bits = F.array_distinct(F.array(F.shiftright("place", 6).bitwiseAND(F.lit(63)), F.col("place").bitwiseAND(F.lit(63))))
    marks = each.select("block", F.floor(F.col("place") / 4096).alias("at"), F.explode(bits).alias("bit"))
    counted = marks.groupBy("block", "at", "bit").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    filled = counted.groupBy("block", "at").agg(F.bit_or(_mask(F.col("bit").cast("int"))).alias("mask"))
    return filled.select((F.col("block").cast("long") * size + F.col("at")).alias("word"), "mask")


def _probed(rows: DataFrame, h: Column, words: int, filled: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean column: whether both bits of h are set in filled (word, mask), which goes to all executors."""
    word, mask = unused(rows, "__word"), unused(rows, "__mask")
    joined = rows.withColumn(word, _word(h, words)).join(F.broadcast(filled.select(F.col("word").alias(word), F.col("mask").alias(mask))), word, "left")
    again = F.coalesce(F.col(mask).bitwiseAND(_both(h)) == _both(h), F.lit(False))
    return joined.withColumn(flag, again).drop(word, mask)


def flagged(rows: DataFrame, h: str, flag: str, only: bool = False) -> DataFrame:
    """rows with a boolean column: whether the hash in column h (a long) may occur more than once; a null hash never does.

    No row moves.  rows should be cheap to read, a written table for instance; so is what is returned.  With only,
    rows that aren't flagged are left out.
    """
    n = rows.count()
    many = max(1, -(-n // SLICE_ROWS))
    words = words_for(-(-n // many))
    slice_ = unused(rows, "__slice")
    if many > 1:
        rows = written(rows.withColumn(slice_, F.coalesce(F.pmod(F.col(h).bitwiseAND(F.lit(65535)), F.lit(many)), F.lit(0)).cast("int")), slice_)
    paths = []
    for k in range(many):
        part = rows.where(F.col(slice_) == k).drop(slice_) if many > 1 else rows
        probed = _probed(part, F.col(h), words, written(twice_seen(part, h, words)), flag)
        kept, path = saved(probed.where(flag) if only else probed)
        paths.append(path)
    return rows.sparkSession.read.schema(kept.schema).parquet(*paths)


def suspects(rows: DataFrame, h: str) -> DataFrame:
    """The rows whose hash in column h may occur more than once."""
    flag = unused(rows, "__again")
    return flagged(rows, h, flag, only=True).drop(flag)


def among(rows: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean column: whether the key may be among keys, a table of one column that is cheap to read.

    A filter over keys decides in place.  It has a bounded size; with many keys more rows than need be are taken for
    possible ones, but none that is among them is missed.
    """
    h = F.xxhash64(F.col(keys.columns[0]))
    words = min(KEY_WORDS, words_for(keys.count()))
    filled = keys.select(_word(h, words).alias("word"), _both(h).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return _probed(rows, F.xxhash64(F.col(f"`{key}`")), words, written(filled), flag)


def parted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key isn't among keys, rows whose key may be), by among(); rows are read twice."""
    flag = unused(rows, "__among")
    marked = among(rows, key, keys, flag)
    return marked.where(~F.col(flag)).drop(flag), marked.where(flag).drop(flag)
