"""Line deduplication with a once-seen and a twice-seen Bloom filter.

The narrow table of line digests never shuffles: it fills the filters and is then probed in place.  Only lines that
the twice-seen filter suspects go through a shuffle, where their digests are counted exactly and the smallest
document that has them is chosen.  Only texts of documents that lose lines are shuffled, to meet these lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.bloom import parted, suspects
from lociweave.llm.common import WHITE, extended, slices, unused, with_groups, without, written

MIN_LENGTH = 10
_WHITE = WHITE.encode()


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased; line in UTF-8."""
    return line.strip(_WHITE).lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def line_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, digest, h): one row per document and line key of at least min_length code points; 128 bits of SHA-256, h the first 64."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, digests = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                if value:
                    keys = {k for k in map(line_key, value.encode().split(b"\n")) if len(k) >= min_length and _code_points(k) >= min_length}
                    at += [i] * len(keys)
                    digests += map(_digest, keys)
            hs = [int.from_bytes(d[:8], "big", signed=True) for d in digests]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(digests, pa.binary()), pa.array(hs, pa.int64())], names=["id", "digest", "h"])

    narrow = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(cut, f"id {dict(docs.dtypes)[key]}, digest binary, h long")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(id, drops): for each document the digests of the lines that a smaller document has as well."""
    suspected = suspects(lines, "h").select("id", "digest")
    shared = suspected.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("digest", "first", "n")
    later = with_groups(suspected, written(shared), "digest", "n").where("id > first")
    return later.groupBy("id").agg(F.collect_set("digest").alias("drops"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """docs with repeated lines taken out of the text, and n_lines (before) and n_dropped.

    Texts are cut at \\n.  A line whose key has at least min_length code points and is found in two or more
    documents stays only in the one with the smallest key among them, there as often as it occurs; a document is
    what shares a key, however many rows.  Rows with a null key keep all their lines and count for no other row.
    A null or empty text is one empty line; a null text stays null.  Columns named n_lines or n_dropped in docs
    are replaced.  Texts of documents that lose nothing don't move.  Lines are found and written when this is called.
    """
    docs = without(docs, "n_lines", "n_dropped")
    drops = written(repeated_lines(written(line_digests(docs, key, text, min_length))))
    whole, cut = parted(docs, key, drops.select("id"))
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    whole = whole.withColumns({"n_lines": lines.cast("long"), "n_dropped": F.lit(0).cast("long")})
    at, gone = unused(docs, "__id"), unused(docs, "__drops")
    joined = cut.join(drops.select(F.col("id").alias(at), F.col("drops").alias(gone)), F.col(f"`{key}`") == F.col(at), "left").drop(at)
    schema = extended(docs, n_lines="long", n_dropped="long")
    place, width = docs.columns.index(text), len(docs.columns)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts, dropped = [], [], []
            for value, lost in zip(batch.column(place).to_pylist(), batch.column(width).to_pylist(), strict=True):
                lines = (value or "").encode().split(b"\n")
                counts.append(len(lines))
                if lost:
                    lost = set(lost)
                    kept = [x for x in lines if len(k := line_key(x)) < min_length or _digest(k) not in lost]
                    value = b"\n".join(kept).decode()
                    dropped.append(len(lines) - len(kept))
                else:
                    dropped.append(0)
                texts.append(value)
            columns = batch.columns[:width]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return whole.union(joined.mapInArrow(rebuild, schema))
