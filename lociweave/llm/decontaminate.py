"""Benchmark decontamination with an FM-index per shard of the training documents.

A task takes a shard of documents, turns words into ids of the benchmark's vocabulary and indexes the stretches
in which a benchmark phrase can lie; words that no phrase has separate them.  Backward search finds how often
each phrase occurs, sampled suffix positions say where, and overlapping occurrences are merged into spans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.bloom import parted
from lociweave.llm.common import extended, slices, unused, without, written
from lociweave.llm.fm_index import FMIndex

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
ONE_IN = 20
#: Documents whose stretches share an index, and words of a passage beyond the overlap of WINDOW - 1.
SHARD_ROWS, PASSAGE = 2048, 64
#: Benchmark text that a task has at a time (the driver twice that); a larger benchmark is searched for in blocks, one
#: after the other, what each hits written before the next is read.
BLOCK_BYTES = 4 << 20

#: Bytes of words stay, A-Z in lower case, all others become blanks; in UTF-8 every byte beyond ASCII is of a word.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Phrases:
    """The windows of benchmark items as rows of ids, padded on the left, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[start : start + window], set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(x) for x in found], dtype=np.int64)
        self.ids = np.zeros((len(found), window), dtype=np.int64)
        for k, x in enumerate(found):
            self.ids[k, window - len(x) :] = x
        self.shortest = int(self.lengths.min()) if len(found) else 0


def passages(ids: np.ndarray, shortest: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text for the index, the place in ids of each of its symbols): stretches without 0, of at least shortest words, in overlapping passages."""
    edge = np.diff(np.concatenate([[0], (ids != 0).astype(np.int8), [0]]))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    long = end - start >= shortest
    start, end = start[long], end[long]
    # passages of a stretch start PASSAGE apart and overlap by window - 1, so each window lies in one of them whole
    many = np.maximum(1, -(-(end - start - (window - 1)) // PASSAGE))
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(start, many) + nth * PASSAGE
    size = np.minimum(np.repeat(end, many), begin + PASSAGE + window - 1) - begin
    offset = np.cumsum(size + 1) - (size + 1)
    within = np.arange(int((size + 1).sum())) - np.repeat(offset, size + 1)
    place = np.repeat(begin, size + 1) + within
    close = within == np.repeat(size, size + 1)
    text = ids[np.minimum(place, len(ids) - 1)] if len(place) else np.zeros(0, dtype=np.int64)
    text[close] = 0
    return text, place


def occurrences(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place) of every occurrence of a phrase in ids; 0 stands for words that no phrase has."""
    none = np.zeros(0, dtype=np.int64)
    if not phrases.shortest:
        return none, none
    text, place = passages(ids, phrases.shortest, phrases.window)
    if not len(text):
        return none, none
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.ranges(phrases.ids, phrases.lengths)
    many = high - low
    which = np.repeat(np.arange(len(many)), many)
    rows = np.repeat(low, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    where = place[index.locate(rows)]
    # an occurrence in the overlap of two passages is found twice
    both = np.unique(which * (len(ids) + 1) + where)
    return both // (len(ids) + 1), both % (len(ids) + 1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def search(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: the number of words, merged spans of hit words, ids of the items that occur, sorted."""
    parts = [np.fromiter(map(phrases.vocabulary.get, x := words(t), repeat(0)), dtype=np.int32, count=len(x)) for t in texts]
    counts = np.array([len(x) for x in parts], dtype=np.int64)
    first = np.cumsum(counts + 1) - (counts + 1)  # a 0 after each document
    ids = np.zeros(int((counts + 1).sum()), dtype=np.int64)
    for x, at in zip(parts, first, strict=True):
        ids[at : at + len(x)] = x
    which, where = occurrences(ids, phrases)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    row = np.searchsorted(first, where, side="right") - 1
    for r, p, at in zip(row.tolist(), which.tolist(), (where - first[row]).tolist(), strict=True):
        spans.setdefault(r, []).append((at, at + int(phrases.lengths[p])))
        items.setdefault(r, set()).update(phrases.items[p])
    return [(int(n), merged(spans.get(r, [])), sorted(items.get(r, ()))) for r, n in enumerate(counts)]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about block_bytes; the driver has one at a time."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    held = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, math.ceil(held / block_bytes))
    for b in range(blocks):
        yield [(r["item"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]


def with_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, one_in: int = ONE_IN, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs with n_words, n_hit, spans, items and contaminated.

    n_words: words of the whole text; spans: array of (start, end) in words, merged, that occurrences of windows
    cover; n_hit: words in them; items: ids of the items with occurring windows, as sorted strings;
    contaminated: n_hit > 0 and one_in * n_hit >= n_words.  A window has so many consecutive words of an item, or
    all of a shorter one.  Null and empty texts have no words, on either side; a null item id is the empty string;
    an empty benchmark hits nothing.  Rows are never grouped and nothing shuffles; repeated rows give repeated
    results.  Columns of these names in docs are replaced.  A benchmark of several blocks is searched for when this is
    called: documents are written once, and of every block only the rows that it hits.
    """
    out = without(docs, *ADDED)
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _searched(out, text, first, window, one_in)
    # several blocks: documents are written once; a block keeps what it hits, by row, and rows that none hits stay where they lie
    row = unused(out, "__row")
    rows = written(out.withColumn(row, F.monotonically_increasing_id()))
    narrow = rows.select(F.col(row).alias("row"), F.col(f"`{text}`").alias("text"))
    hits = [written(_searched(narrow, "text", block, window, one_in).where("n_hit > 0").select("row", "spans", "items")) for block in chain([first, second], blocks)]
    held = unused(out, "__spans"), unused(out, "__items")
    found = reduce(DataFrame.unionByName, hits).groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("spans")).alias(held[0]), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(held[1]))
    found = written(found)
    passed, suspected = parted(rows, row, written(found.select(row)))
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in held]
    joined = passed.select("*", *none).unionByName(suspected.join(found, row, "left"))
    return _told(joined.select(*[f"`{c}`" for c in (*out.columns, *held)]), text, one_in)


ADDED = {"n_words": "long", "n_hit": "long", "spans": "array<struct<`start`:int,`end`:int>>", "items": "array<string>", "contaminated": "boolean"}


def _columns(found: list[tuple[int, list[tuple[int, int]], list[str]]], one_in: int) -> list[pa.Array]:
    """The added columns of rows with so many words, merged spans and items."""
    hits = [sum(e - s for s, e in spans) for _, spans, _ in found]
    return [
        pa.array([n for n, _, _ in found], pa.int64()),
        pa.array(hits, pa.int64()),
        pa.array([[{"start": s, "end": e} for s, e in spans] for _, spans, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        pa.array([items for _, _, items in found], pa.list_(pa.string())),
        pa.array([h > 0 and one_in * h >= n for h, (n, _, _) in zip(hits, found, strict=True)], pa.bool_()),
    ]


def _searched(docs: DataFrame, text: str, block: list[tuple[str, str | None]], window: int, one_in: int) -> DataFrame:
    """docs with the added columns, by the items of one block."""
    shared, place, schema = docs.sparkSession.sparkContext.broadcast(Phrases(block, window)), docs.columns.index(text), extended(docs, **ADDED)

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SHARD_ROWS):
            found = search(batch.column(place).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(found, one_in)], names=schema.names)

    return docs.mapInArrow(hit, schema)


def _told(joined: DataFrame, text: str, one_in: int) -> DataFrame:
    """Rows with the added columns in place of the last two, spans and items that blocks have found (null: none)."""
    kept = joined.drop(*joined.columns[-2:])
    place, width, schema = kept.columns.index(text), len(kept.columns), extended(kept, **ADDED)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SHARD_ROWS):
            counts = [len(words(t)) for t in batch.column(place).to_pylist()]
            spans = [merged([(s["start"], s["end"]) for s in x or ()]) for x in batch.column(width).to_pylist()]
            items = [x or [] for x in batch.column(width + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *_columns(list(zip(counts, spans, items, strict=True)), one_in)], names=schema.names)

    return joined.mapInArrow(tell, schema)
