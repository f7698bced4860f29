"""SimHash near-duplicates by meeting in the middle.

Fingerprints within RADIUS bits of each other share a word that is within half the radius of both.  Every
distinct fingerprint therefore emits all words of its ball of radius 1 (itself and its 64 one-bit variants),
and a shuffle on these words brings linked fingerprints together.  At most 65 distinct fingerprints can share
one word, so no group can grow with the input; copies have been folded into one fingerprint before.

For looser copies, some ten of 64 bits apart, such balls can't be enumerated.  similar_documents() takes a wide
fingerprint of BITS bits and fixed narrow words of its bits; texts that share a word are compared, shingle by
shingle, with one of them that stands for the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociweave.llm.bloom import parted
from lociweave.llm.common import remove, saved, slices, unused, with_groups, written

RADIUS = 2
SHINGLE = 3
SEED = 42

#: Wide fingerprints: words of a shingle, least similarity of a link, bits.
WIDE_SHINGLE, SIMILARITY, BITS = 5, 0.8, 512
#: Narrow words: how many, and the bits of each.  A pair of just that similarity shares one with a probability of 0.98.
WORDS, WORD_BITS = 300, 26
#: Sets from this size on whose fingerprints differ in more than so many bits are never similar.
LARGE, MOST_APART = 256, 190
#: Fingerprints of smaller sets are linked within so many bits: votes of few shingles are often even, and a pair differs in up to 160.
SMALL_APART = 220
#: Nodes whose words are compared within a task before they are shuffled.
TOGETHER = 1024


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 if it has no words."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)])) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long; one row per row of docs."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([simhash(x, size) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    narrow = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(digest, f"id {dict(docs.dtypes)[key]}, fp long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct (a, b), a < b, that connect all fingerprints of nodes (a column fp, distinct) within radius, an even number, of each other.

    Of the fingerprints that share a word each is linked with the next one; all of them lie within radius of each
    other, so the links have the same connected components as all pairs would have.  The ball of half the radius
    has 1, 65, 2081 words for radius 0, 2, 4.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: fingerprints meet in the middle")
    flips = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(64), k)]
    ball = F.array(*[F.col("fp").bitwiseXOR(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")) for m in flips])
    emitted = nodes.select("fp", F.explode(ball).alias("word"))
    before = F.lag("fp").over(Window.partitionBy("word").orderBy("fp"))
    pairs = emitted.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of an edge (a, b): label is the smallest end that can be reached from v.

    Each round takes the smallest label among a vertex and its neighbours and then that label's own label, so
    the rounds grow with the logarithm of the longest chain.  Every round is a written table; those of earlier rounds
    are deleted.  Neither a vertex with many edges nor the label of a giant component is one task's work: such keys are
    few, and what belongs to them goes to their rows.
    """
    spark = edges.sparkSession
    both, held = saved(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")))
    labels, last = saved(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("label"), F.count(F.lit(1)).alias("degree")))
    while True:
        met = with_groups(both, labels.select(F.col("v").alias("w"), "label", "degree"), "w", "degree")
        near = met.groupBy("v").agg(F.min("label").alias("near"))
        lower, between = saved(labels.join(near, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"), "degree"))
        used = lower.groupBy("label").agg(F.count(F.lit(1)).alias("many"))
        jump, steps = saved(used.join(lower.select(F.col("v").alias("label"), F.col("label").alias("next")), "label"))
        moved = with_groups(lower, jump, "label", "many").select("v", F.col("next").alias("label"), "degree", (F.col("next") != F.col("old")).alias("moved"))
        labels, now = saved(moved)
        remove(spark, [last, between, steps])
        last = now
        if labels.where("moved").isEmpty():
            remove(spark, [held])
            return labels.select("v", "label")


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id, times) for every fp of nodes (fp, first, times): the smallest first that edges reach."""
    labels = components(edges)
    nodes = nodes.join(labels, nodes["fp"] == labels["v"], "left").select("fp", "first", "times", F.coalesce("label", "fp").alias("label"))
    nodes = written(nodes)
    least = written(nodes.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    return written(with_groups(nodes, least, "label", "n").select("fp", "component_id", "times"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lowercase hex digits.  component_id: the smallest key among the documents whose fingerprints
    can be reached by links of at most radius differing bits, itself included.  Null and wordless texts have
    fingerprint zero and link like any other; a null key is larger than none, so it is a component_id only where
    all keys are null.  Rows that repeat are returned as often.  Copies, however many, meet as one fingerprint.
    Columns of docs other than key and text aren't read.  Fingerprints, links and components are made and written when
    this is called.
    """
    rows = written(fingerprints(docs, key, text, size))
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")))
    named = _named(nodes, links(nodes, radius))
    return with_groups(rows, named, "fp", "times").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, size: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; one for all words of a shorter text, none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)])) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles], dtype=np.uint64))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """BITS majority bits of a set of shingles; the smallest hash decides where the votes are even."""
    if not len(shingles):
        return bytes(BITS // 8)
    ones = np.zeros(BITS, dtype=np.int64)
    step = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lead = None
    for start in range(0, len(shingles), 255):  # so many votes fit into a byte
        x = shingles[start : start + 255, None] + step  # splitmix64
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        votes = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
        lead = votes[0] if lead is None else lead
        ones += votes.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones + lead > len(shingles)).tobytes()


def wide_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WIDE_SHINGLE) -> DataFrame:
    """(id, fp, n, wide): fp stands for the set of shingles, n is its size, wide its fingerprint as longs; one row per row of docs."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps, sizes, wide = [], [], []
            for t in batch.column(1).to_pylist():
                found = shingle_set(t, size)
                fps.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                wide.append(np.frombuffer(wide_fingerprint(found), dtype=np.int64))
            columns = [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(wide, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "n", "wide"])

    narrow = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(digest, f"id {dict(docs.dtypes)[key]}, fp long, n long, wide array<long>")


def agreement(similarity: float) -> float:
    """The share of bits in which wide fingerprints of two sets of this Jaccard similarity agree."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def word_places(words: int = WORDS, bits: int = WORD_BITS) -> np.ndarray:
    """The places of the bits of each narrow word, one row a word; the same for every table."""
    return np.stack([np.random.default_rng(SEED + k).permutation(BITS)[:bits] for k in range(words)])


def narrow_words(wide: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The words of wide fingerprints, rows of longs: a row a fingerprint, a column a word."""
    bits, weight = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1), 1 << np.arange(places.shape[1], dtype=np.int64)
    return np.stack([(bits[:, p] @ weight) | k << places.shape[1] for k, p in enumerate(places)], axis=1)


def _met(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, leads, pairs) of the nodes of a task: how many others each meets in all its words; per word that is there the (node, word) that leads it, the node with the highest score; and (leader, node, words) of the others."""
    many, wide = words.shape
    _, group, sizes = np.unique(words.ravel(), return_inverse=True, return_counts=True)
    score = (sizes[group] - 1).reshape(many, wide).sum(axis=1)
    node = np.repeat(np.arange(many), wide)
    order = np.lexsort((node, -score[node], group))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    lead = node[order[first]]
    other = lead[group] != node
    pairs, times = np.unique(lead[group[other]] * many + node[other], return_counts=True)
    leads = np.stack([lead, words.ravel()[order[first]]], axis=1)
    return score, leads, np.stack([pairs // many, pairs % many, times], axis=1)


def candidates(nodes: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bits: int = WORD_BITS) -> DataFrame:
    """(a, b, shared), once each: a stands for b in groups of nodes (fp, n, wide) that share a narrow word, in so many of them.

    A group is led by the node that meets most others, so that a family of near copies gathers round few of its
    middle: a group of m nodes makes m - 1 pairs, whatever its size.  Groups are led within a task first, and only the
    leaders are shuffled: a word that many nodes have comes from each TOGETHER nodes once.
    """
    places = word_places(words, bits)
    width = bits + words.bit_length()  # bits of a word with its number
    if width + (words * TOGETHER).bit_length() > 63:
        raise ValueError("so many words of so many bits don't fit")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TOGETHER):
            fp, n = (batch.column(k).to_numpy() for k in (0, 1))
            wide = batch.column(2).flatten().to_numpy().reshape(len(fp), BITS // 64)
            score, leads, pairs = _met(narrow_words(wide, places))
            near = np.minimum(n[pairs[:, 0]], n[pairs[:, 1]]) >= similarity * np.maximum(n[pairs[:, 0]], n[pairs[:, 1]]) - 1e-9
            (a, b, shared), (node, word) = pairs[near].T, leads.T
            yield pa.RecordBatch.from_arrays([pa.array(score[node] << width | word), pa.array(fp[node]), pa.array(np.ones(len(node), dtype=np.int64))], names=["place", "fp", "shared"])
            # a pair is a group of its own, below 0 so as not to be a word's, in which the odd place leads
            own = -2 - 2 * _mixed(fp[a], fp[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((own + 1, own), (fp[a], fp[b]), (shared, shared))], names=["place", "fp", "shared"])

    met = nodes.where("n > 0").select("fp", "n", "wide").mapInArrow(lead, "place long, fp long, shared long")
    group = F.when(F.col("place") < 0, F.shiftright("place", 1)).otherwise(F.col("place").bitwiseAND(F.lit((1 << width) - 1)))
    first = F.first("fp").over(Window.partitionBy("word").orderBy(F.desc("place"), "fp"))
    led = met.withColumn("word", group).select("fp", "shared", first.alias("a"))
    pairs = led.where("a != fp").groupBy("a", F.col("fp").alias("b")).agg(F.sum("shared").alias("shared"))
    return pairs


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """61-bit numbers that tell ordered pairs apart."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(3)).astype(np.int64)


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, small: int = BITS) -> DataFrame:
    """The pairs (a, b, shared) that sizes and, of large sets, wide fingerprints don't rule out.

    Sets of LARGE shingles and more that are just so similar differ in 77 of 512 bits, with a deviation of 8: none
    differs in MOST_APART, fourteen deviations more.  Unlike sets differ in 256.  Smaller sets stay within small bits;
    at BITS theirs decide nothing.
    """
    of = lambda side: nodes.select(F.col("fp").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}"))
    apart = sum((F.bit_count(F.get("wide_a", F.lit(k)).bitwiseXOR(F.get("wide_b", F.lit(k)))) for k in range(BITS // 64)), F.lit(0))
    sizes = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
    near = sizes & (apart <= F.when(F.least("n_a", "n_b") < LARGE, small).otherwise(MOST_APART))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b", "shared")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets (fp, grams, distinct in fp) have at least this Jaccard similarity."""
    one, other = sets.select(F.col("fp").alias("a"), F.col("grams").alias("of_a")), sets.select(F.col("fp").alias("b"), F.col("grams").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    enough = both * (1 + similarity) >= similarity * (F.size("of_a") + F.size("of_b")) - 1e-9
    return pairs.join(one, "a").join(other, "b").where(enough).select("a", "b")


def shingle_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(fp, grams): the shingles of all that pairs (a, b) name; texts that stand for others aren't touched."""
    wanted = written(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
    ids = written(nodes.join(wanted, "fp", "left_semi").select("first"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t, size) for t in batch.column(0).to_pylist()]
            fps = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["fp", "grams"])

    narrow = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    held = parted(narrow, "id", ids)[1].select("text").mapInArrow(grams, "fp long, grams array<long>")
    # keys that pass the filter by chance, or that stand at other texts too, go here
    return written(held.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("grams").alias("grams")))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, component_id) for every row of docs: components of links between texts whose sets of shingles are so similar (Jaccard).

    Every link is one of wide fingerprints within MOST_APART or SMALL_APART bits, and exact.  Words, their number and what is compared don't depend on the number of documents.  A pair can
    be missed if it shares no word, or if neither of it leads a word of both and its leaders link them with nothing;
    tests measure how many are.  Each node is first verified with the leader it meets most often, and then with its other
    leaders in other components; pairs inside a component would change nothing.  Texts with the same set of shingles
    always link, as do all null and wordless texts.  Null and repeated keys, and other columns, are as for
    near_duplicates().
    """
    rows = written(wide_fingerprints(docs, key, text, size))
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("wide").alias("wide")))
    pairs = written(possible(written(candidates(nodes, similarity)), nodes, similarity, SMALL_APART))

    def linked(some: DataFrame) -> DataFrame:
        return written(verified(some, shingle_sets(docs, nodes, some, key, text, size), similarity))

    edges = linked(written(pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))))
    labels = components(edges)
    of = lambda side: labels.select(F.col("v").alias(side), F.col("label").alias(f"label_{side}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
    edges = edges.unionByName(linked(written(apart.select("a", "b"))))
    named = _named(nodes.select("fp", "first", "times"), edges)
    return with_groups(rows.select("id", "fp"), named, "fp", "times").select(F.col("id").alias(key), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay if one document of each component does, the one with the smallest key.

    found: (key, component_id); near_duplicates() if null.  A key with several texts stays if one of them does.
    Documents that no filter suspects of having to go don't move.
    """
    found = near_duplicates(docs, key, text) if found is None else found
    stays = F.bool_or(F.col("key").eqNullSafe(F.col("component_id")))
    gone = found.select(F.col(f"`{key}`").alias("key"), "component_id").groupBy("key").agg(stays.alias("stays")).where("not stays")
    gone = written(gone.select(F.col("key").alias(unused(docs, "__gone"))))
    passed, suspected = parted(docs, key, gone)
    return passed.union(suspected.join(gone, F.col(f"`{key}`").eqNullSafe(F.col(gone.columns[0])), "left_anti"))
