"""Shards of near equal bytes from a k-d tree over metadata, with Spark SQL functions only.

A node that is to become several shards is split along its widest dimension at the key below which its share of
the bytes lies.  All nodes of a level are split at once: one pass adds up bytes in about a thousand cells of every
dimension of every node, which tells how wide its dimensions are and in which cell the weighted quantile lies, and
further passes look only into cells that are too heavy to be cut beside.  The driver sees cells only: their number
depends on how many shards are wanted and not on the rows.

Everything follows from the rows themselves, however they are partitioned: ties are told apart by hashes of text and
key and by a number among rows that agree in both, which may stand for each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociweave.llm.bloom import parted
from lociweave.llm.common import with_groups, written

SHARDS = 40
CELLS = 1024
#: A cut is taken when the cell that holds it has less than this share of the node's bytes.
TOLERANCE = 2e-4
#: Rows that one task numbers, and the most parts a shard is numbered in.
CHUNK_ROWS, MOST_CHUNKS = 20_000, 4096
#: Copies of a row that are made in one piece.
PIECE = 65_536
#: Bits of a key: of the coordinate (of 31, the upper ones), of the text's hash, and of the row's.
COORDINATE, TEXT, ROW = 23, 24, 16


@dataclass
class Node:
    first: int  # shard
    shards: int
    bounds: list[tuple[int, int]]  # least and largest key in each dimension
    dimension: int = 0
    cut: int = 0
    children: list["Node"] = field(default_factory=list)

    def leaf_of(self, keys: list[Column], value) -> Column:
        """What value() says of the leaf that a row belongs to."""
        if not self.children:
            return F.lit(value(self))
        left, right = self.children
        return F.when(keys[self.dimension] < F.lit(self.cut), left.leaf_of(keys, value)).otherwise(right.leaf_of(keys, value))

    def leaves(self) -> list["Node"]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]

    def split(self, dimension: int, cut: int, bounds: list[tuple[int, int]]) -> None:
        self.dimension, self.cut, half = dimension, cut, self.shards // 2
        lower, upper = list(bounds), list(bounds)
        lower[dimension], upper[dimension] = (bounds[dimension][0], cut - 1), (cut, bounds[dimension][1])
        self.children = [Node(self.first, half, lower), Node(self.first + half, self.shards - half, upper)]


def metadata_coordinates() -> dict[str, Column]:
    """Non-negative 31-bit coordinates of documents: language and source by hash, size by its logarithm."""
    return {
        "lang": F.shiftright(F.crc32(F.coalesce("lang", F.lit("")).cast("binary")), 1),
        "source": F.shiftright(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), 1),
        "size": F.floor(F.log2(F.col("size")) * (1 << 25)).cast("long"),
    }


def _cells(rows: DataFrame, root: Node, spans: dict[int, list[tuple[int, int, int]]], dimensions: int) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """By node (its first shard) and dimension: (cell, bytes, least key, largest key), sorted; spans: (dimension, least, largest key) to cut into cells."""
    keys, place = [F.col(f"key{d}") for d in range(dimensions)], {n: k for k, n in enumerate(spans)}
    most = max(map(len, spans.values()))
    padded = [x + [(-1, 0, 0)] * (most - len(x)) for x in spans.values()]
    placed = rows.withColumn("node", root.leaf_of(keys, lambda x: place.get(x.first, -1))).where("node >= 0")
    at = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("node"))
    each = F.array(*[F.struct(at([x[j][0] for x in padded]).alias("d"), at([x[j][1] for x in padded]).alias("lo"), at([x[j][2] for x in padded]).alias("hi"), at([max(1, -(-(x[j][2] - x[j][1] + 1) // CELLS)) for x in padded]).alias("step")) for j in range(most)])
    out = placed.select("node", "size", F.array(*keys).alias("keys"), F.explode(each).alias("x")).where("x.d >= 0")
    out = out.select("node", "size", "x.d", "x.lo", "x.hi", "x.step", F.get("keys", F.col("x.d").cast("int")).alias("key")).where("key between lo and hi")
    found: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    names = list(spans)
    for r in out.groupBy("node", "d", F.expr("(key - lo) div step").alias("cell")).agg(F.sum("size").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most")).collect():
        found.setdefault((names[r["node"]], r["d"]), []).append((r["cell"], r["bytes"], r["least"], r["most"]))
    return {k: sorted(v) for k, v in found.items()}


def tree(rows: DataFrame, dimensions: int, shards: int) -> Node:
    """rows: size and key0, key1, ..., cheap to read again and again."""
    root, widths = Node(0, shards, [(0, (1 << (COORDINATE + TEXT + ROW)) - 1)] * dimensions), []
    while nodes := {x.first: x for x in root.leaves() if x.shards > 1}:
        found = _cells(rows, root, {n: [(d, *x.bounds[d]) for d in range(dimensions)] for n, x in nodes.items()}, dimensions)
        search: dict[int, tuple[int, float, int, list[tuple[int, int]]]] = {}  # by node: dimension, bytes below the cut, all bytes, exact bounds
        for n, x in nodes.items():
            if (n, 0) not in found:
                x.split(0, x.bounds[0][0], x.bounds)  # no rows
                continue
            bounds = [(found[n, d][0][2], found[n, d][-1][3]) for d in range(dimensions)]
            widths = widths or [max(1, hi - lo) for lo, hi in bounds]
            dimension = max(range(dimensions), key=lambda d: (bounds[d][1] - bounds[d][0]) / widths[d])
            whole = sum(c[1] for c in found[n, dimension])
            search[n] = dimension, whole * (x.shards // 2) / x.shards, whole, bounds
        while search:
            spans: dict[int, list[tuple[int, int, int]]] = {}
            for n, (dimension, share, whole, bounds) in list(search.items()):
                below = 0
                for _, held, least, most in found[n, dimension]:
                    if below + held >= share:
                        break
                    below += held
                if least == most or held <= TOLERANCE * whole:
                    nodes[n].split(dimension, most + 1 if below + held - share < share - below else least, bounds)
                    del search[n]
                else:
                    spans[n], search[n] = [(dimension, least, most)], (dimension, share - below, whole, bounds)
            found = _cells(rows, root, spans, dimensions) if spans else {}
    return root


def _points(sized: DataFrame, coordinates: list[str]) -> DataFrame:
    """id, size, crc, th and coordinates of every row, with a number among rows that agree in key and text; the coordinates of equal texts are their least."""
    points = written(sized.groupBy("id", "th", "size", "crc", *coordinates).agg(F.count(F.lit(1)).alias("times")))
    ends = points.groupBy("th").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in coordinates for f in (F.min, F.max)])
    mixed = written(ends.where(" or ".join(f"min_{c} < max_{c}" for c in coordinates)).select("th"))
    same, maybe = parted(points, "th", mixed)
    maybe = written(maybe)
    groups = written(maybe.groupBy("th").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in coordinates]))
    points = same.unionByName(with_groups(maybe.drop(*coordinates), groups, "th", "n").drop("n"))
    once = points.where("times = 1").drop("times").withColumn("nth", F.lit(0).cast("long"))
    pieces = points.where("times > 1").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / PIECE))))
    last = F.least(F.col("times"), (F.col("piece") + 1) * PIECE) - 1
    again = pieces.repartition("id", "th", "piece").withColumn("nth", F.explode(F.sequence(F.col("piece") * PIECE, last)))
    return once.unionByName(again.drop("times", "piece"))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, coordinates: dict[str, Column] | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    size: the UTF-8 bytes of the text (a null text has none) and 16.  law: "bytes", the sizes of shards are near
    equal; a single row is never divided, so a table of few or very long rows comes out less even.  slot: gapless
    from 0 in every shard.  coordinates: non-negative 31-bit longs over the columns of docs and size.  Groups are
    equal texts: they take the least coordinates that one of them has and so stay together, except that a cut, of
    which there are one less than shards, may go through a group, as it must through one with a third of all rows.
    The same rows give the same shards and slots however they are partitioned.  Repeated rows and null keys are rows
    like any other.  The tree is built, over a narrow table that is written, when this is called.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sized = docs.withColumn("size", (F.octet_length(content) + 16).cast("long"))
    coordinates = coordinates or {k: v for k, v in metadata_coordinates().items() if k == "size" or k in docs.columns}
    names = [f"c{d}" for d in range(len(coordinates))]
    narrow = sized.select(F.col(f"`{key}`").alias("id"), "size", F.crc32(content.cast("binary")).alias("crc"), F.xxhash64(content).alias("th"), *[c.cast("long").alias(n) for n, c in zip(names, coordinates.values(), strict=True)])
    h = F.xxhash64("id", "th", "nth")
    tie = F.shiftleft(F.shiftrightunsigned("th", 64 - TEXT), ROW) + F.shiftrightunsigned(h, 64 - ROW)
    keys = [(F.shiftleft(F.shiftright(n, 31 - COORDINATE), TEXT + ROW) + tie).alias(f"key{d}") for d, n in enumerate(names)]
    rows = written(_points(narrow, names).select("id", "size", "crc", "th", h.alias("h"), *keys))
    root = tree(rows, len(keys), shards)
    placed = rows.select("id", "size", "crc", "th", "h", root.leaf_of([F.col(f"key{d}") for d in range(len(keys))], lambda x: x.first).cast("int").alias("shard"))
    chunks = min(MOST_CHUNKS, max(16, rows.count() // (shards * CHUNK_ROWS)))
    placed = placed.withColumn("chunk", F.pmod("h", F.lit(chunks)).cast("int"))
    # at most shards * MOST_CHUNKS rows: a bound that no input exceeds
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")
    offsets = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n")).select("shard", "chunk", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("h", "id", "th")) - 1
    numbered = placed.withColumn("within", within).join(F.broadcast(offsets), ["shard", "chunk"])
    return numbered.select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
