import hashlib
import random
from collections import defaultdict

import pytest
import xxhash

from lociweave.llm import bloom, exact_dedup, kd_shard, line_dedup, simhash


def docs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def test_twice_seen_misses_nothing(spark):
    from pyspark.sql import functions as F

    once = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    rows = once.union(once.limit(500)).union(spark.createDataFrame([(None,)], "h long"))
    found = bloom.suspects(rows, "h")
    assert 1000 <= found.count() < 2500 and found.groupBy("h").count().where("count > 1").count() == 500


def test_twice_seen_without_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.xxhash64(F.col("id") % 2900).alias("h"))
    want = bloom.suspects(rows, "h").orderBy("h").collect()
    monkeypatch.setattr(bloom, "SLICE_ROWS", rows.count() // 5)
    got = bloom.suspects(rows, "h").orderBy("h").collect()
    repeated = {r["h"] for r in rows.groupBy("h").count().where("count > 1").collect()}
    for found in (want, got):
        assert len(found) >= 200 and repeated <= {r["h"] for r in found}


def _lines(rows):
    holders = defaultdict(set)
    key = lambda x: line_dedup.line_key(x.encode()).decode()
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["A shared line of text", "a SHARED line of text \t", "short", "Ünïcode line İI", " \x0bpadded line here\r", "", "unique éé", "ÀBCDEFGHIJ", "àbcdefghij"]
    rows = [(k, "\n".join(rng.choice(pool) + (str(k) if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 8)))) for k in range(60)]
    rows += [(60, None), (61, ""), (None, pool[0]), (3, rows[3][1]), (62, "long line " * 3000)]
    got = line_dedup.dedup_lines(docs_of(spark, [(*r, "x") for r in rows], ", N_lines string"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    show = lambda x: tuple(repr(v) for v in x)
    assert sorted(show((r[0], r[1] or "", r[2], r[3])) for r in got.collect()) == sorted(map(show, _lines(rows)))
    assert got.where("doc_id = 60").first()["text"] is None
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_exact_groups_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n\x0b\x0c\r", "a b", "ab", "a  b ", "é", "é ", " ", "x" * 5000]
    rows = [(k, rng.choice(texts)) for k in range(80)] + [(5, "a b"), (5, "a b"), (None, "ab")]
    got = exact_dedup.text_groups(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    normal = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(normal(t).encode()).hexdigest()].append((-len(t or ""), i is not None, i or 0, i))
    kept = defaultdict(int)
    for r in got:
        g = groups[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (min(g)[3], len(g))
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    assert exact_dedup.text_groups(docs_of(spark, [])).count() == 0
    assert exact_dedup.keep_first(docs_of(spark, [(1, "a b"), (2, "ab"), (3, "c")])).orderBy("doc_id").collect()[0]["text"] == "a b"


def _fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(3)
    for text in [None, "", " \n", "One", "one two", "É é TWO three", *[" ".join(rng.choice(["a", "B", "c d", "日本"]) for _ in range(n)) for n in range(3, 40)]]:
        assert simhash.simhash(text) == _fingerprint(text)


def test_components_against_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = []
    for b in base:
        for _ in range(rng.randint(1, 12)):
            fps.append(b)
            for _ in range(rng.randint(0, 2)):
                b ^= 1 << rng.randrange(64)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    labels = {r["v"]: r["label"] for r in simhash.components(edges).collect()}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {f: labels.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {r["label"] for r in simhash.components(chain).collect()} == {0}
    assert simhash.components(chain.limit(0)).count() == 0


def test_giant_component_and_hub(spark, monkeypatch):
    """A hub with thousands of edges, a long chain that hangs on it, and small components beside; hot keys are found from the edges alone."""
    rows = [(7, 10_000 + k) for k in range(4000)] + [(k + 1, k) for k in range(200_000, 200_060)] + [(12_000, 200_000)] + [(300_000 + 2 * k, 300_001 + 2 * k) for k in range(300)]
    labels = {r["v"]: r["label"] for r in simhash.components(spark.createDataFrame(rows, "a long, b long").repartition(3)).collect()}
    assert all(label == (v - v % 2 if v >= 300_000 else 7) for v, label in labels.items()) and len(labels) == 4001 + 61 + 600
    hot = simhash.with_groups(spark.createDataFrame([(1,)] * 5000 + [(2,)], "k long"), spark.createDataFrame([(1, 5000), (2, 1)], "k long, n long"), "k", "n")
    assert hot.count() == 5001 and "BroadcastHashJoin" in hot._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    long = [rng.choice(words) for _ in range(3000)]
    near = long.copy()
    near[1500] = "changed"
    rows = [(9, " ".join(long)), (4, " ".join(near)), (7, " ".join(long)), (1, "something else"), (2, None), (3, ""), (8, "   ")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {9: 4, 4: 4, 7: 4, 1: 1, 2: 2, 3: 2, 8: 2}
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs_of(spark, rows)).collect()) == [1, 2, 4]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_shards(spark):
    rng = random.Random(6)
    rows = [(k, "x" * rng.randint(0, 300), rng.choice(["en", None]), "src0" if rng.random() < 0.4 else f"src{rng.randint(1, 9)}") for k in range(6000)]
    rows += [(1, None, None, None), (None, "é", "en", "src0"), (2, rows[2][1], rows[2][2], rows[2][3])]
    got = kd_shard.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) == set(range(40)) and set(got["law"]) == {"bytes"}
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() / sizes.mean() < 1.05 and sizes.min() / sizes.mean() > 0.95
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert got["size"].sum() == sum(len((r[1] or "").encode()) + 16 for r in rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", "s")], [(k, "same", "en", "s") for k in range(100)]])
def test_few_or_equal_rows(spark, rows):
    got = kd_shard.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert len(got) == len(rows) and got["shard"].between(0, 39).all()
    if len(rows) == 100:
        assert got.groupby("shard").size().max() <= 4


def test_shards_follow_from_the_rows_alone(spark):
    """Other partitions and another order give the same shards and slots; equal texts stay together; brute force finds the balance."""
    rng = random.Random(8)
    schema = "doc_id long, text string, lang string, source string, Size string, shard int"
    texts = ["x" * rng.randint(0, 400) + str(k) for k in range(700)]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b"]), "s", 1) for k in range(900)]
    rows += [(5, "again", "en", "a", None, None)] * 40 + [(None, None, None, None, None, None)] * 3 + [(9000 + k, "hot", "en", "a", "s", 1) for k in range(400)]
    docs = spark.createDataFrame(rows, schema)
    show = lambda df: sorted(tuple(map(repr, r)) for r in df.collect())
    found = kd_shard.shard(docs)
    assert show(found) == show(kd_shard.shard(docs.orderBy(docs["text"].desc()).repartition(7)))
    at = defaultdict(set)
    text_of = {r[0]: r[1] for r in rows}
    for r in found.collect():
        at[text_of[r["doc_id"]] if r["doc_id"] != 5 or r["size"] != 21 else "again"].add(r["shard"])
    assert sum(len(x) - 1 for t, x in at.items() if t != "hot") <= 39 and len(at["hot"]) > 1
    sizes = found.groupBy("shard").agg({"size": "sum"}).toPandas().iloc[:, 1]
    assert sizes.max() - sizes.min() <= 3 * 420


def _jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_documents(spark):
    """Near copies far beyond two bits link from a Jaccard similarity of 0.8 on and not below; every second key is larger."""
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(60):
        a = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(60, 600))]
        b = a.copy()
        for at in rng.sample(range(len(a)), max(1, len(a) // (90 if k % 2 else 12))):
            b[at] = "changed"
        a, b = " ".join(a), " ".join(b)
        j = _jaccard(a, b)
        assert j >= 0.85 if k % 2 else j < 0.8
        rows += [(2 * k, a), (2 * k + 1, b)]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if j >= 0.8 else 2 * k + 1}
    rows += [(900, None), (901, "  "), (902, rows[0][1].upper()), (None, "of no key"), (903, "four words of text"), (904, "Four words\nof text")]
    want |= {900: 900, 901: 900, 902: 0, None: None, 903: 903, 904: 903}
    docs = docs_of(spark, rows)
    found = simhash.similar_documents(docs)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs, found=found).where("doc_id is not null").collect()) == sorted({v for v in want.values() if v is not None})
    assert simhash.similar_documents(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_recall_of_similar_documents(spark, sf):
    """All pairs of a document whose key is divisible by 20 with any other, by their sets; linked ones must be in one component, and no component may lack links."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    sets = {r["doc_id"]: set(simhash.shingle_set(r["text"]).tolist()) for r in docs.collect()}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    pairs = [(a, b) for a in sets if a % 20 == 0 for b in sets if a != b and alike(a, b)]
    assert pairs and sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    groups = defaultdict(list)
    for i, c in found.items():
        groups[c].append(i)
    for g in groups.values():
        reached, left = {g[0]}, [g[0]]
        while left:
            a = left.pop()
            new = [b for b in g if b not in reached and alike(a, b)]
            reached.update(new)
            left += new
        assert reached == set(g)


def test_one_family_gathers_round_few_leaders(spark, monkeypatch):
    """A family makes fewer pairs than its words have members, whether its words meet in one task or are shuffled."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 700, dtype=np.uint64)
    rows = []
    for k in range(400):
        own = base.copy()
        own[rng.choice(700, 30, replace=False)] = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
        rows.append((k, 700, np.frombuffer(simhash.wide_fingerprint(np.unique(own)), dtype=np.int64).tolist()))
    nodes = spark.createDataFrame(rows, "fp long, n long, wide array<long>").repartition(5)
    for together in (4096, 7):
        monkeypatch.setattr(simhash, "TOGETHER", together)
        pairs = [tuple(r) for r in simhash.candidates(nodes).collect()]
        assert len({p[:2] for p in pairs}) == len(pairs) < 400 * 399 / 4
        reached, left = {0}, [0]
        near = defaultdict(set)
        for a, b, _ in pairs:
            near[a].add(b)
            near[b].add(a)
        while left:
            new = near[left.pop()] - reached
            reached |= new
            left += new
        assert reached == set(range(400))


def test_what_sizes_and_bits_rule_out(spark):
    """Sets of 256 shingles at a similarity of just 0.8 stay far below the bits that rule a pair out, and unlike ones far above; small sets are ruled out by size alone."""
    import numpy as np

    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 62, n, dtype=np.uint64)
    wide = lambda x, kind=np.int64: np.frombuffer(simhash.wide_fingerprint(np.unique(x)), dtype=kind)
    apart = lambda x, y: int(np.bitwise_count(wide(x, np.uint64) ^ wide(y, np.uint64)).sum())
    near, far = [], []
    for _ in range(200):
        both = draw(256)
        near.append(apart(np.concatenate([both, draw(32)]), np.concatenate([both, draw(32)])))
        far.append(apart(draw(288), draw(288)))
    assert max(near) < 130 < simhash.MOST_APART < 205 < min(far)
    x, y = wide(draw(9)).tolist(), wide(draw(9)).tolist()
    nodes = spark.createDataFrame([(1, 100, x), (2, 90, y), (3, 70, x), (4, 300, x), (5, 300, y), (6, 300, x)], "fp long, n long, wide array<long>")
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (4, 5, 1), (4, 6, 1)], "a long, b long, shared long")
    assert {tuple(r)[:2] for r in simhash.possible(pairs, nodes).collect()} == {(1, 2), (4, 6)}


def test_radius_and_shingle_size(spark):
    nodes = spark.createDataFrame([(0,), (0b1111,), (1 << 40,)], "fp long")
    assert [tuple(r) for r in simhash.links(nodes, 4).where("a = 0 and b = 15").collect()] == [(0, 15)]
    assert {tuple(r) for r in simhash.links(nodes).collect()} == {(0, 1 << 40)} and simhash.links(nodes, 0).count() == 0
    with pytest.raises(ValueError):
        simhash.links(nodes, 3)
    got = simhash.fingerprints(docs_of(spark, [(1, "a b c d e f g")]), size=5).first()["fp"]
    assert got & (2**64 - 1) == simhash.simhash("a b c d e f g", 5) != simhash.simhash("a b c d e f g")


def _leaves(rows, shards, first=0, widths=None):
    """Row number to shard: nodes split one by one, each sorted whole along its widest dimension and cut where the bytes below come nearest to its share."""
    if shards == 1 or not rows:
        return {k: first for k, _, _ in rows}
    spans = [(min(r[2][d] for r in rows), max(r[2][d] for r in rows)) for d in range(len(rows[0][2]))]
    widths = widths or [max(1, hi - lo) for lo, hi in spans]
    d = max(range(len(spans)), key=lambda d: (spans[d][1] - spans[d][0]) / widths[d])
    half = shards // 2
    share, below = sum(r[1] for r in rows) * half / shards, 0
    for key in sorted({r[2][d] for r in rows}):
        held = sum(r[1] for r in rows if r[2][d] == key)
        if below + held >= share:
            cut = key + 1 if below + held - share < share - below else key
            break
        below += held
    low, high = [r for r in rows if r[2][d] < cut], [r for r in rows if r[2][d] >= cut]
    return _leaves(low, half, first, widths) | _leaves(high, shards - half, first + half, widths)


@pytest.mark.parametrize("shards", [2, 5, 12])
def test_trees_against_brute_force(spark, shards):
    rng = random.Random(shards)
    for n, spread in ((0, 9), (1, 9), (40, 3), (400, 1 << 40), (400, 6)):
        rows = [(k, rng.choice([17, 90, 300, 5000]), [rng.randrange(spread), rng.randrange(2), rng.randrange(spread * 3)]) for k in range(n)]
        df = spark.createDataFrame([(k, size, *keys) for k, size, keys in rows], "k long, size long, key0 long, key1 long, key2 long")
        root = kd_shard.tree(df, 3, shards)
        placed = df.select("k", root.leaf_of([df[f"key{d}"] for d in range(3)], lambda x: x.first).alias("shard"))
        assert {r["k"]: r["shard"] for r in placed.collect()} == _leaves(rows, shards)


def test_fingerprints_of_small_sets_link_within_a_radius(spark):
    """Pairs of small sets, too, are linked by the bits of their fingerprints: near ones of any size stay, unlike ones go before shingles are compared."""
    import numpy as np

    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 62, n, dtype=np.uint64)
    rows, near, far = [], [], []
    for k, (both, own) in enumerate([(5, 1), (7, 1), (8, 2), (40, 10), (100, 20)] * 40):
        x = draw(both)
        for fp, shingles in ((3 * k, x), (3 * k + 1, np.concatenate([x, draw(own)])), (3 * k + 2, draw(both))):
            rows.append((fp, len(shingles), np.frombuffer(simhash.wide_fingerprint(np.unique(shingles)), dtype=np.int64).tolist()))
        near.append((3 * k, 3 * k + 1))
        far.append((3 * k, 3 * k + 2))
    nodes = spark.createDataFrame(rows, "fp long, n long, wide array<long>")
    pairs = spark.createDataFrame([(a, b, 1) for a, b in near + far], "a long, b long, shared long")
    got = {tuple(r)[:2] for r in simhash.possible(pairs, nodes, small=simhash.SMALL_APART).collect()}
    assert set(near) <= got and len(got & set(far)) <= 4
