import hashlib
import os
import re
from collections import defaultdict

import duckdb
import pytest
import tiktoken
import tiktoken.load

import corpus_pipeline
from lociweave.llm import bpe_prefix, queries, toxicity
from lociweave.llm.common import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def _without_repeats(rows):
    """Lines of ten characters and more stay in the smallest document that has them."""
    keys = lambda t: [_lower(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")]
    first = {}
    for i in sorted(rows):
        for k in keys(rows[i]):
            first.setdefault(k, i)
    return {i: "\n".join(x for x, k in zip(t.split("\n"), keys(t), strict=True) if len(k) < 10 or first[k] == i) for i, t in rows.items()}


def _one_of_each(rows):
    """All pairs of five-word sets, linked from a Jaccard similarity of 0.8 on."""
    root, sets = {i: i for i in rows}, {}
    for i, t in rows.items():
        w = re.findall(r"[^ \t-\r]+", _lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: t for i, t in rows.items() if find(i) == i}


def _uncontaminated(rows, benchmark):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t or ""))
    windows = defaultdict(set)
    for t in benchmark:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[len(w[k : k + 13])].add(tuple(w[k : k + 13]))
    out = {}
    for i, t in rows.items():
        w = cut(t)
        hit = {p for n, known in windows.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in known for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            out[i] = t
    return out


def test_run_against_brute_force(spark):
    """Each stage after the model's written out again in plain Python, over what the model has kept; tokens by tiktoken."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < docs.count() - kept.count() < 40
    rows = {r["doc_id"]: r["text"] or "" for r in kept.collect()}
    rows = _uncontaminated(_one_of_each(_without_repeats(rows)), [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    ranks = tiktoken.load.load_tiktoken_bpe(queries.tokenizer(bpe_prefix.VOCABULARY))
    encoding = tiktoken.Encoding("test", pat_str=queries.piece_pattern(), mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in rows.items():
        ids = encoding.encode_ordinary(t)
        want[i] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_take_null_texts_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.union(docs.limit(3)).union(docs.limit(2).selectExpr("doc_id + 100000", "cast(null as string)", "lang", "source", "n_chars")).union(docs.limit(1).selectExpr("cast(null as bigint)", "'no key, some words'", "lang", "source", "n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        odd = written(stage(spark, odd, SF))
    ids = [r["doc_id"] for r in odd.collect()]
    assert ids.count(None) == 1 and len([i for i in ids if i is not None and i >= 100000]) <= 1 and len(ids) <= 46


def test_stages_take_documents_with_more_columns_and_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).selectExpr("*", "'x' as score", "1 as n_hit", "'y' as fingerprint")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
    assert docs.count() <= 30
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(repr(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(repr(r[k]) for k in place) for r in want.fetchall())


def test_scores_exist_for_all(spark):
    got = queries.op4_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and got.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.MAX_TRAINING_ROWS > 0
