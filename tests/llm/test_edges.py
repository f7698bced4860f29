"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and columns that clash with its own."""

import pytest
from pyspark.sql import functions as F

from lociweave.llm import bloom, bpe_prefix, decontaminate, exact_dedup, kd_shard, line_dedup, secret_ledger, simhash, token_counts
from lociweave.llm.common import remove, saved, tidy, with_groups, written
from lociweave.llm.queries import piece_pattern, tokenizer

LONG = "A long line of words, password=abcdefghijklmnop and 0123456789abcdef0123. " * 3000
ROWS = [(1, "some text here\nand a line of it"), (1, "some text here\nand a line of it"), (2, None), (2, None), (3, ""), (4, LONG), (5, LONG), (None, "some text here\nand a line of it"), (None, None), (6, " \t\n")]
#: Names that operators use inside or add.
CLASHES = "id digest h again row length n size th crc nth blob rule word mask fp first times label shard slot n_lines n_dropped n_words n_pieces n_tokens spans items n_assign fingerprint component_id keep_id kept __id __drops __among __word __again __gone __slice __key path".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return written(rows.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES], F.lit("en").alias("lang"), F.lit("s").alias("source")))


def _counts(docs):
    return token_counts.with_counts(docs, tokenizer(token_counts.VOCABULARY), piece_pattern())


def _encoding(docs):
    return bpe_prefix.with_encoding(docs, tokenizer(bpe_prefix.VOCABULARY), piece_pattern())


def _decontaminated(docs):
    items = docs.sparkSession.createDataFrame([("q", "some text here"), (None, None)], "item_id string, text string")
    return decontaminate.with_hits(docs, items)


OPERATORS = {
    "decontaminate": _decontaminated,
    "secrets": secret_ledger.scan_documents,
    "lines": line_dedup.dedup_lines,
    "counts": _counts,
    "exact": exact_dedup.text_groups,
    "shard": kd_shard.shard,
    "encoding": _encoding,
    "simhash": simhash.near_duplicates,
    "similar": simhash.similar_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, docs, name):
    """One row a row, repeated ones alike but for places and the one copy that stays; the same without the other columns; none of none."""
    got, bare = OPERATORS[name](docs), OPERATORS[name](docs.select("doc_id", "text", "lang", "source"))
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    added = [c for c in bare.columns if c not in ("doc_id", "text", "lang", "source")]
    show = lambda df: sorted(tuple(repr(r[c]) for c in ("doc_id", *added)) for r in df.collect())
    rows = show(got)
    assert len(rows) == len(ROWS) and rows == show(bare)
    assert OPERATORS[name](docs.limit(0)).count() == 0
    kept = [c for c in CLASHES if c in got.columns and c not in added]
    assert all(r[c] == f"own {c}" for r in got.collect() for c in kept)
    if name in ("lines", "counts", "encoding", "decontaminate"):
        assert len(kept) >= len(CLASHES) - 4


def test_defined_results(docs):
    lines = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert lines == {(1, 2, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (5, 1, 1), (None, 2, 0), (None, 1, 0), (6, 2, 0)}
    exact = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.text_groups(docs).collect()]
    # one row stays of equal texts: of most code points, then the smallest key, null before all others
    assert sorted((x for x in exact if x[1] == 6), key=repr) == [(2, 6, 5, False), (2, 6, 5, False), (3, 6, 5, False), (6, 6, 5, True), (None, 6, 5, False)]
    assert sum(x[3] for x in exact) == 3 and (4, 4, 2, True) in exact and (5, 4, 2, False) in exact and exact.count((1, None, 3, False)) == 2
    near = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert near == {(1, 1), (None, 1), (2, 2), (3, 2), (6, 2), (None, 2), (4, 4), (5, 4)}
    spans = {r["doc_id"]: (r["n_assign"], r["n_hex"]) for r in secret_ledger.scan_documents(docs).collect() if r["doc_id"]}
    assert spans == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (3000, 3000), 5: (3000, 3000), 6: (0, 0)}
    assert {r["n_pieces"] for r in _counts(docs.where("doc_id in (2, 3)")).collect()} == {0} == {r["n_tokens"] for r in _encoding(docs.where("doc_id in (2, 3)")).collect()}


def test_keep_first(spark, docs):
    left = lambda df: sorted(repr(r["doc_id"]) for r in df.collect())
    assert left(exact_dedup.keep_first(docs)) == ["4", "6", "None"]
    assert left(simhash.keep_first(docs)) == ["1", "1", "2", "2", "4"]


def test_groups_and_filters(spark):
    rows = written(spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("g")))
    groups = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    joined = with_groups(rows, groups, "g", "n")
    assert joined.count() == 5000 and joined.where("g = 7 and n != 1668").count() == 0
    keys = written(spark.range(0, 5000, 10).select(F.col("id").alias("k")))
    out, maybe = bloom.parted(rows, "id", keys)
    assert out.count() + maybe.count() == 5000 and out.where("id % 10 = 0").count() == 0 and maybe.count() < 600


def test_scratch_tables_go(spark):
    with tidy(spark) as tables:
        _, path = saved(spark.range(3))
        stays, kept = saved(spark.range(4))
        tables.remove(kept)
    assert stays.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    remove(spark, [kept])
