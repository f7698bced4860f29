import os

import duckdb
import pytest

import __spark_entry__ as entry
from lociweave.operators.qc import Gate
from lociweave.plans import queries
from lociweave.plans.prepare import Settings, prepare
from lociweave.streaming.incoming import judge_arrivals

SF = "/root/testdata/sf0.001"


def test_prepare(records):
    c = records({1: [("a", "GCTGGT"), ("b", "GCCGGA")], 2: [("a", "GCTTGA"), ("b", "GCCGGA")], 3: [("a", "GCA")]})
    p = records({1: [("a", "AG"), ("b", "AG")], 2: [("a", "A*"), ("b", "AG")], 3: [("a", "A")]})
    done = prepare(c, p, settings=Settings())
    assert {r["locus"]: r["paired_passed"] for r in done.decisions.collect()} == {1: True, 2: False, 3: True}
    assert sorted(tuple(r)[:4] for r in done.partitions.select("locus", "start", "end", "length").collect()) == [(1, 1, 6, 6), (3, 7, 9, 3)]
    assert {(r["taxon"], r["locus"]): r["fragment"] for r in done.supermatrix.collect()}["b", 3] == "???"


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/g1.fasta").write_text(">a\nACGT\n>b\nACGA\n")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), Gate("nucl", min_length=3))
    judge_arrivals(*args).awaitTermination()
    (tmp_path / "in/g2.fasta").write_text(">a\nAC\n>b\nAC\n")
    judge_arrivals(*args).awaitTermination()
    got = {r["locus"]: r["reasons"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"g1": "", "g2": "short_alignment"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_agree_with_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else repr(x)
    ours = sorted(tuple(show(r[c]) for c in columns) for r in df.collect())
    place = [want.columns.index(c) for c in columns]
    assert ours == sorted(tuple(show(r[k]) for k in place) for r in want.fetchall())
