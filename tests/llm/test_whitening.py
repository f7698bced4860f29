"""Whitening against numpy's eigenvectors of the covariance, over all rows."""

from __future__ import annotations

import numpy as np
import pytest

from lociweave.llm import whitening
from lociweave.llm.queries import op11_whitening


def brute(vectors: np.ndarray, components: int = 16):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(components, x.shape[1])
    deviation = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return n, deviation, (x - sums / n) @ axes[:, :kept] / np.sqrt(values[:kept]), values[:kept] / values.sum()


def check(rows, vectors: dict, components: int = 16):
    ids = sorted(vectors)
    n, deviation, white, explained = brute(np.array([vectors[k] for k in ids]), components)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * white.shape[1]
    for k, key in enumerate(ids):
        assert {got[key, c + 1]["n"] for c in range(white.shape[1])} == {n}
        assert got[key, 1]["deviation"] == deviation[k]
    found = np.array([[got[key, c + 1]["whitened"] for c in range(white.shape[1])] for key in ids])
    signs = np.sign((found * white).sum(axis=0))
    np.testing.assert_allclose(found * signs, white, atol=1e-6)
    np.testing.assert_allclose([got[ids[0], c + 1]["explained"] for c in range(white.shape[1])], explained, rtol=1e-6)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_query(spark, sf="/root/testdata/sf0.001"):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    check(op11_whitening(spark, sf).collect(), vectors)


def test_repeated_rows_count_once_and_odd_ones_go(spark):
    rng = np.random.default_rng(3)
    vectors = {k: rng.normal(0, 3, 5).tolist() for k in range(300)}
    rows = [(k, v) for k, v in vectors.items()] + [(1000 + k, vectors[0]) for k in range(150)]
    odd = [(2000, None), (2001, [1.0, None, 2.0, 3.0, 4.0]), (2002, [float("nan")] * 5), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(19)
    check(whitening.with_whitening(df).collect(), dict(rows))


def test_widths_that_differ_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 1, 3).tolist(), "a", 1.5) for k in range(60)] + [(90, [1.0], "b", 1.5), (None, [], "c", None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, Whitened double")
    found = whitening.with_whitening(df, components=2).collect()
    assert len(found) == 122 and [r["label"] for r in found if r["component"] is None] == ["b", "c"]
    assert all(r["whitened"] is None for r in found if r["component"] is None)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    found = whitening.with_whitening(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.count() == 0 and found.columns[0] == "vec_id"


def test_components_without_variance_are_null(spark):
    rows = [(k, [float(k), 2.0 * k, 7.0]) for k in range(40)]
    found = whitening.with_whitening(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in found} == {(1, False), (2, True), (3, True)}
    assert found[0]["identity_error"] < 1e-9
    one = whitening.with_whitening(spark.createDataFrame(rows[:1] * 2, "vec_id long, embedding array<float>")).collect()
    assert len(one) == 6 and {(r["n"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, None, None, None)}


def test_sums_stay_exact_where_doubles_and_longs_do_not(spark):
    rows = [(0, [1e15, 0.25]), (1, [1e15 + 3, -0.25]), (2, [-1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in whitening.with_whitening(df, components=1).collect()}
    big = [[int(max(-whitening.LARGEST, min(whitening.LARGEST, c * 64)) // 1) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*big, strict=True)]
    wanted = [sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in big]
    assert [None if w >= 10**38 else w for w in wanted] == [found[k]["deviation"] for k in range(3)]


def test_factors_merge_by_a_tree(spark):
    rng = np.random.default_rng(5)
    vectors = {k: (rng.normal(0, 1, 4) @ rng.normal(0, 2, (4, 4))).tolist() for k in range(900)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    x = df.select(whitening.whole(df["embedding"]).alias("x")).distinct().repartition(70)
    model = whitening.fit(x, 4, 4)
    _, _, _, explained = brute(np.array(list(vectors.values())), 4)
    np.testing.assert_allclose(model.variances / model.trace, explained, rtol=1e-9)
