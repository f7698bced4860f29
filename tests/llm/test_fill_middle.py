"""Fill-in-the-middle against a plain version with lists of lines."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from lociweave.llm import fill_middle
from lociweave.llm.queries import op13_fill_middle


def brute(key, text, rate=100, share=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < share:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, sf="/root/testdata/sf0.001"):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op13_fill_middle(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        n, form, prefix, middle, output = brute(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, prefix, middle, sha(output), sha(texts[r["doc_id"]] or ""))


TEXTS = ["", None, "\n", "\n\n\n", "a", "a\n", "a\nb", "ä\r\n🙂🙂\n\nz", "x<P>y\nz", "<<S\n>S>\n<", "é\n" * 3000, "long " * 50_000 + "\nend", "q\n" * 700 + "no end"]


def test_odd_texts_keys_and_columns(spark):
    rows = [(k * 7 if k else None, t, "kept", 1) for k in range(6) for t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, N string, form int").repartition(5)
    found = fill_middle.with_fill_middle(df)
    assert found.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in found.withColumn("back", fill_middle.restored(found["output"], found["form"])).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


def test_shares_and_empty_tables(spark):
    df = spark.range(400).selectExpr("id as doc_id", "'a\nb\nc' as text")
    how = fill_middle.FillMiddle(rate=30, suffix_first=100)
    for r in fill_middle.with_fill_middle(df, how).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"], 30, 100)
    assert fill_middle.with_fill_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "ba", "c"), ("aa", "b", "c"), ("abc", "b", "d")])
def test_sentinels_that_text_could_complete_are_refused(marks):
    with pytest.raises(ValueError):
        fill_middle.FillMiddle(prefix=marks[0], suffix=marks[1], middle=marks[2])


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_rank_and_select(size, share):
    bits = np.random.default_rng(size).random(size) < share
    vector, set_ = fill_middle.BitVector(bits), np.nonzero(bits)[0]
    assert len(vector) == len(set_)
    at = np.arange(size + 1)
    np.testing.assert_array_equal(vector.rank(at), np.concatenate([[0], np.cumsum(bits)]))
    np.testing.assert_array_equal(vector.select(np.arange(len(set_))), set_)
