"""Toxicity by gradient-boosted trees over a few dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that are much more frequent in texts labelled toxic.  Texts the
trees learn from are measured with a lexicon of the other half of the labelled rows, so that a term's density
means the same there as in a text never seen; the calibration rows take no part in the boosting.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import extended, slices, without, written
from lociweave.llm.toxicity_features import FEATURES, Judge, Lexicon, measure, terms

#: The most labelled rows that anything is learned from; which ones, a hash of the key decides.
MAX_TRAINING_ROWS = 30_000
#: The least log-odds of a term of a lexicon, and the share of toxic texts that must have it (two texts at least).  All
#: such terms are taken; there are at most as many as a toxic text has terms on average, divided by SUPPORT.
WEAK, SUPPORT = 1.5, 0.003
TREES, DEPTH, STEP = 20, 3, 0.2


def remainder(key: Column) -> Column:
    """crc32 of the key as text, mod 5: 0 is held out."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(part, label, text): at most so many labelled rows that aren't held out, part 1 to 4; equal texts with one label count once.

    The keys are at most MAX_TRAINING_ROWS and so can go to all executors.  A key that labels call both is toxic.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(F.col(key)) != 0))
    known = known.groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("__key"), "__key").limit(most)
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "__key").select(remainder(F.col("__key")).alias("part"), "label", "text")
    return rows.where("text is not null").groupBy("label", "text").agg(F.min("part").alias("part")).select("part", "label", "text")


def learn_lexicon(rows: DataFrame) -> dict[str, Lexicon]:
    """Lexica of parts 1 and 2 ("a"), of parts 3 and 4 ("b"), and of all; the driver gets the terms above WEAK and SUPPORT only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, int, str]] = Counter()
        for batch in slices(batches):
            for part, label, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                half = "a" if part <= 2 else "b"
                found.update((half, label, t) for t in terms(text))
                found[half, label, ""] += 1  # the texts themselves
        columns = list(zip(*[(h, x, t, n) for (h, x, t), n in found.items()], strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["half", "label", "term", "n"])

    counts = rows.select("part", "label", "text").mapInArrow(count, "half string, label int, term string, n long")
    either = F.when(F.col("label") == 1, F.col("n")).otherwise(0)
    table = written(counts.groupBy("term").agg(*[F.sum(F.when(F.col("half") == h, x).otherwise(0)).alias(f"{h}{k}") for h in "ab" for k, x in ((1, either), (0, F.col("n") - either))]))
    whole = table.where("term = ''").first()
    lexica = {}
    for name, halves in (("a", "a"), ("b", "b"), ("all", "ab")):
        lexica[name] = Lexicon()
        if whole is None:
            continue
        toxic, clean = (sum(whole[f"{h}{k}"] for h in halves) for k in (1, 0))
        pos, neg = (sum((F.col(f"{h}{k}") for h in halves), F.lit(0)) for k in (1, 0))
        odds = F.log(((pos + 0.5) / (toxic + 1.0)) / ((neg + 0.5) / (clean + 1.0)))
        chosen = table.where((F.col("term") != "") & (pos >= max(2.0, SUPPORT * toxic)) & (odds >= WEAK)).select("term", odds.alias("odds"))
        for r in chosen.collect():
            if r["term"].endswith("-"):
                lexica[name].beginnings[r["term"][:-1]] = r["odds"]
            else:
                lexica[name].words[r["term"]] = r["odds"]
    return lexica


def with_features(rows: DataFrame, lexicon: dict[str, Lexicon], text: str, by: str | None = None) -> DataFrame:
    """rows with the column features: array<double>.  by: a column that names the lexicon for each row; else it is "all"."""
    schema = extended(rows, features="array<double>")
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = {k: Judge(x) for k, x in shared.value.items()}
        for batch in slices(batches):
            names = batch.column(by).to_pylist() if by else ["all"] * batch.num_rows
            found = [measure(t, judges[k]) for t, k in zip(batch.column(text).to_pylist(), names, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(take, schema)


@dataclass
class Model:
    lexicon: Lexicon
    trees: object = None  # None: nothing to learn from
    calibration: object = None

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (with features) with score; the features go."""
        if self.trees is None:
            hits = F.get("features", F.lit(FEATURES.index("seed words")))
            return rows.withColumn("score", 1 - F.exp(-hits / 2)).drop("features")
        out = self.trees.transform(rows.withColumn("__vector", array_to_vector("features")))
        out = out.withColumn("__p", F.get(vector_to_array("__probability"), F.lit(1)))
        if self.calibration is not None:
            out = self.calibration.transform(out)
            # a trace of the trees' own figure keeps the order among texts on one step of the calibration
            out = out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("__calibrated") + 0.001 * F.col("__p"))))
        else:
            out = out.withColumn("score", F.col("__p"))
        return out.select(*[f"`{c}`" for c in rows.columns if c != "features"], "score")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAINING_ROWS) -> Model:
    rows = written(training_rows(docs, labels, key, text, label, most))
    lexica = learn_lexicon(rows)
    other = rows.withColumn("lexicon", F.when(F.col("part") <= 2, "b").otherwise("a"))
    seen = written(with_features(other, lexica, "text", "lexicon").select("part", "label", "features"))
    counts = {(r["last"], r["label"]): r["n"] for r in seen.groupBy((F.col("part") == 4).alias("last"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(lexica["all"])
    if not counts.get((False, 0)) or not counts.get((False, 1)):
        return model
    vectors = seen.select("part", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("__vector"))
    trees = GBTClassifier(featuresCol="__vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=7, predictionCol="__guess")
    trees.setProbabilityCol("__probability").setRawPredictionCol("__raw")
    # at most MAX_TRAINING_ROWS rows of some 20 numbers
    model.trees = trees.fit(vectors.where("part < 4").coalesce(4))
    if counts.get((True, 0)) and counts.get((True, 1)):
        last = model.trees.transform(vectors.where("part = 4")).select("label", F.get(vector_to_array("__probability"), F.lit(1)).alias("__p"))
        model.calibration = IsotonicRegression(featuresCol="__p", labelCol="label", predictionCol="__calibrated").fit(last.coalesce(4))
    return model


def with_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Learns from labels of keys that aren't held out; scores depend on whole texts alone.  A null or empty text has
    no words and is scored like any other.  A null key counts as held out.  Without labels of both kinds, or
    documents, there is nothing to boost and the score is a stopgap, the density of a short list of insults.  Rows are
    never grouped for scoring; repeated rows get repeated scores.  Columns of these names in docs are replaced.  The
    model is fitted when this is called.
    """
    kept = without(docs, "held_out", "score", "predicted")
    model = fit(docs, labels, key, text, label, most)
    # plain names inside, so that no column of docs clashes with one of the model
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    scored = model.score(with_features(docs.toDF(*names.values()), {"all": model.lexicon}, names[text]))
    held = F.coalesce(remainder(F.col(names[key])) == 0, F.lit(True))
    return scored.select(*[F.col(names[c]).alias(c) for c in kept.columns], held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
