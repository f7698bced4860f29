"""Whitening of embeddings by a tall-skinny QR: no covariance of the embeddings is ever formed.

Entries become whole numbers, so sums over all rows are exact and rows are centred before anything is multiplied.
Each partition reduces its centred rows to a triangular factor R, factors merge by a tree of eight to one, and the
singular vectors of the last R are the principal axes.  What leaves a task is one factor, whatever its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lociweave.llm.common import slices, tidy, without, written

#: Fixed values of the whole numbers: how many steps one is, and what is added.
STEPS, OFFSET = 64, 1_000_000
#: Factors that one task merges, and rows that are reduced at a time.
FAN, ROWS = 8, 4096
#: Larger entries count as this; beyond it neighbouring doubles are no whole steps apart anyway.
LARGEST = 2.0**61


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole(vector: Column) -> Column:
    """The entries as whole numbers: floor(64 c) + 1,000,000."""
    bounded = lambda c: F.greatest(F.least(c.cast("double") * STEPS, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: F.floor(bounded(c)) + F.lit(OFFSET).cast("long"))


@dataclass
class Whitening:
    """n different vectors with exact sums per dimension; axes (a column each) and variances of the kept components, largest first."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None
    #: Whole part of the mean and what is left of it, so that centring subtracts whole numbers first.
    low: np.ndarray = field(init=False)
    rest: np.ndarray = field(init=False)

    def __post_init__(self):
        self.low = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers less the mean."""
        return (x - self.low).astype(np.float64) - self.rest

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; nan for components without variance."""
        spread = np.sqrt(self.variances)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, self.centred(x) @ self.axes / spread, np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the sum over dimensions of (n x - sum)^2, exact."""
        apart, left = x - self.low, np.array([s % self.n for s in self.sums], dtype=object)
        most = int(np.abs(apart).max(initial=0)) * self.n + self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            d = apart * self.n - left.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = apart.astype(object) * self.n - left
        return (d * d).sum(axis=1).tolist()


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A column of lists of width whole numbers."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _reduced(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def _merge(factors: DataFrame, width: int) -> DataFrame:
    """(k, r) to one factor for every FAN neighbouring k."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for own in batch.column("r").to_pylist():
                r = _reduced(r, np.frombuffer(own).reshape(-1, width))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["k", "r"])

    return factors.groupBy(F.floor(F.col("k") / FAN).alias("up")).applyInArrow(merge, "k long, r binary")


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns in two parts, neither of which can overflow."""
    return [(a << 20) + b for a, b in zip((x >> 20).sum(axis=0).tolist(), (x & 0xFFFFF).sum(axis=0).tolist(), strict=True)]


def _sums(x: DataFrame, partial: Callable[[pa.RecordBatch], list], kind: str) -> list:
    """Sums over all rows, entry by entry, of the lists that partial makes of batches, added up within a task and then in Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, ROWS):
            own = partial(batch)
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            arrays = [pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["at", "value"])

    parts = x.mapInArrow(add, "at int, value string").groupBy("at").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    return [r["value"] for r in parts.orderBy("at").collect()]  # one row an entry, not a vector


def fit(x: DataFrame, width: int, components: int = 16) -> Whitening | None:
    """The whitening of a table of different vectors x, arrays of width whole numbers; none if it is empty.

    x is read three times: for sums, for factors, and to measure the covariance of what comes out.
    """
    found = _sums(x, lambda b: [b.num_rows, *_exact_sums(_matrix(b, "x", width))], "decimal(38,0)")
    if not found:
        return None
    n, *sums = map(int, found)
    model = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for batch in slices(batches, ROWS):
            r = _reduced(r, model.centred(_matrix(batch, "x", width)))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["k", "r"])

    factors, many = x.mapInArrow(reduce, "k long, r binary"), x.rdd.getNumPartitions()
    while many > 1:
        factors, many = _merge(factors, width), -(-many // FAN)
    r = np.frombuffer(factors.first()["r"]).reshape(-1, width)  # width x width at most
    _, s, axes = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate([s, np.zeros(width - len(s))])
    s[s <= s.max(initial=0) * max(n, width) * np.finfo(float).eps] = 0
    kept = min(components, width)
    model = Whitening(n, sums, axes[:kept].T.copy(), s[:kept] ** 2 / n, float((s**2).sum() / n))
    if (model.variances > 0).any():
        model.identity_error = _identity_error(x, model, width)
    return model


def _identity_error(x: DataFrame, model: Whitening, width: int) -> float:
    """The largest absolute entry of the covariance of the whitened vectors less the identity, over components with variance."""
    some = int((model.variances > 0).sum())

    def partial(batch: pa.RecordBatch) -> list[float]:
        w = model.project(_matrix(batch, "x", width))[:, :some]
        return [*w.sum(axis=0).tolist(), *(w.T @ w).ravel().tolist()]

    found = np.array(_sums(x, partial, "double")) / model.n
    means, products = found[:some], found[some:].reshape(some, some)
    return float(np.abs(products - np.outer(means, means) - np.eye(some)).max())


def whitened(rows: DataFrame, model: Whitening, vector: str = "__x") -> DataFrame:
    """A row of the rest of rows per component: component (from 1), n, deviation, whitened, explained and identity_error.

    vector: whole numbers as whole() makes them.  deviation is null where it has more than 38 digits, whitened where
    the component has no variance.
    """
    others = [c for c in rows.columns if c != vector]
    kinds = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    schema = StructType([*rows.select(*[f"`{c}`" for c in others]).schema.fields, *StructType.fromDDL(kinds).fields])
    width, kept = len(model.sums), len(model.variances)
    explained = model.variances / model.trace if model.trace > 0 else np.full(kept, np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            x, rows_ = _matrix(batch, vector, width), batch.num_rows
            again = pa.array(np.repeat(np.arange(rows_), kept))
            deviation = pa.array([d if d < 10**38 else None for d in model.deviations(x)], pa.decimal128(38, 0))
            plain = model.project(x).ravel()
            figures = [
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * kept, model.n, dtype=np.int64)), deviation.take(again),
                pa.array(plain, mask=np.isnan(plain)), pa.array(np.tile(explained, rows_), mask=np.isnan(np.tile(explained, rows_))),
                pa.array([model.identity_error] * (rows_ * kept), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(again) for c in others], *figures], names=schema.names)

    return rows.mapInArrow(project, schema)


def with_whitening(rows: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """Per row of rows with a usable vector and component the figures of whitened(), in place of the vector.

    The fit takes every different vector once, however many rows have it.  Rows whose vector is null or holds null or
    non-finite entries go.  All vectors must have one length; if they don't, that of most different ones counts, the
    longer of two, and a row of another length comes back once, with no component.  Without any usable vector there
    are no rows.  Runs jobs when called.  Columns of rows with these names are replaced.
    """
    rows = without(rows, "component", "n", "deviation", "whitened", "explained", "identity_error", "__x")
    rows = rows.where(usable(F.col(f"`{vector}`"))).withColumn("__x", whole(F.col(f"`{vector}`"))).drop(vector)
    with tidy(rows.sparkSession):
        fit_list = written(rows.select(F.col("__x").alias("x")).distinct())
        lengths = fit_list.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
        first = lengths.orderBy(F.desc("n"), F.desc("width")).take(2)
        width = first[0]["width"] if first else 0
        model = fit(fit_list.where(F.size("x") == width), width, components) if width else None
    if model is None:
        model = Whitening(1, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    found = whitened(rows.where(F.size("__x") == len(model.sums)), model)
    if len(first) < 2:
        return found
    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    odd = rows.where(F.size("__x") != len(model.sums)).drop("__x")
    return found.unionByName(odd.select("*", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names]))
