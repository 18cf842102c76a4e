"""Whitening of embeddings with components found by contour integration.

Sums and the covariance are added up where the rows lie; what travels is one
number per dimension or pair of dimensions and task. The eigenvalue intervals
of the covariance, a matrix whose size does not depend on the number of rows,
are solved by a task each. Rows are then projected without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import feast

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries beyond this, in absolute value, count as not finite: their integers would not be exact.
LARGEST_ENTRY = 2.0**40
LONGEST = 2**63 - 1


@dataclass(frozen=True)
class Fit:
    """What all rows of ``dims`` entries say: their number and sums, and components of the covariance.

    ``mean = whole + rest / n`` with integers, so that centred rows are exact before they are rounded once.
    """

    dims: int
    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of ``(n x - S)`` squared, exact; null where a long can't hold them."""
        off = x - self.whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if self.dims * most * most <= LONGEST:
            return ((off * self.n - self.rest) ** 2).sum(1).tolist()
        exact = [sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in off]
        return [v if v <= LONGEST else None for v in exact]


def usable(embedding: Column) -> Column:
    """The vector is not null and no entry is null, not finite or beyond ``LARGEST_ENTRY``."""
    return F.coalesce(F.forall(embedding.cast("array<double>"), lambda c: F.coalesce(F.abs(c) <= LARGEST_ENTRY, F.lit(False))), F.lit(False))


def integers(entries: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * entries).astype(np.int64) + SHIFT


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return integers(batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def length_sums(rows: DataFrame) -> tuple[int, int, list[int]] | None:
    """Length, number and sums of the vectors of the commonest length, the shorter one if two are as common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            lists = batch.column("_v")
            lengths = np.diff(lists.offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                x = integers(lists.filter(pa.array(lengths == d)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                kept = held.setdefault(d, [0, [0] * d])
                kept[0] += len(x)
                # in two halves, so that no sum leaves a long
                high, low = (x >> 24).sum(0).tolist(), (x & (1 << 24) - 1).sum(0).tolist()
                kept[1] = [s + (h << 24) + b for s, h, b in zip(kept[1], high, low, strict=True)]
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(s) for s in sums], pa.string())],
                ["d", "i", "n", "s"])

    found = (rows.select("_v").where(F.size("_v") > 0).mapInArrow(run, "d int, i int, n bigint, s string")
             .groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
             .groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("sums"))
             .orderBy(F.desc("n"), "d").first())
    return (found["d"], found["n"], [int(r["s"]) for r in found["sums"]]) if found else None


def gram(rows: DataFrame, dims: int, width: int, shape: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over rows of the outer product of ``shape(x)`` with itself, ``width`` wide."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            c = shape(_matrix(batch, dims))
            total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], ["k", "v"])

    found = rows.select("_v").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width, width))
    for row in found:
        out[upper[0][row["k"]], upper[1][row["k"]]] = row["v"]
    return out + np.triu(out, 1).T


def eigenpairs(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenpairs of a covariance, each interval solved by a task of its own."""
    intervals = feast.plan(matrix, wanted)
    if not intervals:
        return np.empty(0), np.empty((len(matrix), 0))
    shared, size = spark.sparkContext.broadcast(matrix), len(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values, vectors = feast.solved(shared.value, feast.Interval(r["low"], r["high"], r["count"], r["above"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["above"]], pa.int32()), pa.array([values.tobytes()]), pa.array([vectors.tobytes()])],
                                                 ["above", "values", "vectors"])

    asked = spark.createDataFrame([(i.low, i.high, i.count, i.above) for i in intervals], "low double, high double, count int, above int")
    found = asked.repartition(len(intervals)).mapInArrow(run, "above int, values binary, vectors binary").collect()
    parts = [(np.frombuffer(r["values"]), np.frombuffer(r["vectors"]).reshape(size, -1)) for r in sorted(found, key=lambda r: r["above"])]
    return feast.largest(parts, wanted)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Fit on all ``_v`` of the commonest length; None without vectors."""
    sums = length_sums(rows)
    if sums is None:
        return None
    dims, n, s = sums
    whole = np.array([v // n for v in s], np.int64)
    mean = Fit(dims, n, whole, np.array([v % n for v in s], np.int64), np.empty(0), np.empty((dims, 0)), 0.0)
    covariance = gram(rows.where(F.size("_v") == dims), dims, dims, mean.centred) / n
    values, vectors = eigenpairs(rows.sparkSession, covariance, min(components, dims))
    return Fit(dims, n, mean.whole, mean.rest, values, vectors, float(np.trace(covariance)))


def whiten(vectors: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    Entries become integers, ``floor(64 c) + 1000000``. Vectors that are null or
    hold an entry that is null, not finite or beyond ``LARGEST_ENTRY`` have no
    row, nor have vectors of another length than the commonest. Components are
    numbered from 1 by falling eigenvalue; each one's largest entry is
    positive. Where the eigenvalue is zero but for rounding, ``whitened`` is null
    and ``explained`` 0. Repeated rows and null keys count like others; other columns are
    not looked at. The covariance of ``whitened`` needs no centring of its own: it is made of centred rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(embedding))).select(F.col(key).alias("_key"), F.col(embedding).cast("array<double>").alias("_v"))
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    fitted = fit(rows, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    same = rows.where(F.size("_v") == fitted.dims)
    found, width = len(fitted.values), min(components, fitted.dims)
    error = np.abs(gram(same, fitted.dims, found, fitted.whiten) / fitted.n - np.eye(found)).max(initial=0.0)
    explained = np.append(fitted.values / fitted.trace if found else [], np.zeros(width - found))
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):  # each row becomes many
                part = batch.slice(start, 2_000)
                x = _matrix(part, known.dims)
                white = np.full((len(x), width), np.nan)
                white[:, :found] = known.whiten(x)
                each = np.repeat(np.arange(len(x)), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key").take(pa.array(each)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(each), known.n)), pa.array(known.deviations(x), pa.int64()).take(pa.array(each)),
                     pa.array(white.ravel(), mask=np.isnan(white.ravel())), pa.array(np.tile(explained, len(x))),
                     pa.array(np.full(len(each), error))], schema.names)

    return same.mapInArrow(run, schema)
