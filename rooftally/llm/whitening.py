"""Whitening of embeddings by a bidiagonal qd solver (operator 11).

The different vectors are centred and reduced by blockwise QR: each task folds its rows into one triangle, and triangles are merged
``FAN`` at a time until one is left. That triangle has the singular values and right vectors of the whole centred matrix, so no
product of the matrix with itself is formed and the condition of the data isn't squared. A single task then bidiagonalises it by Householder
reflections, finds the singular values by the dqds iteration, and recovers the leading directions by twisted factorisations.

Scale: what moves is one row of d * d numbers for each task, whatever the number of vectors; the driver sees the sums of the
dimensions and the leading directions. Copies of a vector collapse by partial aggregation before they are shuffled. Each step ends in a
written table, so lost executors repeat that step at most.

Defined cases: vectors that are NULL, empty, or hold NULL, NaN or infinite entries take no part; nor do those of another length than the most
frequent one (the longer of two equally frequent ones). Entries too large for 64 bits count as the nearest number that fits. Repeated vectors count once in the
fit and each get their row; a NULL id stays NULL. Directions without variance are left out, so constant or single vectors and
empty tables give no components and no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from rooftally.llm.bidiagonal import leading_directions
from rooftally.workspace import write_and_read

#: Entries are counted in units of 1 / SCALE.
SCALE = 256
COMPONENTS = 4
#: Triangles merged by one task.
FAN = 16
#: Rows folded into a triangle at a time, at least.
ROWS = 2048
_LONG = 2 ** 63 - 1


@dataclass(frozen=True)
class Whitening:
    """What a fit found: number of different vectors, exact sums, leading directions (rows), their variances and the whole variance."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.variances / self.trace).tolist()


def whole_numbers(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): the vectors that take part, as numbers of units; written, for the steps that follow."""
    sound = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * SCALE).cast("long"))
    rows = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & sound).select(F.col(key).cast("long").alias(key), x.alias("x"))
    rows = write_and_read(rows, "vectors")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (usual.d if usual else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            high, low = x >> 32, x & 0xFFFFFFFF  # in halves, so that no sum of a batch overflows
            for k, (a, b) in enumerate(zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist())):
                total[k] += (a << 32) + b
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(str, total))],
                                             ["k", "n", "s"])
    return run


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n, with the whole part of the mean taken off in integers."""
    whole = [s // n for s in sums]
    part = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    if max(map(abs, whole), default=0) < 2 ** 61 and (not x.size or np.abs(x.astype(float)).max() < 2 ** 61):
        return (x - np.array(whole, np.int64)) - part
    return (x.astype(object) - np.array(whole, object)).astype(float) - part


def fold(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangle of the rows behind those that gave the triangle r."""
    step = max(ROWS, 2 * rows.shape[1])
    for at in range(0, len(rows), step):
        r = np.linalg.qr(np.concatenate([r, rows[at:at + step]]), mode="r")
    return r


def _triangles(n: int, sums: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            r = fold(r, _centred(_matrix(batch.column("x"), d), n, sums))
        if len(r):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "r"])
    return run


def _merger(d: int) -> Callable[[pa.Table], pa.Table]:
    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        r = np.zeros((0, d))
        for one in group.column("r"):
            r = fold(r, one.values.to_numpy().reshape(-1, d))
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})
    return merge


def _solver(d: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("r"):
                r = one.values.to_numpy().reshape(-1, d)
                whole = float((r * r).sum())
                if whole > 0:
                    squares, directions = leading_directions(r, most)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(len(squares)), pa.int32()), pa.array(squares), pa.array([whole] * len(squares)),
                         pa.array(list(directions), pa.list_(pa.float64()))], ["k", "square", "whole", "direction"])
    return run


def fit_whitening(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the different vectors in column x, all of one length; None where nothing varies."""
    fit = write_and_read(rows.select("x").distinct(), "different-vectors")
    first = fit.first()
    if first is None:
        return None
    d = len(first.x)
    parts = fit.mapInArrow(_sums(d), "k int, n long, s string")
    totals = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    n, sums = totals[0].n, tuple(int(t.s) for t in totals)
    triangles = write_and_read(fit.mapInArrow(_triangles(n, sums), "part long, r array<double>"), "triangles")
    while triangles.count() > 1:
        merged = triangles.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_merger(d), "part long, r array<double>")
        triangles = write_and_read(merged, "triangles")
    found = triangles.mapInArrow(_solver(d, most), "k int, square double, whole double, direction array<double>").orderBy("k").collect()
    if not found:
        return None
    return Whitening(n, sums, np.array([r.direction for r in found]), np.array([r.square for r in found]) / n, found[0].whole / n)


def whitened_rows(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Centred rows projected on the directions, with unit variance."""
    return _centred(x, w.n, w.sums) @ (w.directions / np.sqrt(w.variances)[:, None]).T


def deviations(x: np.ndarray, w: Whitening) -> list[int | None]:
    """The exact sum of (n * x - sum) squared over the dimensions; None where it exceeds 64 bits."""
    sums = np.array(w.sums, object)
    bound = (w.n * np.abs(x.astype(float)).max(initial=0.0) + max(map(abs, w.sums))) ** 2 * x.shape[1]
    if bound < 2 ** 62:
        return ((w.n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((w.n * x.astype(object) - sums) ** 2).sum(axis=1)
    return [v if v <= _LONG else None for v in exact]


def whiten(rows: DataFrame, w: Whitening) -> DataFrame:
    """The rows with ``deviation`` (long) and ``whitened`` (a number for each component) added."""
    shape = T.StructType().add("deviation", T.LongType()).add("whitened", T.ArrayType(T.DoubleType()))

    @F.arrow_udf(shape)
    def measured(column: pa.Array) -> pa.Array:
        x = _matrix(column, len(w.sums))
        return pa.StructArray.from_arrays([pa.array(deviations(x, w), pa.int64()),
                                           pa.array(list(whitened_rows(x, w)), pa.list_(pa.float64()))], ["deviation", "whitened"])

    return rows.withColumn("_m", measured("x")).select(*rows.columns, "_m.*")


def _moments(w: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each task's rows: count, sums and products of the whitened values, the products about a task's own mean."""
    k = len(w.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, about = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = whitened_rows(_matrix(batch.column("x"), len(w.sums)), w)
            own, m = z.mean(axis=0), len(z)
            apart = own - mean
            about += (z - own).T @ (z - own) + np.outer(apart, apart) * (n * m / (n + m))
            mean += apart * m / (n + m)
            n += m
        if n:
            flat = np.concatenate([n * mean, (about + n * np.outer(mean, mean)).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["k", "v"])
    return run


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest entry of the difference between the whitened vectors' covariance and the identity."""
    k = len(w.variances)
    found = rows.select("x").distinct().mapInArrow(_moments(w), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    flat = np.array([r.v for r in found]) / w.n
    mean = flat[:k]
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whitened_components(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and component: key, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_numbers(vectors, vector, key)
    w = fit_whitening(rows, most)
    if w is None:
        return rows.sparkSession.createDataFrame([], f"{key} long, component int, n long, deviation long, whitened double, "
                                                                 "explained double, identity_error double")
    shares = F.array(*[F.lit(v) for v in w.explained])
    each = whiten(rows, w).select(key, "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select(key, (F.col("_k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("_k")).alias("explained"), F.lit(identity_error(rows, w)).alias("identity_error"))
