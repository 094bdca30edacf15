"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor.

1. Entries become whole numbers, x = floor(256 c). Each distinct vector counts once: vectors are packed, made distinct by a
   shuffle with map-side combining, and written. The written list is read three times, a task sends one block of sums each.
2. The size n and the sums S are exact; the scatter is summed from vectors centred by S / n. Blocks of tasks are added on
   Spark by row of the matrix; the driver gets the d x d result only.
3. Pivoted Cholesky gives P'AP = LL'. Columns of L are rotated in pairs until they are orthogonal: their squared norms are
   the eigenvalues, the columns scaled to length one the components (no product of the matrix with itself is formed).
4. Every row is centred, projected and scaled where it is read; the covariance of the result over the list is measured.

Rows whose vector is null, empty or holds a null, a NaN or an infinite entry are dropped; so are rows whose vector is not of
the commonest length (the longer one of equally common lengths). Products beyond 2**53 are held there. Components stand for
eigenvalues above rounding only: fewer than asked for where the vectors span less, none (and no rows) for a single distinct
vector or an empty table. Repeated rows count once in the fit and are all returned, null ids too. A deviation that 64
bits cannot hold is null. Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query
from .text import stored

SCALE, HELD = 256, 2.0 ** 53
COMPONENTS = 4


@dataclass
class Whitening:
    """``values`` fall; the columns of ``vectors`` are their unit components; ``error`` is the worst entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, the difference taken in whole numbers where they fit."""
        if self.exact(x):
            return (x * self.n - np.array(self.sums, np.int64)) / self.n
        return x - np.array([s / self.n for s in self.sums])

    def exact(self, x: np.ndarray, power: int = 1) -> bool:
        most = max(1, int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0))
        return most ** power * (len(self.sums) if power > 1 else 1) < 2 ** 63

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exactly; None beyond 64 bits."""
        if self.exact(x, 2):
            z = x * self.n - np.array(self.sums, np.int64)
            return (z * z).sum(1).tolist()
        exact = (sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist())
        return [v if v < 2 ** 63 else None for v in exact]


def usable(rows: DataFrame, vector: str, length: int | None = None) -> DataFrame:
    """The rows with a vector of ``length`` (else the commonest length) and finite entries only, the vector as ``_v`` (array<double>)."""
    rows = rows.withColumn("_v", F.col(vector).cast("array<double>"))
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.coalesce(finite, F.lit(False)))
    if length is None:
        common = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
        length = common.d if common else 0
    return rows.filter(F.size("_v") == length)


def whole(column: pa.ListArray) -> np.ndarray:
    """The vectors of a batch as whole numbers, one a row."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(SCALE * flat), -HELD, HELD).astype(np.int64).reshape(len(column), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as bytes: two a number where all of its numbers fit, else eight."""
    for batch in batches:
        x = whole(batch.column(0))
        short = (np.abs(x) < 1 << 15).all(1).tolist()
        rows = [r.astype("<i2").tobytes() if s else r.tobytes() for r, s in zip(x, short)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["x"])


def _unpacked(column: pa.BinaryArray, d: int) -> np.ndarray:
    return np.stack([np.frombuffer(raw, "<i2" if len(raw) == 2 * d else "<i8") for raw in column.to_pylist()]).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], d: int, most: int = 4096) -> Iterator[np.ndarray]:
    for batch in batches:
        for s in range(0, batch.num_rows, most):
            yield _unpacked(batch.column(0).slice(s, most), d)


def _sums(d: int):
    """Per dimension the number of vectors and the sums of the upper and lower 32 bits of their entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for x in _blocks(batches, d):
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)],
                                             ["i", "n", "high", "low"])
    return run


def _scatter(model: Whitening):
    """The rows of a task's part of the scatter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.sums)
        total, some = np.zeros((d, d)), False
        for x in _blocks(batches, d):
            z = model.centred(x)
            total += z.T @ z
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])
    return run


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        part = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(0)
        total = part if total is None else total + part
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["i", "row"])


def _second_moments(model: Whitening):
    """The sums of the whitened entries and of their products, of one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for x in _blocks(batches, len(model.sums)):
            w = np.hstack([np.ones((len(x), 1)), model.whitened(x)])
            total = total + (w.T @ w).ravel()
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])
    return run


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): a[order][:, order] = L L' with falling diagonal; L has as many columns as pivots above rounding."""
    d = len(a)
    a, order = a.copy(), np.arange(d)
    factor = np.zeros((d, d))
    limit = d * np.finfo(float).eps * max(0.0, a.diagonal().max(initial=0))
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= limit:
            return factor[:, :k], order
        if p != k:
            for m in (a, a.T, factor, order[:, None]):
                m[[k, p]] = m[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1:, k] = a[k + 1:, k] / factor[k, k]
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def jacobi(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns rotated in pairs until each is orthogonal to all others."""
    g = columns.T.copy()  # a column is a row here, so that it lies in one piece
    for _ in range(sweeps):
        turned = False
        for p in range(len(g) - 1):
            for q in range(p + 1, len(g)):
                a, b, c = g[p] @ g[p], g[q] @ g[q], g[p] @ g[q]
                if abs(c) <= np.finfo(float).eps * np.sqrt(a * b):
                    continue
                turned = True
                zeta = (b - a) / (2 * c)
                t = np.copysign(1, zeta) / (abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.hypot(1, t)
                g[p], g[q] = cos * (g[p] - t * g[q]), cos * (g[q] + t * g[p])
        if not turned:
            break
    return g.T


def decomposed(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues above rounding and their unit vectors (columns), each with its largest entry positive."""
    factor, order = pivoted_cholesky(scatter)
    turned = np.zeros_like(factor)
    turned[order] = jacobi(factor)
    norm = np.sqrt((turned * turned).sum(0))
    rank = np.argsort(-norm, kind="stable")
    rank = rank[norm[rank] > 0]
    unit = turned[:, rank] / norm[rank]
    sign = np.sign(unit[np.abs(unit).argmax(0), np.arange(len(rank))]) if len(rank) else np.empty(0)
    return norm[rank] ** 2, unit * sign


def fit(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitening | None:
    """The whitening of the distinct vectors of ``rows``; None without a usable vector."""
    good = usable(rows, vector)
    fitted = stored(good.select("_v").mapInArrow(_packed, "x binary").distinct(), "vectors")
    first = good.select(F.size("_v").alias("d")).first()
    if first is None:
        return None
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    sums = fitted.mapInArrow(_sums(first.d), "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), wide("high"), wide("low"))
    sums = sorted(sums.collect())  # one row a dimension
    model = Whitening(sums[0].n, [int(r.high) * 2 ** 32 + int(r.low) for r in sums], np.empty(0), np.empty((first.d, 0)), 0.0)
    block = fitted.mapInArrow(_scatter(model), "i int, row array<double>").groupBy("i").applyInArrow(_added, "i int, row array<double>")
    scatter = np.array([r.row for r in sorted(block.collect())])  # d x d
    values, vectors = decomposed((scatter + scatter.T) / 2)
    model.values, model.vectors = values[:components] / model.n, vectors[:, :components]
    model.trace = float(scatter.trace()) / model.n
    if len(model.values):
        moments = fitted.mapInArrow(_second_moments(model), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        m = np.array([r.v for r in sorted(moments.collect())]).reshape(len(model.values) + 1, -1) / model.n
        model.error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(len(model.values))).max())
    return model


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The key, ``deviation`` and ``whitened`` (one entry a component) of every usable row."""
    kind = rows.schema[key].dataType.simpleString()
    made = f"`{key}` {kind}, deviation long, whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviation(x), pa.int64()),
                                              pa.array(list(model.whitened(x)), pa.list_(pa.float64()))], [key, "deviation", "whitened"])

    if model is None:
        return rows.sparkSession.createDataFrame([], made)
    return usable(rows, vector, len(model.sums)).select(key, "_v").mapInArrow(run, made)


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(rows)
    found = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    shares = [float(v / model.trace) for v in model.values] if model else []
    return found.select("vec_id", (F.col("_i") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
                        "deviation", "whitened", F.get(F.array(*map(F.lit, shares or [0.0])), F.col("_i")).alias("explained"),
                        F.lit(model.error if model else 0.0).alias("identity_error"))
