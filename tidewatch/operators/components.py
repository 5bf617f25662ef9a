"""Principal components of wide vectors by subspace iteration.

A pass multiplies the data with a block of a few vectors: each task adds up x (x·Q) over its rows, and the sums, one row a
column of the data, are added up by Spark. What is held anywhere is columns x components; a matrix of columns x columns is never
made. Between passes the driver turns the block into orthonormal vectors of largest variance, by elementwise products of
its few columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Components:
    """mean (columns), loadings (components x columns), variance along each, variance in all, rows, passes."""

    mean: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray
    total: float
    n: int
    passes: int


def _fine(vec: str, width: int | None = None):
    x = F.col(vec)
    whole = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return whole if width is None else whole & (F.size(x) == width)


def _products(mean: np.ndarray | None, block: np.ndarray | None) -> Callable:
    """Sums over a task's rows, a row a column: of x where there is no mean yet, else of x (x·Q) and x², x about the mean; -1 has the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if mean is None:
                part = x.sum(axis=0)[:, None]
            else:
                x = x - mean
                part = np.column_stack([x.T @ (x @ block), (x * x).sum(axis=0)])
            total, n = part if total is None else total + part, n + batch.num_rows
        if n:
            rows = [*total.tolist(), [float(n)] * total.shape[1]]
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(total)), -1], pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "y"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, y in zip(batch["i"].to_pylist(), batch["y"], strict=True):
            sums[i] = sums.get(i, 0) + y.values.to_numpy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["i", "y"])


def _pass(rows: DataFrame, mean: np.ndarray | None = None, block: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    found = rows.mapInArrow(_products(mean, block), "i int, y array<double>").repartition("i").mapInArrow(_added, "i int, y array<double>")
    sums = {r["i"]: r["y"] for r in found.collect()}
    n = sums.pop(-1, [0.0])[0]
    return np.array([sums[i] for i in range(len(sums))]), int(n)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b without BLAS, whose threads wait forever in a driver beside a session."""
    return np.stack([(a[:, [i]] * b).sum(axis=0) for i in range(a.shape[1])])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(a[:, [i]] * b[i] for i in range(a.shape[1]))


def _orthonormal(a: np.ndarray) -> np.ndarray:
    """Gram-Schmidt, twice; columns that vanish are left out."""
    kept: list[np.ndarray] = []
    for column in a.T:
        size = np.sqrt((column * column).sum())
        for _ in range(2):
            for q in kept:
                column = column - (q * column).sum() * q
        rest = np.sqrt((column * column).sum())
        if rest > 1e-12 * max(size, 1e-300):
            kept.append(column / rest)
    return np.stack(kept, axis=1)


def _eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors of a small symmetric matrix by Jacobi's rotations."""
    a, vectors = a.copy(), np.eye(len(a))
    for _ in range(60):
        off = np.abs(np.triu(a, 1))
        if off.max(initial=0) <= 1e-15 * max(np.abs(np.diag(a)).max(), 1e-300):
            break
        for p, q in np.argwhere(off > off.max() * 1e-3):
            if abs(a[p, q]) < 1e-300:
                continue
            theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
            t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, vectors):
                m[:, [p, q]] = np.stack([c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]], axis=1)
            a[[p, q]] = np.stack([c * a[p] - s * a[q], s * a[p] + c * a[q]])
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


def principal_components(df: DataFrame, vec: str, k: int, spare: int = 8, most_passes: int = 60, tolerance: float = 1e-10, seed: int = 0) -> Components:
    """The first k components of a column of vectors, as many as their rank at most.

    Vectors that are null, have a null, NaN or infinite component, or another length than most do not count. spare vectors are carried
    along; passes end when no component turns any more, by tolerance in 1 - |cos|. Each component's largest loading is positive.
    Variances divide by the number of rows less one. Without two rows there are no components.
    """
    sizes = df.where(_fine(vec)).groupBy(F.size(vec).alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    if sizes is None or sizes["n"] < 2 or not sizes["w"]:
        return Components(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, sizes["n"] if sizes else 0, 0)
    width = sizes["w"]
    rows = df.where(_fine(vec, width)).select(F.col(vec).cast("array<double>").alias("v"))
    sums, n = _pass(rows)
    mean = sums[:, 0] / n
    block = _orthonormal(np.random.default_rng(seed).normal(size=(width, min(width, k + spare))))
    old, passes = None, 0
    while True:
        found, _ = _pass(rows, mean, block)
        passes += 1
        product, total = found[:, :-1], float(found[:, -1].sum())
        values, turn = _eigen(_inner(block, product))
        ritz = _times(block, turn)[:, :k]
        rank = int((values[:k] > 1e-12 * max(values[0], 1e-300)).sum())
        if old is not None and old.shape[1] == rank and (1 - np.abs((old * ritz[:, :rank]).sum(axis=0))).max(initial=0) < tolerance or passes == most_passes or total <= 0:
            break
        old, block = ritz[:, :rank], _orthonormal(_times(product, turn))
    loadings = ritz[:, :rank].T if total > 0 else np.zeros((0, width))
    signs = np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])
    return Components(mean, loadings * signs[:, None], values[: len(loadings)] / (n - 1), total / (n - 1), n, passes)


def project(df: DataFrame, vec: str, model: Components, name: str) -> DataFrame:
    """df with each vector's coordinates along the components; null for a vector that does not count."""
    kept, mean, loadings = list(df.columns), model.mean, model.loadings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(batch["__ok"].to_numpy(zero_copy_only=False))
            out: list[list[float] | None] = [None] * batch.num_rows
            if len(at):
                x = batch[vec].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
                for i, y in zip(at.tolist(), ((x - mean) @ loadings.T).tolist(), strict=True):
                    out[i] = y
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(out, pa.list_(pa.float64()))], names=[*kept, name])

    ok = F.coalesce(_fine(vec, len(model.mean)), F.lit(False)) & F.lit(len(model.mean) > 0)
    schema = df.select("*", F.lit(None).cast("array<double>").alias(name)).schema
    return df.withColumn("__ok", ok).mapInArrow(run, schema)


def to_table(spark: SparkSession, model: Components) -> DataFrame:
    """component, variance, loadings, mean: a row a component, to be stored."""
    rows = [(i, float(v), w.tolist(), model.mean.tolist()) for i, (v, w) in enumerate(zip(model.variance, model.loadings, strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, loadings array<double>, mean array<double>")


def from_table(rows: Sequence) -> Components:
    """The model of a stored table's rows; what is not stored is 0."""
    rows = sorted(rows, key=lambda r: r["component"])
    return Components(np.array(rows[0]["mean"]), np.array([r["loadings"] for r in rows]), np.array([r["variance"] for r in rows]), 0.0, 0, 0)
