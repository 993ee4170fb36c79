"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance of the vectors is never formed: each pass over the rows multiplies it with a block of directions, as
X'(XQ) on centred rows, summed by Spark cell by cell. The driver orthonormalises the block (QR), solves the small
Rayleigh-Ritz problem in it and looks at the residuals; passes go on until those of all wanted components are at rounding
level. A block that would need too many passes is widened, at most to all dimensions, where one pass is enough. What the
driver holds depends on the number of dimensions alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bound_batches

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Directions in a block for each wanted component.
WIDE = 2
#: Residual, as a share of the largest eigenvalue, at which a component is certified; passes that a block may need still.
TOLERANCE, PATIENCE = 1e-12, 12
#: Eigenvalues below this share of the largest are no directions but rounding.
ZERO = 1e-11


@dataclass
class Fit:
    """Number of vectors, sums of each dimension, eigenvalues, unit eigenvectors (columns), trace, passes, identity error."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int = 0
    identity_error: float = 0.0


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part (no null, no null or non-finite entry, some entry), and their vectors as floor(64 c) + 1000000."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array(pc.list_value_length(column).fill_null(0), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    ends = np.cumsum(lengths)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    ok = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    sizes = np.unique(lengths[ok])
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    if not len(sizes):
        return np.flatnonzero(ok), np.zeros((0, 0), np.int64)
    x = flat[np.repeat(ok, lengths)].reshape(-1, int(sizes[0]))
    x = np.floor(SCALE * x)
    if np.abs(x).max() > 2.0**52:
        raise ValueError("an entry is too large")
    return np.flatnonzero(ok), x.astype(np.int64) + SHIFT


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        x = integers(batch.column(batch.schema.get_field_index("embedding")))[1]
        if len(x):
            yield x


def _summed(vectors: DataFrame, f, cells: int) -> np.ndarray:
    """Sum over all batches of what ``f`` gives for a matrix of vectors (a flat array of ``cells``): each task sends one row
    for each cell, and Spark adds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for x in _matrices(batches):
            total += f(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], ["cell", "value"])

    got = vectors.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(cells)
    out[got["cell"].to_numpy()] = got["value"].to_numpy()
    return out


def totals(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors that take part and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for x in _matrices(batches):
            if s is not None and len(s) != x.shape[1]:
                raise ValueError("vectors differ in length")
            n, s = n + len(x), x.sum(0) if s is None else s + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(np.full(len(s), n)), pa.array(s)], ["dim", "n", "value"])

    rows = vectors.mapInArrow(run, "dim long, n long, value long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).orderBy("dim").collect()
    if not rows:
        return 0, np.zeros(0, np.int64)
    if len({r["n"] for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    return rows[0]["n"], np.array([r["value"] for r in rows], np.int64)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less the mean; the difference is exact before the division."""
    return (n * x - sums) / n


def fit(vectors: DataFrame, components: int = COMPONENTS, wide: int = WIDE, seed: int = 0) -> Fit:
    """Leading eigenpairs of the covariance of the column ``embedding``; as many as have a variance, at most ``components``."""
    vectors = vectors.select("embedding")
    n, sums = totals(vectors)
    d = len(sums)
    k = min(components, d)
    none = Fit(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    if not n:
        return none
    r = np.random.default_rng(seed)
    b = min(d, wide * k)
    q = np.linalg.qr(r.standard_normal((d, b)))[0]
    passes, before = 0, math.inf
    while True:
        b = q.shape[1]

        def step(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            y = centred(x, n, sums)
            return np.append((y.T @ (y @ q)).ravel(), (y * y).sum())

        got = _summed(vectors, step, d * b + 1) / n
        passes += 1
        z, trace = got[:-1].reshape(d, b), float(got[-1])
        if trace == 0:
            return none
        small = q.T @ z
        values, u = np.linalg.eigh((small + small.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        ritz, image = q @ u, z @ u
        residual = np.sqrt(((image - ritz * values) ** 2).sum(0))[:k] / values[0]
        worst = float(residual.max())
        if worst <= TOLERANCE or (b == d and worst >= before):  # all dimensions are in the block: only rounding is left
            keep = int((values[:k] > ZERO * values[0]).sum())
            return Fit(n, sums, values[:keep], ritz[:, :keep], trace, passes)
        rate = worst / before
        slow = rate >= 1 or 0 < rate and math.log(TOLERANCE / worst) / math.log(rate) > PATIENCE
        q = image
        if b < d and slow:
            q, before = np.hstack([image, r.standard_normal((d, min(d, 2 * b) - b)) * values[0]]), math.inf
        else:
            before = worst
        q = np.linalg.qr(q)[0]


def _projected(x: np.ndarray, f: Fit) -> np.ndarray:
    return centred(x, f.n, f.sums) @ f.vectors / np.sqrt(f.values)


def certified(vectors: DataFrame, f: Fit) -> Fit:
    """``f`` with the largest absolute entry of the whitened rows' covariance less the identity, from a pass over all rows."""
    k = len(f.values)
    if not k:
        return f

    def moments(x: np.ndarray) -> np.ndarray:
        w = _projected(x, f)
        return np.append((w.T @ w).ravel(), w.sum(0))

    got = _summed(vectors.select("embedding"), moments, k * k + k) / f.n
    mean = got[k * k :]
    f.identity_error = float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return f


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2; null where a sum is beyond 64 bits."""
    y = n * x - sums
    if float((y.astype(np.float64) ** 2).sum(1).max(initial=0)) < 2.0**62:
        return (y * y).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in y.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every row of ``vectors`` (vec_id,
    embedding) that takes part, for each component.

    Vectors that are null, empty, or hold null or non-finite entries take no part; all others do, repeated rows and null ids
    too. Components without variance have no whitened value and are left out, so equal vectors, a single one or an empty
    table give no rows. Equal eigenvalues share their space in some orthonormal way, the same for all rows.
    Vectors of different lengths are an error. Other columns are ignored.
    """
    bound_batches(vectors.sparkSession)
    f = certified(vectors, fit(vectors, components))
    k = len(f.values)
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    explained = f.values / f.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(1))
            if not len(rows) or not k:
                continue
            m = len(rows)
            ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
            far = pa.array(deviations(x, f.n, f.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)), far, pa.array(_projected(x, f).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, f.identity_error))]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in names.split(", ")])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, names)
