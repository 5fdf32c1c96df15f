"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

* A component c becomes the integer ``x = floor(64 c) + 1000000``. Equal x vectors count once: they are the fit list.
* One pass sums the fit list exactly (integers), one makes its centred scatter (per-task moments merged in a tree).
* The scatter's pivoted Cholesky factor L (``P' A P = L L'``) is rotated from the right by Jacobi rotations until its
  columns are orthogonal. Their squared norms over n are the eigenvalues of the covariance, the columns scaled to unit
  length are its eigenvectors. The matrix A is never iterated on, which keeps small eigenvalues accurate.
* Rotations of disjoint column pairs (a round-robin tournament) are done together.

The driver holds matrices of the vector length only. Each row is projected in its task.

Vectors that are null, empty, hold a null or non-finite component, or have a component whose x is no 64-bit integer, are
left out; so are vectors whose length is not the table's commonest (ties: the shorter). Components beyond the rank of
the fit list are not returned, so a table of one distinct vector gives no row. A deviation beyond 64 bits is null.
Null ids and repeated rows are rows like others. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import prepare, write_table
from textlake.llm.vectors import matrix, moments, plain, vector_length

SCALE, SHIFT = 64, 1_000_000
_WIDE = 2.0**62


def integers(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(mask, z)``: rows whose x fit in 64 bits, and ``z = x - 1000000`` of those."""
    z = np.floor(SCALE * v)
    mask = (np.abs(z) < _WIDE).all(axis=1)
    return mask, z[mask].astype(np.int64)


def packed_rows(z: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold it: equal rows give equal bytes."""
    high = np.maximum(np.abs(z.max(axis=1, initial=0)), np.abs(z.min(axis=1, initial=0)))
    out: list[bytes] = [b""] * len(z)
    for low, width in ((-1, 1), (127, 2), (32767, 4), (2**31 - 1, 8)):
        at = np.flatnonzero((high > low) & ((width == 8) | (high < 1 << (8 * width - 1))))
        for k, raw in zip(at.tolist(), z[at].astype(f"<i{width}"), strict=True):
            out[k] = raw.tobytes()
    return out


def unpacked_rows(rows: list[bytes], dim: int) -> np.ndarray:
    """The integer rows of ``packed_rows``; their order may change."""
    by_size: dict[int, list[bytes]] = {}
    for r in rows:
        by_size.setdefault(len(r), []).append(r)
    parts = [np.frombuffer(b"".join(p), f"<i{size // dim}").reshape(-1, dim).astype(np.int64)
             for size, p in sorted(by_size.items())]
    return np.concatenate(parts) if parts else np.zeros((0, dim), np.int64)


def centred(z: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``, exactly; Python integers where 64 bits might not do. Shifting x and S / n alike changes nothing."""
    base = [s // n for s in sums]
    rest = [s - n * b for s, b in zip(sums, base, strict=True)]
    big = max((abs(int(f(z[:, k], initial=b)) - b) for k, b in enumerate(base) for f in (np.max, np.min)), default=0)
    if (big + 1) * n < 1 << 62 and all(abs(b) < 1 << 62 for b in base):
        return n * (z - np.array(base, np.int64)) - np.array(rest, np.int64)
    return n * (z.astype(object) - np.array(base, object)) - np.array(rest, object)


def square_sums(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row, None beyond 64 bits."""
    if y.dtype != object:
        most = int(np.abs(y).max(initial=0))
        if most * most * y.shape[1] < 1 << 63:
            return (y * y).sum(axis=1).tolist()
    sums = (sum(v * v for v in row) for row in y.astype(object).tolist())
    return [s if s < 1 << 63 else None for s in sums]


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(factor, order)`` with ``a[order][:, order] = factor @ factor.T``; the factor has as many columns as ``a`` has rank."""
    a, dim = a.copy(), len(a)
    factor, order, left = np.zeros_like(a), np.arange(dim), np.diag(a).copy()
    floor = dim * np.finfo(np.float64).eps * max(float(left.max(initial=0.0)), 0.0)
    for k in range(dim):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= floor:
            return factor[:, :k], order
        if p != k:
            a[[k, p]], factor[[k, p]], left[[k, p]], order[[k, p]] = a[[p, k]], factor[[p, k]], left[[p, k]], order[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
        factor[k, k] = np.sqrt(left[k])
        factor[k + 1:, k] = (a[k + 1:, k] - factor[k + 1:, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1:] -= factor[k + 1:, k] ** 2
    return factor, order


def tournament(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs that together meet every pair of ``n`` (even) players once."""
    ring = np.arange(n)
    for _ in range(n - 1):
        yield ring[:n // 2], ring[n // 2:][::-1]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times a rotation that makes its columns orthogonal."""
    g, odd = factor.copy(), factor.shape[1] % 2
    if odd:
        g = np.concatenate([g, np.zeros((len(g), 1))], axis=1)
    if not g.shape[1]:
        return g
    small = 4 * np.finfo(np.float64).eps
    for _ in range(sweeps):
        worst = 0.0
        for p, q in tournament(g.shape[1]):
            a, b = g[:, p], g[:, q]
            aa, bb, ab = ((x * y).sum(axis=0) for x, y in ((a, a), (b, b), (a, b)))
            size = np.sqrt(aa * bb)
            angle = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            worst = max(worst, float(angle.max()))
            turn = angle > small
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = c * a - c * t * b, c * t * a + c * b
        if worst <= small * np.sqrt(len(g)):
            break
    return g[:, :g.shape[1] - odd]


@dataclass
class Whitening:
    """Fitted transform. ``directions`` (dim, k) are unit eigenvectors, ``values`` their falling eigenvalues."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Coordinates of rows ``n x - S`` (exact)."""
        return (y / self.n).astype(np.float64) @ (self.directions / np.sqrt(self.values))


def decompose(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of ``scatter / n`` and their unit vectors, at most ``most``, none beyond the rank."""
    factor, order = pivoted_cholesky(scatter)
    g = one_sided_jacobi(factor)
    norms = np.sqrt((g * g).sum(axis=0))
    rank = np.argsort(-norms, kind="stable")
    rank = rank[norms[rank] > 0][:most]
    out = np.empty((len(g), len(rank)))
    out[order] = g[:, rank] / norms[rank]
    # the largest entry of a direction is positive
    out *= np.where(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])] < 0, -1.0, 1.0)
    return norms[rank] ** 2 / n, out


def _keys(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(packed_rows(integers(matrix(batch.column(0), dim)[1])[1]),
                                                   pa.binary())], ["x"])


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, [0] * dim
    for batch in batches:
        z = unpacked_rows(batch.column(0).to_pylist(), dim)
        safe = z if int(np.abs(z).max(initial=0)) * max(len(z), 1) < 1 << 62 else z.astype(object)
        n, total = n + len(z), [a + int(b) for a, b in zip(total, safe.sum(axis=0), strict=True)]
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
             pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["k", "n", "s"])


def fit(vectors: DataFrame, components: int = 16) -> tuple[Whitening, DataFrame] | None:
    """The transform and the written fit list; None without a usable vector."""
    prepare(vectors.sparkSession)
    rows = plain(vectors)
    dim = vector_length(rows)
    if dim is None:
        return None
    # equal vectors fall together before the shuffle, so a group of copies is one row a task
    distinct = write_table(rows.select("v").mapInArrow(lambda it: _keys(it, dim), "x binary").distinct(), "fit_list")
    sums = distinct.mapInArrow(lambda it: _sums(it, dim), "k int, n long, s decimal(38,0)").groupBy("k").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("k").collect()
    if not sums:
        return None
    n, total = int(sums[0]["n"]), [int(r["s"]) for r in sums]

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        return (centred(unpacked_rows(batch.column(0).to_pylist(), dim), n, total) / n).astype(np.float64)

    scatter = moments(distinct, rows_of)[2]
    values, directions = decompose(scatter, n, components)
    return Whitening(dim, n, total, values, directions, float(np.trace(scatter)) / n), distinct


def identity_error(model: Whitening, distinct: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    if not len(model.values):
        return 0.0
    got = moments(distinct, lambda batch: model.whiten(
        centred(unpacked_rows(batch.column(0).to_pylist(), model.dim), model.n, model.sums)))
    return float(np.abs(got[2] / model.n - np.eye(len(model.values))).max())


SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def _project(batches: Iterator[pa.RecordBatch], model: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    share = model.values / model.trace if k else model.values
    for batch in batches:
        mask, v = matrix(batch.column(1), model.dim)
        fits, z = integers(v)
        at = np.flatnonzero(mask)[fits]
        if not len(at) or not k:
            continue
        y = centred(z, model.n, model.sums)
        ids = batch.column(0).take(pa.array(np.repeat(at, k)))
        off = pa.array(square_sums(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), off,
             pa.array(model.whiten(y).reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """One row per usable row of ``vectors (vec_id, embedding)`` and component; columns as in ``SCHEMA``."""
    fitted = fit(vectors, components)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    model, error = fitted[0], identity_error(*fitted)
    return plain(vectors).select("vec_id", "v").mapInArrow(lambda it: _project(it, model, error), SCHEMA)
