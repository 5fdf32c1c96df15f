"""Vector columns in Arrow tasks: usable rows, matrices, the table's vector length, mergeable centred moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(vectors: DataFrame, *more: str) -> DataFrame:
    """``(vec_id long, v array<double>, *more)`` of a vector table; other columns are ignored."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v"), *more)


def usable(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(mask, starts, lengths, flat)`` of a list column; the mask is false for vectors that are null, empty or hold a
    null or non-finite component."""
    offsets, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts, lengths = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    mask = (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0) & col.is_valid().to_numpy(zero_copy_only=False)
    return mask, starts, lengths, flat


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``(mask, rows)``: usable vectors of length ``dim``, one matrix row each."""
    mask, starts, lengths, flat = usable(col)
    mask &= lengths == dim
    return mask, flat[starts[mask][:, None] + np.arange(dim)] if mask.any() else np.zeros((0, dim))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in batches:
        mask, _, lengths, _ = usable(batch.column(0))
        for n, c in zip(*np.unique(lengths[mask], return_counts=True), strict=True):
            total[int(n)] = total.get(int(n), 0) + int(c)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                     ["dim", "n"])


def vector_length(rows: DataFrame) -> int | None:
    """The commonest length of usable vectors (ties: the shorter); None where there is none."""
    found = (rows.select("v").mapInArrow(_lengths, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
             .orderBy(F.col("n").desc(), "dim").first())
    return None if found is None else int(found["dim"])


Moments = tuple[int, np.ndarray, np.ndarray]


def moments_of(y: np.ndarray) -> Moments:
    """Count, mean and centred scatter of rows; centred before multiplying."""
    mean = y.mean(axis=0)
    c = y - mean
    return len(y), mean, c.T @ c


def merge_moments(a: Moments, b: Moments) -> Moments:
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


STATE = "part long, n long, mean binary, scatter binary"


def _state(part: int, m: Moments) -> tuple:
    return part, m[0], m[1].tobytes(), m[2].tobytes()


def _merged(frame: pd.DataFrame) -> Moments:
    out = None
    for r in frame.sort_values("part").itertuples(index=False):
        mean = np.frombuffer(r.mean)
        m = int(r.n), mean, np.frombuffer(r.scatter).reshape(len(mean), len(mean))
        out = m if out is None else merge_moments(out, m)
    return out


def moments(rows: DataFrame, to_matrix) -> Moments | None:
    """Moments of the matrices that ``to_matrix(batch)`` makes of the rows' Arrow batches; None without a row.

    One state per task, merged in a tree of groups of 16, so no task and not the driver sees more than 16 at once.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            y = to_matrix(batch)
            if len(y):
                state = moments_of(y) if state is None else merge_moments(state, moments_of(y))
        if state is not None:
            cols = zip(_state(TaskContext.get().partitionId(), state), (pa.int64(), pa.int64(), pa.binary(), pa.binary()),
                       strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in cols], ["part", "n", "mean", "scatter"])

    def combine(key, frame):
        return pd.DataFrame([_state(int(key[0]), _merged(frame))], columns=["part", "n", "mean", "scatter"])

    left, states = rows.rdd.getNumPartitions(), rows.mapInArrow(local, STATE)
    while left > 16:
        left = -(-left // 16)
        states = states.withColumn("to", F.floor(F.col("part") / 16)).groupBy("to").applyInPandas(combine, STATE)
    last = states.toPandas()
    return _merged(last) if len(last) else None
