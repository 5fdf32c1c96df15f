"""Scoring of item vectors against query vectors, block by block, with mergeable states.

A *state* holds what a task has learned about its queries: ``add(keys, sims)`` takes the similarities of a batch of items
(items x queries, NaN for zero vectors), ``finish()`` gives the rows that leave the task. Neither grows with the items,
unless the state's purpose is to emit them.

Two ways to bring both sides together, with the same rows:

* Queries proven few (a count or a bounded fetch): their matrix is broadcast, item vectors never move.
* Otherwise both sides are cut into blocks by a hash, and every pair of blocks is one group, one task's work. Block
  numbers are the shuffle keys, so nothing passes through the driver, repeated query keys are rows like others, and a
  task holds one block of each side whatever the sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import bound_batches, give_back, materialize

MAX_BROADCAST_QUERIES = 4096
BLOCK_ROWS = 32_768


def dense(col: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``(mask, matrix)`` of a list column: rows that are not null, of length ``dim`` and without a null component."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    gaps = np.concatenate([[0], np.cumsum(col.values.is_null().to_numpy(zero_copy_only=False))])
    mask = (np.diff(off) == dim) & col.is_valid().to_numpy(zero_copy_only=False) & (gaps[off[1:]] == gaps[off[:-1]])
    return mask, flat[off[:-1][mask][:, None] + np.arange(dim)] if mask.any() else np.zeros((0, dim))


def cosines(vecs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of every row with every query; NaN where either is zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        sims = (vecs @ queries.T) / (np.sqrt((vecs * vecs).sum(axis=1))[:, None]
                                     * np.sqrt((queries * queries).sum(axis=1))[None, :])
    sims[~np.isfinite(sims)] = np.nan
    return sims


def _feed(state: Any, table: pa.RecordBatch | pa.Table, keys: list[str], vec_col: str, qmat: np.ndarray,
          strip: int = 500_000) -> Iterator[pd.DataFrame]:
    """Similarities go to the state a strip at a time, so that a block's product stays small."""
    mask, vecs = dense(table.column(vec_col), qmat.shape[1])
    names = table.select(keys).filter(pa.array(mask)).to_pandas()
    rows = max(1, strip // max(len(qmat), 1))
    for lo in range(0, len(vecs), rows):
        yield from state.add(names.iloc[lo:lo + rows], cosines(vecs[lo:lo + rows], qmat))


def _stacked(vectors: list) -> np.ndarray:
    """Query matrix; a null vector, or one whose length is not the commonest, is zero and scores nothing."""
    sizes = [len(v) for v in vectors if v is not None]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), -s)) if sizes else 0
    return np.array([v if v is not None and len(v) == dim and None not in v else [0.0] * dim for v in vectors],
                    np.float64).reshape(len(vectors), dim)


def score(items: DataFrame, queries: DataFrame, make_state: Callable[[pd.DataFrame], Any], schema: str, *, item_keys,
          vec_col: str, query_vec_col: str, max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
          row_bound: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of the states. ``make_state`` gets a frame of the query columns other than the vector, in matrix order."""
    bound_batches(items.sparkSession)
    keys = list(item_keys)
    extra = [c for c in queries.columns if c != query_vec_col]
    src = items.select(*keys, vec_col)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    few = None
    if row_bound is None or row_bound <= max_broadcast_queries:
        few = queries.limit(max_broadcast_queries + 1).collect()
    if few is not None and len(few) <= max_broadcast_queries:
        few.sort(key=lambda r: tuple(str(r[c]) for c in extra))
        held = items.sparkSession.sparkContext.broadcast(
            (pd.DataFrame([[r[c] for c in extra] for r in few], columns=extra), _stacked([r[query_vec_col] for r in few])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frame, qmat = held.value
            if not len(frame):
                return
            state = make_state(frame)
            for batch in batches:
                for out in _feed(state, batch, keys, vec_col, qmat):
                    yield from _arrow(out, arrow).to_batches()
            for out in state.finish():
                yield from _arrow(out, arrow).to_batches()
            del state
            give_back()

        return src.mapInArrow(run, schema)
    src = materialize(src, "score-items")
    n_items, n_queries = max(1, -(-src.count() // block_rows)), max(1, -(-queries.count() // (max_broadcast_queries // 2 or 1)))
    left = src.withColumn("_i", F.pmod(F.xxhash64(*keys), F.lit(n_items)).cast("int")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = queries.withColumn("_j", F.pmod(F.xxhash64(*queries.columns), F.lit(n_queries)).cast("int")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))))
    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(
        tile(make_state, keys, vec_col, extra, query_vec_col, arrow), schema)


def _arrow(frame: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pandas(frame, preserve_index=False).cast(schema)


def tile(make_state, keys: list[str], vec_col: str, extra: list[str], query_vec_col: str, arrow: pa.Schema):
    """The function of one pair of blocks; both sides are sorted first, so the result does not depend on the shuffle."""
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if a.num_rows and b.num_rows:
            a, b = (t.sort_by([(k, "ascending") for k in by]) for t, by in ((a, keys), (b, extra)))
            qmat = _stacked(b.column(query_vec_col).to_pylist())
            state = make_state(b.select(extra).to_pandas())
            parts = [*_feed(state, a, keys, vec_col, qmat), *state.finish()]
        return pa.concat_tables([arrow.empty_table(), *(_arrow(p, arrow) for p in parts)])

    return run


def ranked(rows: DataFrame, group_col: str, order: list, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in ``order`` within each group, without a task that sees a whole group.

    Rows are range-partitioned by group and order and written with their partition's number; counts per partition and
    group, a handful of numbers, are added up to give each partition's first place.
    """
    spark = rows.sparkSession
    partitions = partitions or max(spark.sparkContext.defaultParallelism,
                                   int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(rows.repartitionByRange(partitions, F.col(group_col), *order).withColumn(
        "_part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy(group_col, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy(group_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(
        F.col(group_col).alias("_group"), F.col("_part").alias("_p2"), "_before")
    here = F.row_number().over(Window.partitionBy("_part", group_col).orderBy(*order))
    return (placed.withColumn("_here", here)
            .join(before, (F.col("_part") == F.col("_p2")) & F.col(group_col).eqNullSafe(F.col("_group")))
            .withColumn(name, (F.col("_here") + F.col("_before")).cast("int"))
            .drop("_here", "_before", "_part", "_p2", "_group"))
