"""An exact index over stored vectors for cosine search: cells with a centre and a radius, skipped by the triangle inequality.

* Build: centres come from a bounded sample (spherical k-means); every vector belongs to the cell of its nearest centre and
  keeps its angle to it. A cell's radius is the largest of these angles. Both are tables.
* Search: no vector of a cell is nearer to a query than ``angle(query, centre) - radius``. First each query meets the cells
  with the best bounds until they hold enough rows; its n-th best similarity there is a floor. Then only cells whose bound
  reaches the floor are scored. The result equals the full scan's, ties included.
* Pairs of a query and a cell are rows; cells are cut into blocks of bounded size, so a large cell is many tasks' work.

Similarities are rounded to 6 places for ranking, so bounds are compared with that much slack. Vectors that are null, zero,
or of another length than the index's are in no cell and match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize
from .search import TopN, merge_top_n, top_n_schema
from .tiles import dense, tile

SLACK = 2e-6
SAMPLE_ROWS, MAX_CELLS = 20_000, 1024


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles between unit rows; exact enough near 0 that rounding cannot hide a neighbour (see ``SLACK``)."""
    return np.arccos(np.clip(unit(x) @ centres.T, -1.0, 1.0))


def centres_of(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means on a bounded sample; an empty cell keeps its centre."""
    x = unit(sample)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(np.abs(sums).any(axis=1, keepdims=True), unit(sums), centres)
    return centres


@dataclass
class VectorIndex:
    """``rows`` (cell, block, angle, item keys, vector) is a table; ``cells`` holds the numbers of at most ``MAX_CELLS`` cells."""

    rows: DataFrame
    keys: list[str]
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    blocks: np.ndarray


def build_index(items: DataFrame, *, item_keys, vec_col: str = "embedding", cells: int | None = None,
                sample_rows: int = SAMPLE_ROWS, block_rows: int = 16_384) -> VectorIndex:
    """Index of ``items``. ``cells``: about the square root of the row count, at most ``MAX_CELLS``, unless given. The
    centres are fitted on at most ``sample_rows`` rows in the order of a hash of their keys; every row is indexed."""
    keys = list(item_keys)
    src = items.select(*keys, F.col(vec_col).cast("array<double>").alias("_v")).where(
        F.col("_v").isNotNull() & F.exists("_v", lambda c: c != 0) & F.forall("_v", lambda c: c.isNotNull()))
    sizes = src.groupBy(F.size("_v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    dim, total = (int(sizes["n"]), int(sizes["count"])) if sizes else (1, 0)
    src = src.where(F.size("_v") == dim)
    sample = src.select("_v", F.xxhash64(*keys).alias("_h")).orderBy("_h", "_v").limit(sample_rows).collect()
    cells = max(1, min(cells or int(np.sqrt(total)), MAX_CELLS, len(sample) or 1))
    centres = centres_of(np.array([r["_v"] for r in sample], np.float64).reshape(len(sample), dim), cells)
    types = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    held = src.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = angles(dense(batch.column(len(keys)), dim)[1], held.value)
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near]), *batch.columns],
                    ["cell", "angle", *keys, "_v"])

    placed = materialize(src.mapInArrow(assign, f"cell int, angle double, {types}, _v array<double>"), "index-cells")
    radius, count = np.zeros(cells), np.zeros(cells, np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], count[r["cell"]] = r["r"], r["n"]
    blocks = np.maximum(1, -(-count // block_rows))
    of = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
    rows = materialize(placed.withColumn("block", F.pmod(F.xxhash64(*keys), of).cast("int")), "index-rows")
    return VectorIndex(rows, keys, centres, radius, count, blocks)


def _visits(index: VectorIndex, queries: DataFrame, query_key: str, top_n: int | None, threshold: float,
            floors: bool) -> DataFrame:
    """``(query, _id, _q, cell, block)``: where a query has to look. Without ``floors`` the cells with the best bounds until
    they hold ``top_n`` rows; with them (a column ``_floor``) all cells whose bound reaches the floor."""
    held = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.count, index.blocks))
    type_ = queries.schema[query_key].dataType.simpleString()
    dim = index.centres.shape[1]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, count, blocks = held.value
        for batch in batches:
            mask, q = dense(batch.column(2), dim)
            some = q.any(axis=1)
            at, q = np.flatnonzero(mask)[some], q[some]
            if not len(q):
                continue
            bound = np.cos(np.maximum(angles(q, centres) - radius - 1e-7, 0.0)) + SLACK
            possible = (bound >= threshold) & (count > 0)
            if floors:
                floor = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)[at]
                take = possible & (bound >= np.where(np.isnan(floor), -2.0, floor)[:, None])
            else:
                order = np.argsort(np.where(possible, -bound, np.inf), axis=1, kind="stable")
                rows = np.take_along_axis(np.where(possible, count, 0), order, axis=1)
                take = np.zeros_like(possible)
                np.put_along_axis(take, order, np.cumsum(rows, axis=1) - rows < (top_n or 0), axis=1)
                take &= possible
            i, c = np.nonzero(take)
            n = blocks[c]
            block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who = pa.array(at[np.repeat(i, n)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(who) for k in range(3)), pa.array(np.repeat(c, n).astype(np.int32)),
                 pa.array(block.astype(np.int32))], [query_key, "_id", "_q", "cell", "block"])

    cols = [query_key, "_id", "_q", *(["_floor"] if floors else [])]
    return queries.select(*cols).mapInArrow(
        plan, f"`{query_key}` {type_}, _id long, _q array<double>, cell int, block int")


def _score(index: VectorIndex, visits: DataFrame, query_key: str, top_n: int | None, threshold: float) -> DataFrame:
    schema, keys = top_n_schema(index.rows, visits, index.keys, query_key), index.keys
    run = tile(lambda q: TopN(q, query_key, keys, top_n, threshold), keys, "_v", [query_key], "_q",
               to_arrow_schema(StructType.fromDDL(schema)))
    # queries of a cell come in slices of bounded size, so a cell that every query visits is many tasks' work too
    slices = visits.withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(_slices(visits))).cast("int")).drop("_id")
    rows = index.rows.select("cell", "block", *keys, "_v").join(
        slices.select("cell", "block", F.col("_s").alias("_t")).distinct(), ["cell", "block"])
    return rows.groupBy("cell", "block", "_t").cogroup(slices.groupBy("cell", "block", "_s")).applyInArrow(run, schema)


def _slices(visits: DataFrame, most: int = 4096) -> int:
    """How many slices keep the queries of the busiest cell at about ``most`` each."""
    busy = visits.groupBy("cell", "block").count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-int(busy) // most))


def indexed_search(index: VectorIndex, queries: DataFrame, *, query_key: str, query_vec_col: str = "embedding",
                   top_n: int | None = 3, threshold: float | None = 0.0) -> tuple[DataFrame, DataFrame]:
    """``(results, visits)``: results as :func:`.search.top_n_search` gives them on the indexed items, and the (query, cell,
    block) pairs that were scored, for :func:`skipped_share`."""
    low = -2.0 if threshold is None else float(threshold)
    limit = -np.inf if threshold is None else low
    asked = materialize(queries.select(query_key, F.monotonically_increasing_id().alias("_id"),
                                       F.col(query_vec_col).cast("array<double>").alias("_q")), "index-queries")
    near = materialize(_visits(index, asked, query_key, top_n, low, False), "index-visits")
    found = materialize(_score(index, near, query_key, top_n, limit), "index-near")
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("similarity").desc()))
    floor = (found.withColumn("_r", place).where(F.col("_r") == int(top_n)).select(
        F.col(query_key).alias("_k"), F.col("similarity").alias("_floor")) if top_n else
        found.limit(0).select(F.col(query_key).alias("_k"), F.col("similarity").alias("_floor")))
    with_floor = asked.join(floor, asked[query_key].eqNullSafe(floor["_k"]), "left").drop("_k")
    rest = materialize(_visits(index, with_floor, query_key, top_n, low, True).join(
        near.select("_id", "cell", "block"), ["_id", "cell", "block"], "left_anti").select(near.columns), "index-visits")
    out = found.unionByName(_score(index, rest, query_key, top_n, limit))
    return merge_top_n(out, query_key, index.keys, top_n), near.unionByName(rest).select(query_key, "cell", "block")


def skipped_share(index: VectorIndex, visits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row ``(n_queries, n_rows, scored, skipped)``: how many (query, row) pairs were scored and the share left out."""
    sizes = index.rows.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n"))
    scored = visits.join(F.broadcast(sizes), ["cell", "block"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"))
    total = index.rows.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(queries.agg(F.count(F.lit(1)).alias("n_queries")))
    return total.crossJoin(scored).select(
        "n_queries", "n_rows", "scored", (1 - F.col("scored") / (F.col("n_rows") * F.col("n_queries"))).alias("skipped"))
