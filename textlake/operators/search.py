"""Cosine search of text fragments (or stored vectors) against one or many queries, and statistics of all similarities.

Items are scored block by block (:mod:`.tiles`); what leaves a task is a mergeable state, never a pair table:

* Top-n: a task keeps each query's own n best. A ``row_number`` window with a partial group limit merges the tasks.
* No limit: the rows above the threshold are the result. They are ranked by a range partition and partition counts
  (:func:`.tiles.ranked`), so a query with very many hits spreads over tasks.
* Statistics: a histogram per query with count, centred moments, least and largest value of each bin. The median is
  selected exactly by counting again within the bin that holds it, until the two middle values are known.

Ranking key: similarity rounded to 6 places (half away from zero, as DuckDB's ``round``), then the item keys
ascending. Repeated texts give scaled vectors whose cosines agree only to the last bit; rounding makes them tie
and the keys break the tie, so the result is deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import np_round6, round6
from ..session import materialize
from .tiles import BLOCK_ROWS, MAX_BROADCAST_QUERIES, ranked, score

DEFAULT_MAX_BROADCAST_QUERIES = MAX_BROADCAST_QUERIES


def _type_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


class TopN:
    """The best ``n`` rows per query met so far (all rows above the threshold where ``n`` is None)."""

    def __init__(self, queries: pd.DataFrame, query_key: str, keys: list[str], n: int | None, threshold: float):
        self.ids, self.query_key, self.keys, self.n, self.threshold = queries[query_key], query_key, keys, n, threshold
        self.floor, self.held, self.rows = np.full(len(queries), -np.inf), [], 0

    def add(self, names: pd.DataFrame, sims: np.ndarray) -> Iterator[pd.DataFrame]:
        near = np_round6(sims)
        with np.errstate(invalid="ignore"):
            keep = (sims >= self.threshold) & (near >= self.floor)
        if self.n is not None and len(near) > 4 * self.n:  # at most the batch's own n best, and their ties
            low = np.partition(np.where(keep, near, -np.inf), len(near) - self.n, axis=0)[len(near) - self.n]
            keep &= near >= low
        i, j = np.nonzero(keep)
        if not len(i):
            return
        part = names.iloc[i].assign(_j=j, similarity=near[i, j])
        if self.n is None:
            yield self._named(part)
            return
        self.held.append(part)
        self.rows += len(part)
        if self.rows > max(50_000, 8 * self.n * len(self.ids)):
            self._prune()

    def _prune(self) -> None:
        """Cuts every query's rows to its best ``n``. Batches may hold many rows that tie, so this may take several."""
        part = pd.concat(self.held).sort_values(["_j", "similarity", *self.keys], ascending=[True, False] + [True] * len(self.keys))
        part = part.groupby("_j", sort=False).head(self.n)
        full = part.groupby("_j")["similarity"].agg(["min", "size"])
        full = full[full["size"] == self.n]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()
        self.held, self.rows = [part], len(part)

    def _named(self, part: pd.DataFrame) -> pd.DataFrame:
        named = part.assign(**{self.query_key: self.ids.to_numpy()[part["_j"].to_numpy()]})
        return named[[self.query_key, *self.keys, "similarity"]]

    def finish(self) -> Iterator[pd.DataFrame]:
        if self.held:
            self._prune()
            yield self._named(self.held[0])


def top_n_schema(items: DataFrame, queries: DataFrame, item_keys, query_key: str) -> str:
    keys = ", ".join(f"`{k}` {_type_of(items, k)}" for k in item_keys)
    return f"`{query_key}` {_type_of(queries, query_key)}, {keys}, similarity double"


def merge_top_n(found: DataFrame, query_key: str, item_keys, top_n: int | None) -> DataFrame:
    """``found`` candidates ranked per query from 1 (best); the best ``top_n``, or all."""
    order = [F.col("similarity").desc(), *[F.col(k).asc() for k in item_keys]]
    if top_n is None:
        return ranked(found, query_key, order)
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(*order))
    return found.withColumn("rank", place).filter(F.col("rank") <= int(top_n))


def top_n_search(items: DataFrame, queries: DataFrame, *, item_keys, query_key: str, vec_col: str = "embedding",
                 query_vec_col: str = "embedding", top_n: int | None = 3, threshold: float | None = 0.0,
                 max_broadcast_queries: int = DEFAULT_MAX_BROADCAST_QUERIES, query_row_bound: int | None = None,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-n items per query by cosine similarity, with ``rank`` from 1 (best).

    ``threshold`` keeps similarity ≥ threshold on the unrounded value (zero vectors never pass);
    ``top_n=None`` keeps every item above the threshold. Null vectors, and those of another length than the queries',
    match nothing. Rows that share a query key are one query with several vectors.
    """
    keys, floor = list(item_keys), -np.inf if threshold is None else float(threshold)
    asked = queries.select(query_key, F.col(query_vec_col).alias("_q"))
    found = score(items, asked, lambda q: TopN(q, query_key, keys, top_n, floor),
                  top_n_schema(items, queries, keys, query_key), item_keys=keys, vec_col=vec_col, query_vec_col="_q",
                  max_broadcast_queries=max_broadcast_queries, row_bound=query_row_bound, block_rows=block_rows)
    return merge_top_n(found, query_key, keys, top_n)


# ------------------------------------------------------------------ statistics
BINS = 256


class Histogram:
    """Per query: count, centred moments, least and largest value of each bin between ``_lo`` and ``_hi``.

    Values below ``_lo`` are bin 0, those above ``_hi`` bin ``BINS + 1``, so every value is counted in every pass and
    ranks never depend on an earlier pass.
    """

    def __init__(self, queries: pd.DataFrame, query_key: str):
        self.ids, self.query_key, q = queries[query_key], query_key, len(queries)
        self.lo, self.hi = (queries[c].to_numpy(np.float64) for c in ("_lo", "_hi"))
        size = q * (BINS + 2)
        self.n, self.d, self.dd = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        self.least, self.most = np.full(size, np.inf), np.full(size, -np.inf)
        width = (self.hi - self.lo) / BINS
        self.scale = np.where(width > 0, 1 / np.where(width > 0, width, 1), 0.0)
        self.centre = (self.lo[:, None] + width[:, None] * (np.arange(BINS + 2) - 0.5)).ravel()

    def add(self, names: pd.DataFrame, sims: np.ndarray) -> Iterator[pd.DataFrame]:
        i, j = np.nonzero(~np.isnan(sims))
        v = sims[i, j]
        lo, hi = self.lo[j], self.hi[j]
        inside = np.clip(((v - lo) * self.scale[j]).astype(np.int64), 0, BINS - 1) + 1
        slot = j * (BINS + 2) + np.where(v < lo, 0, np.where(v > hi, BINS + 1, inside))
        off = v - self.centre[slot]
        self.n += np.bincount(slot, minlength=len(self.n))
        self.d += np.bincount(slot, off, len(self.n))
        self.dd += np.bincount(slot, off * off, len(self.n))
        np.minimum.at(self.least, slot, v)
        np.maximum.at(self.most, slot, v)
        return iter(())

    def finish(self) -> Iterator[pd.DataFrame]:
        used = np.flatnonzero(self.n)
        yield pd.DataFrame({self.query_key: self.ids.to_numpy()[used // (BINS + 2)], "bin": (used % (BINS + 2)).astype(np.int32),
                            "n": self.n[used], "centre": self.centre[used], "d": self.d[used], "dd": self.dd[used],
                            "least": self.least[used], "most": self.most[used]})


def _bins(items: DataFrame, asked: DataFrame, query_key: str, keys: list[str], vec_col: str, **how) -> DataFrame:
    """Merged bins per query with the number of values before each; a query has at most ``BINS + 2`` rows."""
    schema = (f"`{query_key}` {_type_of(asked, query_key)}, bin int, n long, centre double, d double, dd double, "
              "least double, most double")
    parts = score(items, asked, lambda q: Histogram(q, query_key), schema, item_keys=keys, vec_col=vec_col,
                  query_vec_col="_q", **how)
    merged = parts.groupBy(query_key, "bin").agg(
        F.sum("n").alias("n"), F.first("centre").alias("centre"), F.sum("d").alias("d"), F.sum("dd").alias("dd"),
        F.min("least").alias("least"), F.max("most").alias("most"))
    w = Window.partitionBy(query_key)
    return merged.select("*", F.sum("n").over(w).alias("total"), F.coalesce(F.sum("n").over(
        w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def _middle(bins: DataFrame, query_key: str) -> DataFrame:
    """``(query, low, high, _lo, _hi)``: the two middle values where the bins tell them, else the range to look in.

    Middle ranks in two bins are the largest value of one and the least of the next; in one bin they are known where the
    bin holds a single value (or one of two at its ends).
    """
    k1, k2 = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    first, last = F.col("before"), F.col("before") + F.col("n") - 1

    def value(k):
        return (F.when((k < first) | (k > last), F.lit(None)).when(k == first, F.col("least")).when(k == last, F.col("most"))
                .when(F.col("least") == F.col("most"), F.col("least")))

    holds = (k1 >= first) & (k1 <= last) | (k2 >= first) & (k2 <= last)
    return bins.where(holds).groupBy(query_key).agg(
        F.max(value(k1)).alias("low"), F.max(value(k2)).alias("high"), F.min("least").alias("_lo"),
        F.max("most").alias("_hi"))


def similarity_statistics(items: DataFrame, queries: DataFrame, *, item_keys, query_key: str, vec_col: str = "embedding",
                          query_vec_col: str = "embedding", max_broadcast_queries: int = DEFAULT_MAX_BROADCAST_QUERIES,
                          query_row_bound: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query, n_scored, sim_min, sim_max, sim_mean, sim_median, sim_std`` over the similarities of all items, rounded to
    6 places (zero vectors are not scored; a query without any similarity gives no row).

    Every pass scores all items and sends at most ``BINS + 2`` rows per query and task. The first one gives everything
    but the median; each further one looks ``BINS`` times closer around the middle of the queries not settled yet: three
    or four passes for a billion items. ``items`` are read once per pass, so they should be a table. A query key must
    not repeat.
    """
    keys = list(item_keys)
    how = {"max_broadcast_queries": max_broadcast_queries, "row_bound": query_row_bound, "block_rows": block_rows}
    vectors = materialize(queries.select(query_key, F.col(query_vec_col).alias("_q")), "stat-queries")
    asked = vectors.select("*", F.lit(-1.0).alias("_lo"), F.lit(1.0).alias("_hi"))
    bins = materialize(_bins(items, asked, query_key, keys, vec_col, **how), "stat-bins")
    w, c = Window.partitionBy(query_key), F.col("centre")
    mean = F.sum(F.col("d") + F.col("n") * c).over(w) / F.col("total")
    spread = F.col("dd") + 2 * F.col("d") * (c - F.col("_mean")) + F.col("n") * (c - F.col("_mean")) * (c - F.col("_mean"))
    basics = bins.withColumn("_mean", mean).groupBy(query_key).agg(
        F.first("total").alias("n_scored"), F.min("least").alias("_min"), F.max("most").alias("_max"),
        F.first("_mean").alias("_mean"), F.sqrt(F.greatest(F.sum(spread) / F.first("total"), F.lit(0.0))).alias("_std"))
    found, open_ = [], F.col("low").isNull() | F.col("high").isNull()
    while True:
        middle = materialize(_middle(bins, query_key), "stat-middle")
        found.append(middle.where(~open_).select(query_key, "low", "high"))
        left = middle.where(open_).select(query_key, "_lo", "_hi")
        if left.isEmpty():
            break
        bins = _bins(items, vectors.join(left, query_key), query_key, keys, vec_col, **how)
    settled = found[0]
    for more in found[1:]:
        settled = settled.unionByName(more)
    return basics.join(settled, query_key).select(
        query_key, "n_scored", round6("_min").alias("sim_min"), round6("_max").alias("sim_max"),
        round6("_mean").alias("sim_mean"), round6((F.col("low") + F.col("high")) / 2).alias("sim_median"),
        round6("_std").alias("sim_std"))
