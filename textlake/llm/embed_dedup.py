"""Embedding near-duplicates: int8 tile products with rigorous error bounds, exact recompute of possible links.

Vectors of one label are linked when their double-precision cosine is >= ``threshold``; groups are the connected
components of the links.

* Equal vectors of a label collapse to one class (its smallest id and its row count).
* Each class vector is scaled to unit length and quantised to int8 with its own step ``t``: ``x = t q + e``. The row
  stores ``|e|`` and ``|t q|``, rounded up. For two vectors ``|x.y - t_x t_y q_x.q_y| <= |t q_x| |e_y| + |e_x|``,
  so a pair below ``threshold`` by more than that bound cannot be a link and is never computed in full precision.
* Classes of a label are dealt into blocks of about ``block`` rows; every pair of blocks is one tile, one task's work.
  A hot label has many tiles, never one large one. The int8 products run as float32 matrix products, which are exact
  for integers while ``dim * 127^2 < 2^24``; longer vectors are multiplied in slices of 1,000 components.
* Only pairs above ``threshold - bound`` are recomputed, in double. A tile returns one link count per class and a
  spanning forest of its links, so its output is linear in its rows however many pairs are linked.

All pairs of a label have to be covered, so the work grows with the square of a label's distinct vectors; the labels
are the blocking. Null labels, and vectors that are null, empty, zero or hold a null or non-finite component, link
with nothing; so do null ids. Vectors of different lengths under one label link with nothing. Repeated rows of an
id count as separate vectors in ``n_links``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import connected_components, prepare, write_table
from textlake.session import broadcast_if_small

_SLICE = 1000
_SLACK = 1e-6  # over the rounding of the double sums in the bounds and of the tile's float32 scaling


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """(int8 vector, step, upper bound of the error's norm, upper bound of the quantised norm) of a unit vector."""
    step = float(np.abs(x).max()) / 127.0
    q = np.rint(x / step)
    err, norm = float(np.linalg.norm(x - step * q)), float(np.linalg.norm(step * q))
    return q.astype(np.int8), step, err * (1 + 1e-9) + 1e-15, norm * (1 + 1e-9)


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vector in double; scaled by its largest component first, so that no square over- or underflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [quantise(unit(np.asarray(v))) for v in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("u"), batch.column("id"), batch.column("c"), batch.column("v"),
             pa.array([g[0].tobytes() for g in got], pa.binary()), *(pa.array([g[k] for g in got], pa.float64())
                                                                   for k in (1, 2, 3))],
            ["label", "u", "id", "c", "v", "q", "step", "err", "norm"])


def _product(qa: np.ndarray, qb: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, as doubles."""
    if qa.shape[1] <= _SLICE:
        return (qa.astype(np.float32) @ qb.astype(np.float32).T).astype(np.float64)
    return sum(_product(qa[:, k:k + _SLICE], qb[:, k:k + _SLICE]) for k in range(0, qa.shape[1], _SLICE))


def tile_links(a: pd.DataFrame, b: pd.DataFrame, same: bool, threshold: float, strip: int = 512
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``(i, j)`` of linked rows of two blocks, a strip of ``a`` at a time. ``same``: only ``i < j``."""
    if not len(a) or not len(b):
        return
    qa, qb = (np.stack([np.frombuffer(q, np.int8) for q in x["q"]]) for x in (a, b))
    xa, xb = (np.stack([unit(np.asarray(v)) for v in x["v"]]) for x in (a, b))
    sa, ea, na = (a[k].to_numpy(np.float64) for k in ("step", "err", "norm"))
    sb, eb = (b[k].to_numpy(np.float64) for k in ("step", "err"))
    for lo in range(0, len(a), strip):
        hi = min(lo + strip, len(a))
        approx = _product(qa[lo:hi], qb) * sa[lo:hi, None] * sb[None, :]
        bound = na[lo:hi, None] * eb[None, :] + ea[lo:hi, None] + _SLACK
        maybe = approx + bound >= threshold
        if same:
            maybe &= np.arange(lo, hi)[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(maybe)
        for k in range(0, len(i), 65_536):
            ii, jj = i[k:k + 65_536], j[k:k + 65_536]
            hit = np.einsum("ij,ij->i", xa[lo + ii], xb[jj]) >= threshold
            yield lo + ii[hit], jj[hit]


class Forest:
    """Union-find that keeps only the links which joined two trees."""

    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def add(self, x: int, y: int) -> None:
        rx, ry = self.root(x), self.root(y)
        if rx != ry:
            self.up[max(rx, ry)] = min(rx, ry)
            self.kept.append((x, y))


def _tile(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts and forest of one tile: rows ``(u, other, n)`` of class numbers; ``other`` null for a count, ``n`` 0 for a forest edge."""
    rows: list[pd.DataFrame] = []
    for _, part in pdf.groupby(pdf["v"].map(len), sort=True):
        i0, j0 = part["ti"].iloc[0], part["tj"].iloc[0]
        a = part[part["blk"] == i0].reset_index(drop=True)
        same = i0 == j0
        b = a if same else part[part["blk"] == j0].reset_index(drop=True)
        ids_a, ids_b, ca, cb = a["u"].to_numpy(), b["u"].to_numpy(), a["c"].to_numpy(), b["c"].to_numpy()
        na, nb, shift = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 0 if same else len(a)
        forest = Forest(len(a) + (0 if same else len(b)))
        for i, j in tile_links(a, b, same, threshold):
            na += np.bincount(i, weights=cb[j], minlength=len(a)).astype(np.int64)
            nb += np.bincount(j, weights=ca[i], minlength=len(b)).astype(np.int64)
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.add(x, y + shift)
        ids = ids_a if same else np.concatenate([ids_a, ids_b])
        counts = na + nb if same else np.concatenate([na, nb])
        some = counts > 0
        rows.append(pd.DataFrame({"u": ids[some], "other": pd.array([None] * int(some.sum()), "Int64"),
                                  "n": counts[some]}))
        if forest.kept:
            k = np.array(forest.kept)
            rows.append(pd.DataFrame({"u": ids[k[:, 0]], "other": pd.array(ids[k[:, 1]], "Int64"), "n": 0}))
    return pd.concat(rows) if rows else pd.DataFrame({"u": [], "other": [], "n": []})


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = 2048) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors (vec_id, embedding, label)``."""
    prepare(vectors.sparkSession)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label")
    good = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("v", lambda x: x != 0))
    usable = base.where(good)
    classes = usable.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("c"))
    label_type = vectors.schema["label"].dataType.simpleString()
    v_type = vectors.schema["embedding"].dataType.simpleString()
    # classes go by a number of their own, written once: an id may stand for several vectors
    packed = write_table(classes.select("label", F.monotonically_increasing_id().alias("u"), "id", "c", "v").mapInArrow(
        _quantised, f"label {label_type}, u long, id long, c long, v {v_type}, q binary, step double, err double, "
                    "norm double"), "quantised")
    sizes = packed.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("nb"))
    dealt = packed.join(sizes, "label").withColumn("blk", F.pmod(F.xxhash64("id", "v"), F.col("nb")).cast("int"))
    tiles = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "label", F.least("blk", "o").alias("ti"), F.greatest("blk", "o").alias("tj"), "blk", "u", "c", "v", "q",
        "step", "err", "norm")
    found = write_table(tiles.groupBy("label", "ti", "tj").applyInPandas(
        lambda pdf: _tile(pdf, threshold), "u long, other long, n long"), "tile_links")
    counts = found.where("n > 0").groupBy("u").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("n = 0"), "u", "other").withColumnRenamed("id", "u")
    grouped = write_table(packed.select("label", "v", "u", "id", "c").join(counts, "u", "left").join(groups, "u", "left"),
                          "grouped")
    # a row a component, sent to all tasks where a count proves them few: a large component's rows stay where they are
    least = broadcast_if_small(grouped.where("component is not null").groupBy("component").agg(
        F.min("id").alias("component_id")))
    known = write_table(grouped.join(least, "component", "left").select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id")), "vector_groups")
    named = usable.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~F.coalesce(good, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = named.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
