"""Approximate nearest neighbours by cosine: one robust-pruned directed graph per shard, beam search in every shard.

* Equal vectors are one node, which keeps the ``k + 1`` smallest ids of its rows: a query needs no more of them, so a
  group of copies, however large, costs one node. Ranking by a window with a partial limit drops the rest in the tasks
  that read them.
* Nodes are dealt by a hash of their vector into shards of about ``shard_rows``. One task builds a shard's graph: nodes
  join in batches of growing size; a greedy beam search from the centre proposes each node's neighbours, and robust
  pruning keeps the nearest one and drops those that it is closer to by the factor ``alpha``, again and again, so the
  edges that stay point in different directions. Edges are added in reverse too; an overfull node is pruned again.
* The graph is written as a table of nodes. For the search, queries go to every shard: rows of a shard are sorted with
  its nodes first, so a task loads one graph and streams the queries through it, an Arrow batch at a time. No task and
  not the driver holds all queries or more than one shard. A shard answers each query with its ``k`` best, in double
  precision; a window with a partial limit merges the shards.

Batches of searches advance together in numpy: each step expands the best unexpanded nodes of every beam at once.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with a null id or a
length that is not the table's commonest (ties: the shorter). Rows with the query's id are never its neighbours; an id with several vectors asks once for each, a repeated row once. Every node can
be reached from its graph's start, so a shard of at most ``beam`` nodes is searched whole and fewer than ``k`` candidates
are all returned. Ties go to the smaller id. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import prepare, write_table
from textlake.llm.vectors import matrix, plain, vector_length

NONE = np.float32(np.inf)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length one in double; scaled by the largest component first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


class Graph:
    """A directed graph over unit vectors; ``edges`` (nodes, room) holds node numbers, unused places hold ``n``."""

    def __init__(self, units: np.ndarray, degree: int = 32, alpha: float = 1.2, beam: int = 64):
        n = len(units)
        self.n, self.degree, self.alpha, self.beam = n, degree, alpha, beam
        #: a zero row stands at place ``n``
        self.x = np.concatenate([units, np.zeros((1, units.shape[1]))]).astype(np.float32)
        self.edges = np.full((n + 1, degree + degree // 2), n, np.int32)
        self.used = np.zeros(n + 1, np.int32)
        middle = units.mean(axis=0) if n else np.zeros(units.shape[1])
        self.start = int(np.argmax(units @ middle)) if n else 0

    # search --------------------------------------------------------------------------------------------------
    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beams of a batch of unit vectors: node numbers and distances ``1 - cosine``, nearest first."""
        b, n = len(q), self.n
        rows = np.arange(b)
        ids, dist = np.full((b, beam), n, np.int32), np.full((b, beam), NONE)
        open_ = np.zeros((b, beam), bool)
        ids[:, 0], dist[:, 0], open_[:, 0] = self.start, 1 - q @ self.x[self.start], True
        # the step's place at which a node was first met, so a node that two expanded ones share is taken once
        place = np.arange(1, width * self.edges.shape[1] + 1, dtype=np.uint16)
        met = np.zeros((b, n + 1), np.uint16)
        met[:, [self.start, n]] = len(place) + 1
        width = min(width, beam)
        while True:
            waiting = np.where(open_[rows], dist[rows], NONE)
            pick = np.argpartition(waiting, width - 1, axis=1)[:, :width]
            live = np.take_along_axis(waiting, pick, axis=1) < NONE
            some = live.any(axis=1)
            rows, pick, live = rows[some], pick[some], live[some]
            if not len(rows):
                break
            at = rows[:, None]
            open_[at, pick] = False
            near = self.edges[np.where(live, ids[at, pick], n)].reshape(len(rows), -1)
            fresh = met[at, near] == 0
            i, j = np.nonzero(fresh)
            node = near[i, j]
            met[rows[i], node] = place[j]
            once = met[rows[i], node] == place[j]
            i, j, node = i[once], j[once], node[once]
            d = np.full(near.shape, NONE)
            d[i, j] = 1 - np.einsum("ij,ij->i", self.x[node], q[rows[i]])
            d = np.concatenate([dist[rows], d], axis=1)
            keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            dist[rows] = np.take_along_axis(d, keep, axis=1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), keep, axis=1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], fresh], axis=1), keep, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        dist = np.take_along_axis(dist, order, axis=1)
        return np.where(dist < NONE, np.take_along_axis(ids, order, axis=1), n), dist

    # build ---------------------------------------------------------------------------------------------------
    def prune(self, nodes: np.ndarray, pool: np.ndarray) -> None:
        """Edges of ``nodes`` anew from their candidate ``pool`` (rows of node numbers)."""
        n, b = self.n, len(nodes)
        pool = np.where(pool == nodes[:, None], n, pool)
        pool = np.sort(pool, axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = n
        xs, own = self.x[pool], self.x[nodes]
        d = np.where(pool == n, NONE, 1 - np.einsum("bcd,bd->bc", xs, own))
        between = 1 - np.matmul(xs, xs.transpose(0, 2, 1))
        new, count, at = np.full((b, self.edges.shape[1]), n, np.int32), np.zeros(b, np.int32), np.arange(b)
        for _ in range(self.degree):
            pick = d.argmin(axis=1)
            live = d[at, pick] < NONE
            if not live.any():
                break
            r, c = at[live], pick[live]
            new[r, count[r]] = pool[r, c]
            count[r] += 1
            # squared Euclidean distances are twice 1 - cosine: a factor on distances is squared here
            d[r] = np.where(np.float32(self.alpha**2) * between[r, c] <= d[r], NONE, d[r])
            d[r, c] = NONE
        self.edges[nodes], self.used[nodes] = new, count

    def link_back(self, nodes: np.ndarray) -> None:
        """An edge from every new neighbour of ``nodes`` back to them."""
        src = np.repeat(nodes, self.used[nodes])
        to = self.edges[nodes][np.arange(self.edges.shape[1]) < self.used[nodes][:, None]]
        order = np.argsort(to, kind="stable")
        to, src = to[order], src[order]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        room = self.edges.shape[1]
        fits = self.used[target] + count <= room
        slot = np.arange(len(to)) - np.repeat(first, count) + np.repeat(self.used[target], count)
        ok = np.repeat(fits, count)
        self.edges[to[ok], slot[ok]] = src[ok]
        self.used[target[fits]] += count[fits].astype(np.int32)
        over, first, count = target[~fits], first[~fits], count[~fits]
        by_count = np.argsort(count, kind="stable")
        for lo in range(0, len(over), 256):
            part = by_count[lo:lo + 256]
            wide = int(count[part].max())
            at = first[part][:, None] + np.arange(wide)
            extra = np.where(np.arange(wide) < count[part][:, None], src[np.minimum(at, len(src) - 1)], self.n)
            self.prune(over[part], np.concatenate([self.edges[over[part]], extra.astype(np.int32)], axis=1))

    def build(self, batch: int = 128, seed: int = 5) -> Graph:
        order = np.random.default_rng(seed).permutation(self.n)
        order = np.concatenate([[self.start], order[order != self.start]]) if self.n else order
        at = 1
        while at < self.n:
            # a batch is never larger than the graph it joins
            part = order[at:at + min(batch, at)]
            ids, _ = self.search(self.x[part], self.beam)
            self.prune(part, ids)
            self.link_back(part)
            at += len(part)
        self.connect()
        return self

    def spread(self, reached: np.ndarray, new: np.ndarray) -> None:
        """Marks in ``reached`` all that can be reached from ``new`` nodes."""
        while len(new):
            reached[new] = True
            near = np.unique(self.edges[new])
            new = near[~reached[near]]

    def connect(self) -> None:
        """An edge to every node that no path from the start reaches, from the nearest node found for it."""
        reached = np.zeros(self.n + 1, bool)
        reached[self.n] = True
        self.spread(reached, np.array([self.start])[:self.n])
        for node in np.flatnonzero(~reached).tolist():
            if reached[node]:
                continue
            to = int(self.search(self.x[[node]], self.beam)[0][0, 0])
            if self.used[to] == self.edges.shape[1]:
                self.edges = np.concatenate([self.edges, np.full((self.n + 1, 8), self.n, np.int32)], axis=1)
            self.edges[to, self.used[to]] = node
            self.used[to] += 1
            self.spread(reached, np.array([node]))


def best_of(units: np.ndarray, found: np.ndarray, q: np.ndarray, own: np.ndarray, ids: list[np.ndarray], k: int
            ) -> Iterator[tuple[int, int, float]]:
    """``(query number, id, cosine)`` of the ``k`` best rows among the found nodes, in double precision."""
    n = len(units)
    for j in range(len(q)):
        nodes = found[j][found[j] < n]
        score = np.einsum("ij,ij->i", units[nodes], np.broadcast_to(q[j], (len(nodes), q.shape[1])))
        rows = sorted((-s, i) for s, node in zip(score.tolist(), nodes.tolist(), strict=True)
                      for i in ids[node].tolist() if i != own[j])
        for s, i in rows[:k]:
            yield j, i, -s


def _raw(rows: list[bytes], dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(-1, dim).astype(np.float64)


def _build(frame: pd.DataFrame, dim: int, kind: str, degree: int, alpha: float, beam: int) -> pd.DataFrame:
    """Rows ``(shard, node, vec_ids, x, edges)`` of a shard's graph."""
    frame = frame.sort_values(["x", "vec_id"], kind="stable")
    x = frame["x"].to_numpy()
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    vectors = x[first].tolist()
    ids = np.split(frame["vec_id"].to_numpy(np.int64), first[1:])
    graph = Graph(unit_rows(_raw(vectors, dim, kind)), degree, alpha, beam).build()
    edges = [graph.edges[k, :graph.used[k]].tobytes() for k in range(graph.n)]
    return pd.DataFrame({"shard": frame["shard"].iloc[0], "node": np.arange(graph.n), "start": graph.start,
                         "vec_ids": ids, "x": vectors, "edges": edges})


class Shard:
    """A graph loaded from its rows, with the ids of its nodes."""

    def __init__(self, nodes: pd.DataFrame, dim: int, kind: str):
        nodes = nodes.sort_values("node")
        self.units = unit_rows(_raw(nodes["x"].tolist(), dim, kind))
        self.ids = [np.asarray(i, np.int64) for i in nodes["vec_ids"]]
        self.graph = Graph(self.units)
        self.graph.start = int(nodes["start"].iloc[0])
        rows = [np.frombuffer(e, np.int32) for e in nodes["edges"]]
        self.graph.edges = np.full((len(rows) + 1, max(map(len, rows), default=0)), len(rows), np.int32)
        for k, e in enumerate(rows):
            self.graph.edges[k, :len(e)] = e


def _answers(frames: Iterator[pd.DataFrame], dim: int, kind: str, beam: int, k: int) -> Iterator[pd.DataFrame]:
    """Streams rows sorted by (shard, node first, query): collects a shard's nodes, then answers its queries."""
    held: list[pd.DataFrame] = []
    shard, number = None, None
    for frame in frames:
        for s, part in frame.groupby("shard", sort=True):
            if s != number:
                held, shard, number = [], None, s
            nodes, asks = part[part["query_id"].isna()], part[part["query_id"].notna()]
            if len(nodes):
                held.append(nodes)
            if not len(asks) or (shard is None and not held):  # a shard without nodes answers nothing
                continue
            if shard is None:
                shard = Shard(pd.concat(held), dim, kind)
                held = []
            own = asks["query_id"].to_numpy(np.int64)
            raw = asks["x"].tolist()
            q = unit_rows(_raw(raw, dim, kind))
            for lo in range(0, len(q), 256):
                hi = min(lo + 256, len(q))
                found, _ = shard.graph.search(q[lo:hi].astype(np.float32), beam)
                rows = list(best_of(shard.units, found, q[lo:hi], own[lo:hi], shard.ids, k))
                yield pd.DataFrame({"query_id": [own[lo + j] for j, _, _ in rows], "x": [raw[lo + j] for j, _, _ in rows],
                                    "vec_id": [i for _, i, _ in rows], "score": [s for _, _, s in rows]})


def _encoded(batches: Iterator[pa.RecordBatch], dim: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mask, v = matrix(batch.column(1), dim)
        full = v.any(axis=1)
        at = np.flatnonzero(mask)[full]
        raw = [r.tobytes() for r in v[full].astype(kind)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(raw, pa.binary())], ["vec_id", "x"])


RESULT = "query_id long, rank int, vec_id long, score double"


def search_all(vectors: DataFrame, every: int = 50, k: int = 5, shard_rows: int = 16_384, degree: int = 32,
               alpha: float = 1.2, build_beam: int = 64, beam: int = 128) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    prepare(spark)
    # vectors travel as floats where the table holds floats: every one of them is exact
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = plain(vectors).where(F.col("vec_id").isNotNull())
    dim = vector_length(rows)
    if dim is None:
        return spark.createDataFrame([], RESULT)
    usable = write_table(rows.mapInArrow(lambda it: _encoded(it, dim, kind), "vec_id long, x binary").distinct(),
                         "graph_rows")
    shards = max(1, -(-usable.count() // shard_rows))
    low = Window.partitionBy("x").orderBy("vec_id")
    few = usable.withColumn("place", F.row_number().over(low)).where(F.col("place") <= k + 1).drop("place")
    # more partitions than shards, so that few shards share one
    dealt = few.withColumn("shard", F.pmod(F.xxhash64("x"), F.lit(shards)).cast("int")).repartition(4 * shards, "shard")
    graph = write_table(dealt.groupBy("shard").applyInPandas(
        lambda f: _build(f, dim, kind, degree, alpha, build_beam),
        "shard int, node int, start int, vec_ids array<long>, x binary, edges binary"), "graph")
    asks = usable.where(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("int").alias("node"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("array<long>").alias("vec_ids"), "x",
        F.lit(None).cast("binary").alias("edges"), F.col("vec_id").alias("query_id"))
    both = graph.withColumn("query_id", F.lit(None).cast("long")).unionByName(asks)
    found = (both.repartition(4 * shards, "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())
             .mapInPandas(lambda it: _answers(it, dim, kind, beam, k), "query_id long, x binary, vec_id long, score double"))
    best = Window.partitionBy("query_id", "x").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
