"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import ensure_checkpoint_dir, give_back, materialize, ship_package  # noqa: F401

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these bytes.
WORD_GAP = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound Arrow batches (whole long texts travel in them).

    The row bound is only lowered, never raised, so a cluster's own smaller setting holds.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > 1000:
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back: lineage ends at files that outlive executors."""
    return materialize(df, name)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder (not created yet)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def free_prefix(columns: list[str]) -> str:
    """A prefix that none of the column names has, whatever their case: for temporary columns beside them."""
    prefix = "_t_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64 arrays (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def long_lists(rows: list[np.ndarray]) -> pa.Array:
    """An Arrow ``list<int64>`` column from int64 arrays."""
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


#: nodes whose edges are matched by a broadcast at most
HUBS = 50_000


def _with_least(edges: DataFrame, most: int) -> DataFrame:
    """``edges (u, v)``, at most ``most`` rows, with ``m``, the least ``v`` of each ``u``.

    Nodes with more than ``most / HUBS`` edges (so at most ``HUBS`` of them) are sent to all tasks: the edges of a large
    star's centre stay where they are. All other nodes meet theirs by a join on ``u``.
    """
    per = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
    limit = max(64, most // HUBS)
    hubs = F.broadcast(per.where(F.col("d") > limit).select("u", F.col("m").alias("hub_m")))
    tagged = edges.join(hubs, "u", "left")
    light = tagged.where("hub_m is null").select("u", "v").join(per.where(F.col("d") <= limit).select("u", "m"), "u")
    return light.unionByName(tagged.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every node of an undirected link table; component is the smallest reachable id.

    Alternates two star steps (link every larger neighbour to the smallest neighbour, then every smaller one) until
    nothing changes. Each step is a grouped minimum with partial aggregation and a join that spares the edges of large
    stars the shuffle; its edges are written to the shared checkpoint folder. Rows with a null end and self links are ignored; no links give an empty table.
    """
    edges = write_table(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
                        .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "cc")
    stamp, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_least(both, 2 * n).select("u", "v", F.least("u", "m").alias("m"))
        large = write_table(near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                            .distinct(), "cc_large")
        # each node now hangs on smaller ones only: link them to the smallest of them
        small = (_with_least(large, n).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m")))
                                              .alias("e")).select("e.u", F.col("e.m").alias("v"))
                 .where("u <> v").distinct())
        edges = write_table(small, "cc")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if stamp == (now["n"], now["x"]):
            break
        stamp, n = (now["n"], now["x"]), now["n"]
    root = edges.groupBy("v").agg(F.first("v").alias("component")).select(F.col("v").alias("id"), "component")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(root)
