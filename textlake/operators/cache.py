"""Response cache as an append-only table ``(cache_key, response, ts)``.

The original tool kept one dict in a file, read and rewritten whole on every call. Here the cache is a table:
new entries are appended, the newest entry of a key wins, and an entry is live while its age at ``as_of`` is at
most ``ttl_seconds`` (86,400 s by default, inclusive). ``as_of`` is always a parameter, never the wall clock, so a
plan gives the same answer when it is recomputed.

Probing is a join, never a lookup loop: hits = requests ⋈ live entries, misses = requests ▷ live entries
(left anti join). Keys are SHA-256 hex digests of ``mode-model-text``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Fixed value: cache lifetime of the original tool, in seconds.
CACHE_TTL_SECONDS = 86400


def cache_key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.sha2(F.concat_ws("-", *cols), 256)


def cache_key_sql(*parts: str) -> str:
    return f"sha256(concat_ws('-', {', '.join(parts)}))"


def _ts(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        return F.lit(as_of).cast("timestamp")
    return F.to_timestamp(F.lit(str(as_of)))


def latest(cache: DataFrame) -> DataFrame:
    """Newest entry per key (ties on ``ts`` broken by the larger response). A grouped maximum with partial
    aggregation, so a key with very many versions never sits in one buffer."""
    best = cache.groupBy("cache_key").agg(F.max(F.struct("ts", "response")).alias("_b"))
    return best.select("cache_key", F.col("_b.response").alias("response"), F.col("_b.ts").alias("ts"))


def live(cache: DataFrame, as_of, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Latest entries whose age at ``as_of`` is at most ``ttl_seconds``."""
    cutoff = _ts(as_of) - F.make_dt_interval(secs=F.lit(int(ttl_seconds)))
    return latest(cache).filter(F.col("ts") >= cutoff)


def hits(requests: DataFrame, cache: DataFrame, as_of, key_col: str = "cache_key",
         ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    lv = live(cache, as_of, ttl_seconds).withColumnRenamed("cache_key", key_col)
    return requests.join(lv, key_col)


def misses(requests: DataFrame, cache: DataFrame, as_of, key_col: str = "cache_key",
           ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    lv = live(cache, as_of, ttl_seconds).select(F.col("cache_key").alias(key_col))
    return requests.join(lv, key_col, "left_anti")


def with_cache(requests: DataFrame, cache: DataFrame, compute, as_of, key_col: str = "cache_key",
               input_col: str = "input", ttl_seconds: int = CACHE_TTL_SECONDS):
    """Answer every request from the cache when live, else from ``compute``.

    ``compute(df[key_col, input_col]) -> df[key_col, response]`` (an ``error`` column is honoured) is called once per
    distinct missing key (repeated inputs are sent once) and its result written once, since both returned frames read
    it. Failed calls are answered with NULL and never become cache entries. Returns ``(answers, new_entries)``: the requests with ``response`` and
    ``from_cache``, and the rows to append to the cache (``ts = as_of``).
    """
    lv = live(cache, as_of, ttl_seconds).select(F.col("cache_key").alias(key_col), "response")
    todo = requests.join(lv.select(key_col), key_col, "left_anti").select(key_col, input_col).dropDuplicates([key_col])
    fresh = compute(todo)
    failed = F.col("error").isNotNull() if "error" in fresh.columns else F.col("response").isNull()
    fresh = materialize(fresh.select(key_col, "response", failed.alias("_failed")), "computed")
    new_entries = fresh.where(~F.col("_failed")).select(F.col(key_col).alias("cache_key"), "response", _ts(as_of).alias("ts"))
    answers_src = lv.withColumn("from_cache", F.lit(True)).unionByName(
        fresh.drop("_failed").withColumn("from_cache", F.lit(False)))
    answers = requests.join(answers_src, key_col, "left")
    return answers, new_entries


def upsert(cache: DataFrame, new_entries: DataFrame) -> DataFrame:
    """The cache after appending ``new_entries`` (as a plan; :func:`append_entries` writes it)."""
    return cache.unionByName(new_entries.select("cache_key", "response", "ts"))


def append_entries(new_entries: DataFrame, cache_path: str) -> None:
    new_entries.select("cache_key", "response", "ts").write.mode("append").parquet(cache_path)
