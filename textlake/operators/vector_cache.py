"""Embeddings kept in a content-addressed table ``(cache_key, embedding, ts)``, so that a text is embedded once.

The key is the SHA-256 of ``mode-model-text`` over the flattened text, one form for queries and fragments alike. The table
is a folder of immutable versions below ``versions/`` and a manifest ``current`` beside them, a one-row table that names the
version in use. An append or a compaction writes a new version first and swaps the manifest last: a reader sees the old or
the new table, never a half-written one, and a job that dies in between leaves the old one in place.

Entries lie in files by a hash of the key, ``buckets`` of them, each sorted by key. New entries are appended as files of
their own to the version in use's list; :func:`compact` rewrites the newest live entry of every key into one set of files.
Probing is one join on the key; texts that repeat are sent to the model once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import flatten_newlines
from ..session import materialize
from .cache import CACHE_TTL_SECONDS, _ts, cache_key

SCHEMA = "cache_key string, embedding array<double>, ts timestamp"


class VectorCache:
    """The table at ``path`` (on storage that driver and executors share); it starts empty."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def versions(self) -> list[str]:
        """Folders that make up the table, oldest first: what the newest manifest lists."""
        if not self._exists(f"{self.path}/manifests"):
            return []
        newest = self.spark.read.schema("seq long, folders array<string>").parquet(f"{self.path}/manifests").orderBy(
            F.col("seq").desc()).first()
        return list(newest["folders"]) if newest else []

    def read(self) -> DataFrame:
        folders = self.versions()
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/versions/{f}" for f in folders])

    def _write(self, entries: DataFrame) -> str:
        name = uuid.uuid4().hex
        (entries.select("cache_key", "embedding", "ts").repartition(self.buckets, "cache_key")
         .sortWithinPartitions("cache_key").write.parquet(f"{self.path}/versions/{name}"))
        return name

    def _publish(self, folders: list[str]) -> None:
        """A new manifest row with the next number. Spark commits the file by a rename, so it is there whole or not."""
        seq = 0
        if self._exists(f"{self.path}/manifests"):
            seq = 1 + (self.spark.read.schema("seq long, folders array<string>").parquet(
                f"{self.path}/manifests").agg(F.max("seq")).first()[0] or 0)
        self.spark.createDataFrame([(seq, folders)], "seq long, folders array<string>").coalesce(1).write.mode(
            "append").parquet(f"{self.path}/manifests")

    def append(self, entries: DataFrame) -> None:
        self._publish([*self.versions(), self._write(entries)])

    def latest(self) -> DataFrame:
        """Newest entry per key."""
        return self.read().groupBy("cache_key").agg(F.max_by(F.struct("embedding", "ts"), F.col("ts")).alias("e")).select(
            "cache_key", "e.embedding", "e.ts")

    def live(self, as_of, ttl_seconds: int | None = CACHE_TTL_SECONDS) -> DataFrame:
        """Newest entries not older than ``ttl_seconds`` at ``as_of`` (None: all)."""
        out = self.latest()
        if ttl_seconds is None:
            return out
        return out.filter(F.col("ts") >= _ts(as_of) - F.make_dt_interval(secs=F.lit(int(ttl_seconds))))

    def compact(self, as_of=None, ttl_seconds: int | None = None) -> None:
        """One version of the newest entry of every key; entries expired at ``as_of`` go where a time to live is given.
        Older versions stay on disk for readers that still use them; the manifest no longer names them."""
        if self.versions():
            self._publish([self._write(self.live(as_of, ttl_seconds))])


def embed_with_cache(texts: DataFrame, cache: VectorCache, embedder, as_of, *, key_cols, text_col: str = "text",
                     mode: str = "embed", model: str = "hashed-64", ttl_seconds: int | None = CACHE_TTL_SECONDS,
                     out_col: str = "embedding") -> DataFrame:
    """``*key_cols, embedding, from_cache`` for every row of ``texts``; new vectors are appended to ``cache``.

    Each distinct flattened text whose entry is missing or expired is embedded once. The fresh vectors are written before
    anything reads them, so neither the answer nor the append can call the model again. Null texts get a null vector.
    """
    keys = list(key_cols)
    flat = flatten_newlines(text_col)
    asked = texts.select(*keys, flat.alias("_text")).withColumn(
        "_key", F.when(F.col("_text").isNotNull(), cache_key(mode, model, F.col("_text"))))
    known = materialize(cache.live(as_of, ttl_seconds).join(asked.select(F.col("_key").alias("cache_key")).distinct(),
                                                            "cache_key", "left_semi"), "known-vectors")
    todo = asked.where(F.col("_key").isNotNull()).select("_key", "_text").dropDuplicates(["_key"]).join(
        known.select(F.col("cache_key").alias("_key")), "_key", "left_anti")
    fresh = materialize(embedder.embed(todo, ["_key"], "_text", "_vector"), "fresh-vectors")
    if not fresh.isEmpty():
        cache.append(fresh.select(F.col("_key").alias("cache_key"), F.col("_vector").alias("embedding"),
                                  _ts(as_of).alias("ts")))
    both = known.select(F.col("cache_key").alias("_key"), F.col("embedding").alias(out_col),
                        F.lit(True).alias("from_cache")).unionByName(
        fresh.select("_key", F.col("_vector").alias(out_col), F.lit(False).alias("from_cache")))
    return asked.drop("_text").join(both, "_key", "left").drop("_key")
