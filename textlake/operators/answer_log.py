"""Resumable model calls: answers are committed slice by slice to a table that is also the response cache.

An :class:`AnswerLog` is a folder of parquet files ``(cache_key, response, ts)``. Prompts without a live answer are made
distinct by key and sorted within their partition; a task asks them in slices of ``slice_rows`` and commits every slice as
one file before it begins the next. A slice's file name is a digest of its keys and of ``as_of``, so a task that runs again
(lost executor, retry, speculation) finds the files of its earlier attempt and repeats at most the slice that was not
committed. A job that was stopped altogether finds the finished keys in the table. Downstream steps read answers from the
table, never from the task that asked, so two attempts cannot show two different answers.

Files are written under a hidden name and moved, so a reader sees whole slices only. Tasks write through ``pyarrow.fs``:
the folder must be shared and of a scheme that pyarrow opens. Failed prompts are reported with ``error`` and never
logged. Nulls: a NULL prompt gets a NULL response and no call. Equal prompts share one call. Of several entries of a key
the newest live one counts (ties: the larger response). Key columns may repeat; every input row gets one output row.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, give_back, materialize, ship_package
from .cache import CACHE_TTL_SECONDS, _ts, cache_key, latest, live
from .infer import ATTEMPTS, MAX_WAIT_SECONDS, ask

SCHEMA = "cache_key string, response string, ts timestamp"
_FILE = pa.schema([("cache_key", pa.string()), ("response", pa.string()), ("ts", pa.timestamp("us", tz="UTC"))])


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as Spark names it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class SliceStore:
    """The task's side of the log: slices by name, found again or committed whole."""

    def __init__(self, folder: str, as_of_micros: int):
        self.fs, self.path = open_folder(folder.rstrip("/"))
        self.as_of = as_of_micros

    def name(self, keys: list[str]) -> str:
        return hashlib.sha256("\n".join([str(self.as_of), *keys]).encode()).hexdigest()

    def find(self, name: str) -> dict[str, str | None]:
        at = f"{self.path}/slice-{name}.parquet"
        if self.fs.get_file_info(at).type != fs.FileType.File:
            return {}
        got = pq.read_table(at, filesystem=self.fs, columns=["cache_key", "response"], partitioning=None).to_pydict()
        return dict(zip(got["cache_key"], got["response"], strict=True))

    def commit(self, name: str, answers: dict[str, str | None]) -> None:
        table = pa.table({"cache_key": list(answers), "response": list(answers.values()),
                          "ts": [self.as_of] * len(answers)}, schema=_FILE)
        hidden = f"{self.path}/_{uuid.uuid4().hex}"
        pq.write_table(table, hidden, filesystem=self.fs)
        self.fs.move(hidden, f"{self.path}/slice-{name}.parquet")


def answer_slices(store: SliceStore, fn, keys: list[str], prompts: list[str], slice_rows: int, batch_size: int,
                  attempts: int, max_wait: float, sleep=time.sleep):
    """``(key, error)`` of every prompt, slice after slice; a slice is committed before its rows come out."""
    for i in range(0, len(keys), slice_rows):
        part = range(i, min(i + slice_rows, len(keys)))
        name = store.name([keys[j] for j in part])
        done = store.find(name)
        todo = [j for j in part if keys[j] not in done]
        errors = {}
        if todo:
            responses, failed = ask(fn, [prompts[j] for j in todo], batch_size, attempts, max_wait, sleep)
            errors = {keys[j]: e for j, e in zip(todo, failed, strict=True) if e is not None}
            fresh = {keys[j]: r for j, r, e in zip(todo, responses, failed, strict=True) if e is None}
            if fresh:
                store.commit(name, {**done, **fresh})
        yield from ((keys[j], errors.get(keys[j])) for j in part)


class AnswerLog:
    """The log in folder ``path``, read and written as of ``as_of`` (a time or its text, never the wall clock)."""

    def __init__(self, spark: SparkSession, path: str, as_of, ttl_seconds: int = CACHE_TTL_SECONDS,
                 mode: str = "completion"):
        self.spark, self.path, self.as_of, self.ttl, self.mode = spark, path.rstrip("/"), as_of, ttl_seconds, mode
        ship_package(spark)
        self._micros = spark.range(1).select(F.unix_micros(_ts(as_of))).first()[0]
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def table(self) -> DataFrame:
        """All entries, old and expired ones too."""
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def key(self, prompt_col: str, model: str | None):
        return F.when(F.col(prompt_col).isNotNull(), cache_key(self.mode, model or "", F.col(prompt_col)))

    def answer(self, prompts: DataFrame, make_fn: Callable[[], Callable[[list], list]], *, key_cols,
               prompt_col: str = "prompt", model: str | None = None, slice_rows: int = 256, batch_size: int = 16,
               attempts: int = ATTEMPTS, max_wait: float = MAX_WAIT_SECONDS, num_partitions: int | None = None) -> DataFrame:
        """``*key_cols, response, error`` per prompt row, as :func:`textlake.operators.infer.batch_infer`; the calls run
        now, for prompts without a live answer, and are in the log when this returns."""
        keys = list(key_cols)
        # prompts are read twice (calls, answers): written once, and the second read takes the keys only
        asked = materialize(prompts.select(*keys, prompt_col, self.key(prompt_col, model).alias("_key")), "asked")
        known = live(self.table(), self.as_of, self.ttl).select(F.col("cache_key").alias("_key"))
        todo = (asked.where(F.col("_key").isNotNull()).select("_key", F.col(prompt_col).alias("_prompt"))
                .join(known, "_key", "left_anti").dropDuplicates(["_key"]))
        if num_partitions:
            todo = todo.repartition(int(num_partitions), "_key")
        folder, micros = self.path, self._micros
        bound_batches(self.spark)

        def run(batches):
            fn, store = make_fn(), SliceStore(folder, micros)
            for pdf in batches:
                got = list(answer_slices(store, fn, pdf["_key"].tolist(), pdf["_prompt"].tolist(), slice_rows, batch_size,
                                         attempts, max_wait))
                yield pd.DataFrame(got, columns=["_key", "error"]).dropna(subset=["error"])
                give_back()

        errors = materialize(todo.sortWithinPartitions("_key").mapInPandas(run, "_key string, error string"), "call-errors")
        self.spark.catalog.refreshByPath(self.path)
        answers = live(self.table(), self.as_of, self.ttl).select(F.col("cache_key").alias("_key"), "response",
                                                                  F.lit(True).alias("_answered"))
        out = asked.select(*keys, "_key").join(answers, "_key", "left").join(
            errors.groupBy("_key").agg(F.min("error").alias("error")), "_key", "left")
        return out.select(*keys, "response", F.when(F.col("_answered").isNull(), F.col("error")).alias("error"))

    def compact(self) -> None:
        """One entry a key, the newest, in few files. The new files are written before the old ones go, so a lost job
        leaves repeated entries, which readers ignore. Not to be run while calls are being logged."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        old = self.table().inputFiles()
        latest(self.table()).write.mode("append").parquet(self.path)
        for f in old:
            at = path(f)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, False)
        self.spark.catalog.refreshByPath(self.path)
