"""Whole-text file reading, result writing, and the write-then-read inference cache."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from textlake.operators.cache import cache_key
from textlake.operators.infer import infer_to_cache
from textlake.sources.sinks import write_results
from textlake.sources.tables import read_text_files


def test_read_text_files_whole_and_non_empty(spark):
    d = tempfile.mkdtemp(prefix="tl-files-")
    files = {"a.txt": "line 1\nline 2\n", "b.txt": "", "c.txt": "  \n", "sub/d.txt": "nested"}
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        with open(os.path.join(d, name), "w", newline="") as fh:
            fh.write(text)
    rows = {os.path.basename(r.path): r.text for r in read_text_files(spark, os.path.join(d, "*.txt")).collect()}
    assert rows == {"a.txt": "line 1\nline 2\n", "c.txt": "  \n"}  # empty file dropped, whitespace-only kept
    # Spark's file sources never return zero-byte files, so ignore_empty=False cannot bring them back
    all_rows = read_text_files(spark, os.path.join(d, "*.txt"), ignore_empty=False).count()
    assert all_rows == 2


def test_write_results_modes(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="tl-out-"), "res")
    df = spark.createDataFrame([("x/a.txt", "A"), ("b.txt", "B")], "path string, text string")
    write_results(df, out)
    with pytest.raises(Exception):
        write_results(df, out)  # no overwrite without yes
    write_results(df.limit(1), out, yes=True)
    assert spark.read.parquet(out).count() == 1


def test_infer_to_cache_second_run_has_no_misses(spark):
    calls = spark.sparkContext.accumulator(0)

    def make_fn():
        def fn(prompts):
            calls.add(len(prompts))
            return [p[::-1] for p in prompts]
        return fn

    cache_path = os.path.join(tempfile.mkdtemp(prefix="tl-cache-"), "cache")
    prompts = spark.createDataFrame([(i, f"prompt {i % 5}") for i in range(20)], "id int, prompt string")
    prompts = prompts.withColumn("cache_key", cache_key("local", "echo", F.col("prompt")))
    as_of = dt.datetime(2024, 1, 1)
    empty = spark.createDataFrame([], "cache_key string, response string, ts timestamp")
    first = infer_to_cache(prompts, empty, cache_path, make_fn, as_of, max_wait=0)
    got = {r.id: r.response for r in first.collect()}
    assert got == {i: f"prompt {i % 5}"[::-1] for i in range(20)}
    assert calls.value == 5  # each distinct prompt once
    stored = spark.read.parquet(cache_path)
    second = infer_to_cache(prompts, stored, cache_path, make_fn, as_of, max_wait=0)
    assert second.count() == 20 and calls.value == 5  # everything answered from the cache
