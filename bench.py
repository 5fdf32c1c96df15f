"""Bench: headline queries at $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]; prints one JSON line.

Each query runs in full through a ``noop`` write (every row computed, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fragments", "hash_embed", "semantic_search", "semantic_search_batch", "similarity_stats", "vector_topn",
    "pack_documents", "pack_changes", "select_examples", "parse_bundle", "infer_with_cache", "diff_stats",
    "diff_hunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from textlake.plans import registry
    from textlake.session import ensure_checkpoint_dir, local_session, ship_package

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2 if cpus.isdigit() else 16))
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    # warm-up, not timed: JVM code paths and one Python worker per core (interpreter start, numpy/pandas import)
    spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")).count()
    def _warm_worker(it):
        import numpy  # noqa: F401
        import textlake.operators.search  # noqa: F401  (package import from the shipped zip, once per worker)
        for pdf in it:
            yield pdf

    spark.range(0, 64, 1, spark.sparkContext.defaultParallelism).mapInPandas(
        _warm_worker, "id long").write.format("noop").mode("overwrite").save()
    # generic JVM warm-up (shuffle, hash aggregate, join, sort, window) on generated numbers, not timed
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    r = spark.range(0, 200000).withColumn("k", F.col("id") % 97)
    agg = r.groupBy("k").agg(F.sum("id").alias("s"), F.count(F.lit(1)).alias("c"))
    (r.join(agg, "k").withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("id")))
     .write.format("noop").mode("overwrite").save())
    # first parquet write and read of the JVM (writer/reader set-up), into the scratch area of the checkpoint folder
    from textlake.session import materialize
    materialize(agg.select("k", "s"), "bench-warmup").count()
    times, failed = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and go on: one failure must not hide the other timings
            times[name] = None
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    out = {"metric": "total_query_time", "value": round(sum(v for v in times.values() if v is not None), 3),
           "unit": "sec", "queries": times, "sf": sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
