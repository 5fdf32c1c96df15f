"""Cached embeddings (one model call per text, swaps, expiry) and the exact cell index (same rows as the full scan)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.operators.cache import cache_key
from textlake.operators.embed import HashedEmbedder
from textlake.operators.search import top_n_search
from textlake.operators.vector_cache import VectorCache, embed_with_cache
from textlake.operators.vector_index import build_index, indexed_search, skipped_share

NOW = dt.datetime(2024, 1, 2)


class Counting:
    """An embedder that notes how many texts it was given."""

    def __init__(self):
        self.seen = []

    def embed(self, df, keys, text_col="text", out_col="embedding"):
        self.seen.append(df.count())
        return HashedEmbedder(4).embed(df, keys, text_col, out_col)


def texts(spark, rows):
    return spark.createDataFrame(rows, "id int, text string")


def test_second_run_embeds_nothing(spark, tmp_path):
    cache, model = VectorCache(spark, str(tmp_path / "c"), 4), Counting()
    df = texts(spark, [(1, "a b"), (2, "a b"), (3, "a\nb"), (4, "c"), (5, None), (6, "")])
    first = embed_with_cache(df, cache, model, NOW, key_cols=["id"]).collect()
    assert model.seen == [3]  # "a b" and "a\nb" are one flattened text
    assert not any(r.from_cache for r in first if r.id != 5)
    second = embed_with_cache(df, cache, model, NOW, key_cols=["id"]).collect()
    assert model.seen == [3, 0] and all(r.from_cache for r in second if r.id != 5)
    plain = {r.id: list(r.embedding) for r in HashedEmbedder(4).embed(df, ["id"]).collect()}
    for rows in (first, second):
        assert {r.id: r.embedding and list(r.embedding) for r in rows} == {**plain, 5: None}
    assert len(cache.versions()) == 1  # nothing fresh, nothing appended


def test_expired_entries_are_embedded_again_and_compaction_keeps_the_newest(spark, tmp_path):
    cache, model = VectorCache(spark, str(tmp_path / "c"), 2), Counting()
    df = texts(spark, [(1, "a"), (2, "b")])
    embed_with_cache(df, cache, model, NOW, key_cols=["id"])
    edge = NOW + dt.timedelta(seconds=86_400)
    assert all(r.from_cache for r in embed_with_cache(df, cache, model, edge, key_cols=["id"]).collect())
    late = edge + dt.timedelta(seconds=1)
    assert not any(r.from_cache for r in embed_with_cache(df, cache, model, late, key_cols=["id"]).collect())
    assert model.seen == [2, 0, 2] and cache.read().count() == 4
    old_files = cache.read()
    cache.compact()
    assert cache.read().count() == 2 and len(cache.versions()) == 1
    assert {r.ts for r in cache.read().collect()} == {late} and old_files.count() == 4  # readers of the old version go on
    cache.compact(late + dt.timedelta(days=3), 86_400)
    assert cache.read().count() == 0


def test_interrupted_append_leaves_the_old_table(spark, tmp_path, monkeypatch):
    cache = VectorCache(spark, str(tmp_path / "c"), 2)
    rows = texts(spark, [(1, "a")]).select(cache_key("m", "x", F.col("text")).alias("cache_key"),
                                           F.array(F.lit(1.0)).alias("embedding"), F.lit(NOW).alias("ts"))
    cache.append(rows)
    monkeypatch.setattr(cache, "_publish", lambda folders: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        cache.append(rows)
    assert VectorCache(spark, str(tmp_path / "c"), 2).read().count() == 1


def vectors(n, dim, seed, groups=40):
    rnd = np.random.default_rng(seed)
    heads = rnd.normal(size=(groups, dim))
    x = heads[rnd.integers(0, groups, n)] + 0.15 * rnd.normal(size=(n, dim))
    x[::50] = np.round(x[::50])        # ties
    x[1::97] = 2 * x[0]                # scaled copies of one vector
    x[5] = 0
    return x


def frame(spark, x, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} int, embedding array<double>")


@pytest.mark.parametrize("top_n,threshold", [(3, 0.0), (1, None), (7, 0.9), (None, 0.95)])
def test_index_gives_the_rows_of_the_full_scan(spark, top_n, threshold):
    items = frame(spark, vectors(3000, 12, 1), "id").unionByName(
        spark.createDataFrame([(9000, None), (9001, [1.0]), (9002, [0.0] * 12)], "id int, embedding array<double>"))
    queries = frame(spark, np.concatenate([vectors(150, 12, 2), vectors(3000, 12, 1)[:50]]), "qid")
    index = build_index(items, item_keys=["id"], block_rows=100)
    assert index.blocks.max() > 1 and int(index.count.sum()) == index.rows.count()
    got, visits = indexed_search(index, queries, query_key="qid", top_n=top_n, threshold=threshold)
    want = top_n_search(items, queries, item_keys=["id"], query_key="qid", top_n=top_n, threshold=threshold)
    cols = ["qid", "rank", "id", "similarity"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert visits.groupBy("qid", "cell", "block").count().where("count > 1").count() == 0
    if top_n:
        share = skipped_share(index, visits, queries).first()
        assert share.skipped > 0.5


def test_index_answers_ten_thousand_queries(spark):
    x, q = vectors(4000, 8, 3), vectors(10_000, 8, 4)
    index = build_index(frame(spark, x, "id"), item_keys=["id"], cells=64)
    rows = indexed_search(index, frame(spark, q, "qid"), query_key="qid", top_n=2)[0].collect()
    got = {(r.qid, r["rank"]): (r.id, r.similarity) for r in rows}
    u = x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), np.nan)[:, None]
    for k in range(0, len(q), 41):
        if q[k].any():
            best = np.nanmax(u @ (q[k] / np.linalg.norm(q[k])))
            assert got[k, 1][1] == pytest.approx(best, abs=1e-6)


def test_empty_index(spark):
    empty = spark.createDataFrame([], "id int, embedding array<double>")
    index = build_index(empty, item_keys=["id"])
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, embedding array<double>")
    assert indexed_search(index, q, query_key="qid")[0].count() == 0
