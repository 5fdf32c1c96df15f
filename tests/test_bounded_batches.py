"""What Python steps get at once is bounded by bytes, whatever the rows hold."""

import pytest
from pyspark.sql import functions as F

from textlake.operators.diffs import diff_lines, with_diff_stats
from textlake.operators.embed import Buckets, HashedEmbedder, PandasEmbedder
from textlake.operators.infer import batch_infer
from textlake.operators.search import top_n_search
from textlake.session import BATCH_BYTES, bound_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _texts(spark, rows=600, words=4000):
    """About 12 MB of text in one partition, in a session of its own."""
    own = spark.newSession()
    return own.range(0, rows, 1, 1).select("id", F.repeat(F.lit("word "), words).alias("text"),
                                           F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))


def _largest(df):
    """Bytes of the largest batch that a Python step over ``df`` gets now."""
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    return df.select("id", "text").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def _steps():
    return {
        "hashed": lambda df: HashedEmbedder().embed(df, ["id"]),
        "pandas": lambda df: PandasEmbedder(lambda: lambda texts: [[1.0]] * len(texts)).embed(df, ["id"]),
        "infer": lambda df: batch_infer(df, lambda: lambda prompts: prompts, key_cols=["id"], prompt_col="text"),
        "diff_stats": lambda df: with_diff_stats(df.select("id", F.lit("").alias("old"), F.col("text").alias("new"))),
        "diff_lines": lambda df: diff_lines(df.select("id", F.lit("").alias("old"), F.col("text").alias("new")), "id"),
        "search": lambda df: top_n_search(df, df.limit(1).select(F.lit(0).alias("q"), "embedding"), item_keys=["id"],
                                          query_key="q", top_n=600),
    }


@pytest.mark.parametrize("step", list(_steps()))
def test_python_steps_get_batches_bounded_by_bytes(spark, step):
    df = _texts(spark)
    out = _steps()[step](df)
    assert _largest(df) <= BATCH_BYTES + 2 * 20_000
    assert out.count() == 600


def test_a_smaller_bound_of_the_cluster_holds(spark):
    own = spark.newSession()
    own.conf.set(KEY, "64k")
    bound_batches(own)
    assert own.conf.get(KEY) == "64k"


def test_a_row_beyond_the_bound_travels_whole(spark):
    df = _texts(spark, rows=2, words=1_000_000)
    assert [r.embedding[Buckets(64)["word"]] for r in HashedEmbedder().embed(df, ["id"]).collect()] == [1e6, 1e6]


def test_a_full_token_table_changes_no_bucket_and_does_not_grow():
    few, all_ = Buckets(64, most=3), Buckets(64)
    words = [f"w{i % 40}" for i in range(400)]
    assert [few[w] for w in words] == [all_[w] for w in words]
    assert len(few) == 3 and len(all_) == 40
