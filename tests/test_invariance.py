"""Same answers for any shuffle-partition count and any input row order; pluggable tokenizer and embedder."""

import pytest
from pyspark.sql import functions as F

from textlake.functions.tokens import EncoderTokenizer
from textlake.operators.embed import PandasEmbedder
from textlake.plans import packing as P
from textlake.plans import search as S
from textlake.sources.tables import read_documents, read_table

SF = "/root/testdata/sf0.001"


def _collect(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partition_and_order_invariance(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        files = read_documents(spark, SF)
        shuffled = files.repartition(parts).orderBy(F.rand(parts))
        base_pack = _collect(P.pack_documents(files), ["source", "doc_id", "chunk_no"])
        assert _collect(P.pack_documents(shuffled), ["source", "doc_id", "chunk_no"]) == base_pack
        docs = read_table(spark, SF, "documents")
        bench = read_table(spark, SF, "benchmark")
        cols = ["item_id", "doc_id", "start_line", "similarity", "rank"]
        base = _collect(S.semantic_search(docs, bench), cols)
        assert _collect(S.semantic_search(docs.orderBy(F.rand(7)).repartition(parts), bench), cols) == base
        pairs = P.conversation_examples(read_table(spark, SF, "conversations"))
        picks = _collect(P.select_examples(pairs, 120, 2), ["conv_id", "turn", "pick_no"])
        assert _collect(P.select_examples(pairs.orderBy(F.rand(3)), 120, 2), ["conv_id", "turn", "pick_no"]) == picks
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_encoder_tokenizer(spark):
    def make_enc():
        return lambda s: list(s.encode("utf-8"))

    def make_dec():
        return lambda ids: bytes(ids).decode("utf-8")

    tok = EncoderTokenizer(make_enc, make_dec)
    df = spark.createDataFrame([("hello world",), ("",)], "t string")
    rows = df.select(tok.count("t").alias("n"), tok.clip("t", 5, "head").alias("h"),
                     tok.clip("t", 5, "tail").alias("tl")).collect()
    assert [(r.n, r.h, r.tl) for r in rows] == [(11, "hello", "world"), (0, "", "")]


def test_pandas_embedder(spark):
    def make_model():
        return lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]

    df = spark.createDataFrame([(1, "a\nb"), (2, "banana")], "id int, text string")
    got = {r.id: list(r.embedding) for r in PandasEmbedder(make_model, batch_size=1).embed(df, ["id"]).collect()}
    assert got == {1: [3.0, 1.0], 2: [6.0, 3.0]}  # newlines flattened before embedding
