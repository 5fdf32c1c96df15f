"""Streaming ingest of a documents table that is a folder of files, or one file."""

import os

from textlake.plans import registry
from textlake.streaming.ingest import DOCUMENT_SCHEMA

from conftest import SF001


def _vectors(df):
    return sorted((r.doc_id, r.start_line, tuple(r.embedding)) for r in df.collect())


def test_table_in_several_files_is_ingested_whole(spark, tmp_path):
    one = registry.QUERIES["stream_ingest"](spark, SF001)
    docs = registry.read_table(spark, SF001, "documents")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert len([f for f in os.listdir(tmp_path / "documents.parquet") if f.endswith(".parquet")]) == 3
    many = registry.QUERIES["stream_ingest"](spark, str(tmp_path))
    assert _vectors(many) == _vectors(one)


def test_table_without_rows_gives_no_vectors(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.QUERIES["stream_ingest"](spark, str(tmp_path)).count() == 0
