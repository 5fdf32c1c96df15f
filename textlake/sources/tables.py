"""Readers for the input tables and for plain text files.

A "file" of the command-line tool is a row here: ``(doc_id, path, text)``. Only the columns a plan uses are
read, so Catalyst prunes the parquet scan; filters given to a plan reach the scan as pushed filters.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def document_path(source: Column | str = "source", doc_id: Column | str = "doc_id") -> Column:
    """Path of a document row: ``<source>/<doc_id>.txt``."""
    s = F.col(source) if isinstance(source, str) else source
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.concat(s, F.lit("/"), d.cast("string"), F.lit(".txt"))


DOCUMENT_PATH_SQL = "(source || '/' || CAST(doc_id AS VARCHAR) || '.txt')"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``doc_id, source, path, text``."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", document_path().alias("path"), "text"
    )


def non_empty(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop empty texts; whitespace-only texts stay."""
    return files.filter(F.col(text_col) != "")


def require_files(files: DataFrame) -> DataFrame:
    """The original tool stops when its filters leave no file; so do the plans that take files (one row is looked at)."""
    if files.isEmpty():
        raise ValueError("no file with text is left")
    return files


def read_text_files(spark: SparkSession, paths: str | list[str], ignore_empty: bool = True) -> DataFrame:
    """Whole text files as rows ``(path, text)``; globs replace shell globs. Directories yield no rows.

    Spark's file sources skip zero-byte files themselves, so empty files never appear (the original tool's
    default); ``ignore_empty`` matters for texts that arrive some other way.
    """
    df = spark.read.text(paths, wholetext=True).select(
        # the path comes as a URI: %20 and its like are decoded, a plus sign stays
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text")
    )
    return non_empty(df) if ignore_empty else df
