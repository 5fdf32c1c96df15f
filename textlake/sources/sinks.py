"""Sinks: result files and append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(files: DataFrame, output_dir: str, yes: bool = False, partition_by: str | None = None) -> None:
    """Write ``(path, text)`` rows as parquet under ``output_dir``.

    ``yes`` replaces an existing output; without it an existing output is an error (no interactive prompt).
    """
    writer = files.write.mode("overwrite" if yes else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(output_dir)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
