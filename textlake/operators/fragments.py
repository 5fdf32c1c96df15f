"""Line fragments of files: split, filter, spans, recombination.

All narrow: a fragment is made from its own row, so splitting never shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import line_count, newline_count, split_lines


def split_fragments(files: DataFrame, fragment_lines: int = 10, key_cols=("doc_id",), text_col: str = "text",
                    ignore_empty: bool = True) -> DataFrame:
    """One row per group of ``fragment_lines`` consecutive lines: ``*keys, start_line, contents``.

    ``start_line`` is the 0-based index of the fragment's first line; lines are joined by ``\\n``.
    Empty fragments are dropped when ``ignore_empty`` (a pair of blank lines gives ``"\\n"`` and stays).
    """
    n = int(fragment_lines)
    if n <= 0:
        raise ValueError("fragment_lines must be positive")
    lines = split_lines(text_col)
    with_lines = files.select(*key_cols, lines.alias("_lines"))
    n_frag = F.ceil(F.size("_lines") / F.lit(n)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(n_frag - 1, F.lit(0))),
        lambda i: F.struct(
            (i * n).alias("start_line"),
            F.array_join(F.slice(F.col("_lines"), i * n + 1, F.lit(n)), "\n").alias("contents"),
        ),
    )
    out = with_lines.select(
        *key_cols, F.explode(F.when(n_frag > 0, pieces).otherwise(F.array())).alias("_f")
    ).select(*key_cols, F.col("_f.start_line").cast("int").alias("start_line"), F.col("_f.contents").alias("contents"))
    if ignore_empty:
        out = out.filter(F.col("contents") != "")
    return out


def min_lines(fragments: DataFrame, m: int) -> DataFrame:
    """Keep fragments of at least ``m`` lines (a trailing blank line does not count)."""
    if m <= 0:
        return fragments
    return fragments.filter(line_count("contents") >= F.lit(int(m)))


def with_end_line(fragments: DataFrame) -> DataFrame:
    """``end_line`` = start_line + number of ``\\n`` in the contents (inclusive, 0-based)."""
    return fragments.withColumn("end_line", (F.col("start_line") + newline_count("contents")).cast("int"))


def combine_fragments(fragments: DataFrame, key_cols=("doc_id",), separator: str = "") -> DataFrame:
    """Fragments of one file back to one text, in start-line order.

    ``separator=""`` concatenates as the original tool did; ``"\\n"`` gives back the split text. The group is
    one file, so the collected list is bounded by that file's own size.
    """
    parts = F.sort_array(F.collect_list(F.struct("start_line", "contents")))
    return fragments.groupBy(*key_cols).agg(
        F.array_join(F.transform(parts, lambda p: p["contents"]), separator).alias("text")
    )
