"""Line diffs of (old, new) text pairs: diff rows, counts, new-side line numbers, context hunks.

The alignment itself is Python's ``difflib.Differ`` over ``splitlines`` of both texts, run per pair inside
``mapInPandas`` (a pair is one row, so the work is spread by pairs). Hint lines (``?``) are dropped. Everything
after it is DataFrame work on the diff rows: counts are grouped sums, line numbers a running sum per pair, and
hunks and their lines gaps-and-islands windows over a pair's sorted rows; these are bounded by its own two texts.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, give_back


def _diff_rows(old: str | None, new: str | None):
    a = (old or "").splitlines()
    b = (new or "").splitlines()
    pos = 0
    for d in difflib.Differ().compare(a, b):
        tag = d[0]
        if tag == "?":
            continue
        yield pos, tag, d[2:]
        pos += 1


def diff_lines(pairs: DataFrame, key_col: str = "pair_id", old_col: str = "old", new_col: str = "new") -> DataFrame:
    """``key, pos, op, line``: op is ``+`` (only in new), ``-`` (only in old) or `` `` (in both); pos from 0."""
    bound_batches(pairs.sparkSession)
    ktype = dict((f.name, f.dataType.simpleString()) for f in pairs.schema.fields)[key_col]

    def run(batches):
        rows = []

        def frame():
            keys, poss, ops, lines = zip(*rows) if rows else ([], [], [], [])
            return pd.DataFrame({key_col: list(keys), "pos": pd.Series(poss, dtype="int32"), "op": list(ops),
                                 "line": list(lines)})

        for pdf in batches:
            for k, o, n in zip(pdf[key_col].tolist(), pdf[old_col].tolist(), pdf[new_col].tolist()):
                rows += [(k, *row) for row in _diff_rows(o, n)]
                if len(rows) > 20_000:
                    yield frame()
                    rows = []
            yield frame()
            rows = []
            give_back()

    return pairs.select(key_col, old_col, new_col).mapInPandas(
        run, f"`{key_col}` {ktype}, pos int, op string, line string")


def diff_stats(pairs: DataFrame, rows: DataFrame | None = None, key_col: str = "pair_id", old_col: str = "old",
               new_col: str = "new") -> DataFrame:
    """Lines added and removed per pair (0 and 0 for equal texts), counted beside the pair in the one diff pass.

    Diff rows made before can be counted instead (``rows``); pairs without any are looked up in ``pairs``."""
    if rows is None:
        return with_diff_stats(pairs.select(key_col, old_col, new_col), old_col, new_col).select(key_col, "added", "removed")
    counts = rows.groupBy(key_col).agg(F.count_if(F.col("op") == "+").cast("int").alias("added"),
                                       F.count_if(F.col("op") == "-").cast("int").alias("removed"))
    return pairs.select(key_col).join(counts, key_col, "left").select(
        key_col, F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))


def numbered(rows: DataFrame, key_col: str = "pair_id") -> DataFrame:
    """New-side line number (from 1) of each diff row; NULL for lines only in the old text."""
    w = Window.partitionBy(key_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum((F.col("op") != "-").cast("int")).over(w)
    return rows.withColumn("new_line", F.when(F.col("op") != "-", run).cast("int"))


def _islands(rows: DataFrame, context: int, key_col: str) -> DataFrame:
    """``rows`` with the changed rows around each one and the number of islands up to it, in one sorted pass per pair.

    Changed rows at most 2·context apart are one island. ``_prev`` and ``_next`` are the nearest changed rows at or
    before and at or after a row, ``_island`` counts the islands begun up to it, ``_n`` the pair's rows."""
    order = Window.partitionBy(key_col).orderBy("pos")
    upto, onward = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("op") != " ", F.col("pos"))
    gap = F.col("pos") - F.last(at, ignorenulls=True).over(before)
    begins = at.isNotNull() & (gap.isNull() | (gap > 2 * context))
    return (rows.withColumn("_begins", begins.cast("int"))
            .withColumn("_island", F.sum("_begins").over(upto))
            .withColumn("_prev", F.last(at, ignorenulls=True).over(upto))
            .withColumn("_next", F.first(at, ignorenulls=True).over(onward))
            .withColumn("_n", F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding,
                                                                       Window.unboundedFollowing))))


def hunks(rows: DataFrame, context: int | None = 3, key_col: str = "pair_id") -> DataFrame:
    """Context hunks: changed rows at most 2·context apart share a hunk, which spans ``context`` rows around
    them (start clipped at 0, end at the number of diff rows). ``title`` is ``start+1-end``.

    ``context=None`` gives one hunk per pair covering the whole diff, for pairs of equal texts too.
    """
    if context is None:
        spans = rows.groupBy(key_col).agg(F.count(F.lit(1)).alias("end")).select(
            key_col, F.lit(0).alias("hunk_no"), F.lit(0).alias("start"), "end")
    else:
        c = int(context)
        changed = _islands(rows, c, key_col).filter(F.col("op") != " ")
        spans = (changed.groupBy(key_col, (F.col("_island") - 1).alias("hunk_no"))
                 .agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"), F.first("_n").alias("_n"))
                 .select(key_col, "hunk_no", F.greatest(F.col("_first") - c, F.lit(0)).alias("start"),
                         F.least(F.col("_last") + c, F.col("_n")).alias("end")))
    return spans.select(key_col, F.col("hunk_no").cast("int").alias("hunk_no"), F.col("start").cast("int"),
                        F.col("end").cast("int"),
                        F.concat((F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"))
                        .alias("title"))


def hunk_lines(rows: DataFrame, context: int | None = 3, key_col: str = "pair_id") -> DataFrame:
    """``key, hunk_no, pos, op, line, new_line``: the diff rows of each hunk of :func:`hunks`, with new-side numbers.

    A row belongs to the island of the last change when it lies less than ``context`` rows after it or no new island
    follows within reach, else to the next island when that begins at most ``context`` rows on. Only windows over the
    pair's sorted rows are used: the diff is computed once and no span is joined back to its rows. ``context=None``
    gives every row of every pair.
    """
    cols = [key_col, F.col("hunk_no").cast("int").alias("hunk_no"), "pos", "op", "line", "new_line"]
    placed = numbered(rows, key_col)
    if context is None:
        return placed.withColumn("hunk_no", F.lit(0)).select(cols)
    c, pos, prev, next_ = int(context), F.col("pos"), F.col("_prev"), F.col("_next")
    inside = prev.isNotNull() & next_.isNotNull() & (next_ - prev <= 2 * c)
    # a hunk's end is exclusive: the row ``context`` after its last change is not part of it
    number = (F.when((prev < next_) & inside, F.col("_island") - 1).when(pos < prev + c, F.col("_island") - 1)
              .when((pos >= next_ - c) & (pos < next_), F.col("_island")))
    return _islands(placed, c, key_col).withColumn("hunk_no", number).filter(F.col("hunk_no").isNotNull()).select(cols)


def with_diff_stats(df: DataFrame, old_col: str = "old", new_col: str = "new") -> DataFrame:
    """``df`` plus ``added`` and ``removed`` line counts of each row's (old, new) pair, in one pass."""
    bound_batches(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + \
        ", added int, removed int"

    def run(batches):
        for pdf in batches:
            added, removed = [], []
            for o, n in zip(pdf[old_col].tolist(), pdf[new_col].tolist()):
                ops = [op for _pos, op, _line in _diff_rows(o, n)]
                added.append(ops.count("+"))
                removed.append(ops.count("-"))
            out = pdf.copy()
            out["added"] = pd.Series(added, index=pdf.index, dtype="int32")
            out["removed"] = pd.Series(removed, index=pdf.index, dtype="int32")
            yield out
            give_back()

    return df.mapInPandas(run, schema)
