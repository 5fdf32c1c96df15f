"""Token-budget packing: ordered folds within groups, made parallel inside a group.

Next-fit packing (start a new chunk when the running size plus the next item exceeds the budget) is sequential
within a group, and a group may be huge (one source can hold a third of all rows). The fold is therefore split
into blocks: ranges of about ``block_width`` rows of the items sorted by group and order key, so blocks go by rank
and sparse keys or a hot group change neither their size nor their number:

1. Per block (``applyInPandas`` on ``(group, block)``, items as ``(order, size)`` only) the block is summarised
   as a function *entry state → (exit state, number of chunk starts)*. The state is the size of the open chunk.
   For any entry state the first flush in the block happens at some item k; from there on the chain of chunk
   starts no longer depends on the entry. So the function is a handful of pieces (one per distinct first flush
   whose chain ends differently, plus a linear piece when the whole block fits), computed for all k at once by
   dynamic programming over the block's next-chunk pointers.
   Only a block's first and last group can reach into other blocks; the others need no summary.
2. Per group, the block summaries (far fewer rows than items) are folded in block order to get each block's
   entry state and the number of chunks before it. A group's fold holds a few rows per block; for very large inputs
   ``block_width`` trades the length of this fold against the size of a block.
3. Per block again, chunk numbers are assigned from the known entry state.

All three steps are exact. Only ids and sizes cross into Python; text is joined back afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

INF = np.int64(2 ** 62)
DEFAULT_BLOCK_WIDTH = 65536


def _scan(n: np.ndarray, max_tokens: int, charge: bool):
    """Next-chunk pointers and, per possible chunk start p, (exit state, chunk starts after p) to block end."""
    m = len(n)
    cum = np.cumsum(n, dtype=np.int64)
    c0 = n.astype(np.int64) if charge else np.zeros(m, dtype=np.int64)
    thr = max_tokens + cum - c0
    nxt = np.searchsorted(cum, thr, side="right")
    nxt = np.maximum(nxt, np.arange(1, m + 1))
    exit_s = np.empty(m, dtype=np.int64)
    nb = np.empty(m, dtype=np.int64)
    total = cum[-1]
    for p in range(m - 1, -1, -1):
        q = nxt[p]
        if q >= m:
            exit_s[p] = c0[p] + total - cum[p]
            nb[p] = 0
        else:
            exit_s[p] = exit_s[q]
            nb[p] = nb[q] + 1
    return cum, c0, exit_s, nb


def _summarize(max_tokens: int, charge: bool, group_col: str, order_col: str, size_col: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col, kind="stable")
        n = pdf[size_col].to_numpy(dtype=np.int64)
        cum, _c0, exit_s, nb = _scan(n, max_tokens, charge)
        m, total = len(n), int(cum[-1])
        k0 = int(np.searchsorted(cum, max_tokens, side="right"))  # first flush for entry state 0
        rows = []
        if k0 >= m:  # an entry state up to max - total passes the whole block without a flush
            rows.append((-1, max_tokens - total, 1, total, 0))
        last = None
        for k in range(min(k0, m - 1), -1, -1):  # entry states increase as k decreases
            lo = max_tokens - int(cum[k])
            hi = int(INF) if k == 0 else max_tokens - int(cum[k - 1])
            if hi <= lo or hi < 0:
                continue
            piece = [lo, hi, 0, int(exit_s[k]), int(nb[k]) + 1]
            if last is not None and last[3] == piece[3] and last[4] == piece[4] and last[1] == piece[0]:
                last[1] = piece[1]
            else:
                if last is not None:
                    rows.append(tuple(last))
                last = piece
        if last is not None:
            rows.append(tuple(last))
        out = pd.DataFrame(rows, columns=["lo", "hi", "linear", "exit_s", "nb"])
        out.insert(0, "_blk", pdf["_blk"].iloc[0])
        out.insert(0, group_col, pdf[group_col].iloc[0])
        out["first_size"] = int(n[0])
        out["first_order"] = pdf[order_col].iloc[0]
        return out

    return run


def _fold_blocks(max_tokens: int, charge: bool, group_col: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_blk", "lo"], kind="stable")
        s, c = 0, 0
        out = []
        first = True
        for blk, pieces in pdf.groupby("_blk", sort=True):
            adj = 0
            if first and charge and int(pieces["first_size"].iloc[0]) > max_tokens:
                adj = -1  # the first item starts the group's first chunk: no empty chunk before it
            out.append((blk, s, c, first))
            first = False
            lin = pieces[pieces["linear"] == 1]
            if len(lin) and s <= int(lin["hi"].iloc[0]):
                s = s + int(lin["exit_s"].iloc[0])
                continue
            rest = pieces[pieces["linear"] == 0]
            hit = rest[(rest["lo"] < s) & (s <= rest["hi"])]
            if len(hit) != 1:
                raise RuntimeError(f"block summary does not cover entry state {s}")
            s = int(hit["exit_s"].iloc[0])
            c = c + int(hit["nb"].iloc[0]) + adj
        res = pd.DataFrame(out, columns=["_blk", "entry_s", "chunk_base", "first"])
        res.insert(0, group_col, pdf[group_col].iloc[0])
        return res

    return run


def _assign(max_tokens: int, charge: bool, group_col: str, order_col: str, size_col: str):
    def run(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 0:
            return pd.DataFrame({group_col: [], order_col: [], size_col: [], "chunk_no": []})
        pdf = pdf.sort_values(order_col, kind="stable")
        n = pdf[size_col].to_numpy(dtype=np.int64)
        s, c, first = (int(entry["entry_s"].iloc[0]), int(entry["chunk_base"].iloc[0]),
                       bool(entry["first"].iloc[0])) if len(entry) else (0, 0, True)
        if first and charge and n[0] > max_tokens:
            c -= 1  # the group's first item is oversize: its flush opens chunk 0, no empty chunk before it
        cum = np.cumsum(n, dtype=np.int64)
        starts = []
        at = int(np.searchsorted(cum, max_tokens - s, side="right"))
        while at < len(n):  # one step per chunk
            starts.append(at)
            left = max_tokens - (int(n[at]) if charge else 0)
            at = max(at + 1, int(np.searchsorted(cum, left + cum[at], side="right")))
        chunk = c + np.searchsorted(np.array(starts, dtype=np.int64), np.arange(len(n)), side="right")
        return pd.DataFrame({group_col: pdf[group_col].to_numpy(), order_col: pdf[order_col].to_numpy(),
                             size_col: n, "chunk_no": chunk.astype(np.int64)})

    return run


def in_blocks(items: DataFrame, group_col: str, order_col: str, block_width: int, name: str) -> DataFrame:
    """``items`` with ``_blk``: ranges of about ``block_width`` rows in (group, order) order, numbered in that order.

    The items are written first, so that the count and the range sample do not recompute what made them, and again with
    their block, so that a block's number never changes."""
    items = materialize(items, name)
    n = max(-(-items.count() // block_width), items.sparkSession.sparkContext.defaultParallelism)
    ranged = items.repartitionByRange(n, group_col, order_col)
    return materialize(ranged.withColumn("_blk", F.spark_partition_id().cast("bigint")), f"{name}-blocks")


def block_summaries(base: DataFrame, group_col: str, order_col: str, size_col: str, max_tokens: int,
                    charge: bool) -> DataFrame:
    """Summaries of the blocks' first and last groups. Items meet by block, never by the bare group."""
    types = dict(base.dtypes)
    g = F.struct(group_col)
    edges = base.groupBy("_blk").agg(F.min(g).alias("_lo"), F.max(g).alias("_hi"))
    edge = F.col(group_col).eqNullSafe(F.col(f"_lo.{group_col}")) | F.col(group_col).eqNullSafe(F.col(f"_hi.{group_col}"))
    items = base.join(edges, "_blk").where(edge).select(group_col, order_col, size_col, "_blk")
    return items.groupBy(group_col, "_blk").applyInPandas(
        _summarize(max_tokens, charge, group_col, order_col, size_col),
        f"`{group_col}` {types[group_col]}, _blk bigint, lo bigint, hi bigint, linear int, exit_s bigint, "
        f"nb bigint, first_size bigint, first_order {types[order_col]}")


def greedy_chunks(items: DataFrame, group_col: str, order_col: str, size_col: str, max_tokens: int,
                  charge_after_flush: bool = True, block_width: int = DEFAULT_BLOCK_WIDTH) -> DataFrame:
    """``group, order, size, chunk_no``: chunk number (from 0 per group) of each item under next-fit packing
    with budget ``max_tokens``.

    An item starts a new chunk when the open chunk is non-empty and its size plus the item's exceeds the
    budget (strict); an item larger than the budget sits alone in its chunk. With ``charge_after_flush=False``
    the item that starts a chunk is not counted in that chunk's size (a quirk of the original commit packer,
    where chunks can exceed the budget). ``order_col`` must be unique within a group.
    """
    max_tokens = int(max_tokens)
    base = in_blocks(items.select(group_col, order_col, F.col(size_col).cast("bigint").alias(size_col)),
                     group_col, order_col, int(block_width), "pack-items")
    types = dict(base.dtypes)
    gtype, otype = types[group_col], types[order_col]
    summaries = block_summaries(base, group_col, order_col, size_col, max_tokens, charge_after_flush)
    # a group that no block's edge shows lies within one block: it starts from the empty state, without an entry
    entries = summaries.groupBy(group_col).applyInPandas(
        _fold_blocks(max_tokens, charge_after_flush, group_col),
        f"`{group_col}` {gtype}, _blk bigint, entry_s bigint, chunk_base bigint, first boolean")
    assigned = base.groupBy(group_col, "_blk").cogroup(entries.groupBy(group_col, "_blk")).applyInPandas(
        _assign(max_tokens, charge_after_flush, group_col, order_col, size_col),
        f"`{group_col}` {gtype}, `{order_col}` {otype}, `{size_col}` bigint, chunk_no bigint")
    # callers use the assignment several times (chunk starts, texts, counts): write it once
    return materialize(assigned, "pack-chunks")


def pickable(items: DataFrame, group_col: str, order_col: str, num_examples: int) -> DataFrame:
    """The rows of ``(group, order, _cost)`` that some budget could pick: the newest ``num_examples`` order values of
    every (group, cost).

    Exact, not a cut: while picking goes on, what is left of the budget only falls. An item is passed over because more than
    what is left was asked for it, so every newer item of the same cost was picked, or lost its order value to a picked
    one. With ``num_examples`` newer ones picking has ended before an older item comes up. The rows kept of a group are
    bounded by costs x examples whatever its size, and parts of a group can be cut down on their own: Spark does so in
    every task before the exchange (group limit), and a hot group is dealt out by its costs."""
    newest = Window.partitionBy(group_col, "_cost").orderBy(F.col(order_col).desc_nulls_last())
    return items.withColumn("_n", F.dense_rank().over(newest)).where(F.col("_n") <= int(num_examples)).drop("_n")


def pick_examples(items: DataFrame, group_col: str, order_col: str, cost_col: str, budget: int,
                  num_examples: int) -> DataFrame:
    """Newest-first example picking under a budget, skipping what does not fit, stopping at ``num_examples``.

    Costs are whole numbers (token counts). A group is first cut down to its :func:`pickable` rows, at most
    ``(budget + 1) * num_examples`` of them; one walk over these, newest first, makes the picks inside the group's row. The
    plan is lazy: no job runs while it is built. Of rows with equal group and order at most one is picked, the dearest
    that fits. Rows with a null cost are never picked, a null order counts as oldest.
    Returns ``group, order, cost, pick_no`` (1 = newest pick).
    """
    budget, k = int(budget), int(num_examples)
    it = items.select(group_col, order_col, F.col(cost_col).cast("bigint").alias("_cost")).filter(F.col("_cost") <= budget)
    pick = f"struct<o:{dict(it.dtypes)[order_col]},c:bigint>"
    one = F.struct(F.col(order_col).alias("o"), F.col("_cost").alias("c"))
    walked = pickable(it, group_col, order_col, k).groupBy(group_col).agg(
        F.sort_array(F.collect_set(one), asc=False).alias("_items"))

    def step(state, item):
        older = ((F.size(state["picks"]) == 0) | (item["o"] < state["last"])
                 | (item["o"].isNull() & state["last"].isNotNull()))
        fits = (F.size(state["picks"]) < k) & (item["c"] <= state["left"]) & older
        took = F.struct((state["left"] - item["c"]).alias("left"), item["o"].alias("last"),
                        F.concat(state["picks"], F.array(item)).alias("picks"))
        return F.when(fits, took).otherwise(state)

    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.lit(None).cast(pick)["o"].alias("last"),
                     F.array().cast(f"array<{pick}>").alias("picks"))
    picks = walked.select(group_col, F.posexplode(F.aggregate("_items", start, step, lambda s: s["picks"])).alias("_k", "_p"))
    return picks.select(group_col, F.col("_p.o").alias(order_col), F.col("_p.c").alias(cost_col),
                        (F.col("_k") + 1).cast("int").alias("pick_no"))
