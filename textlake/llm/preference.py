"""Preference formatting: chosen and rejected conversations to one shared prompt and two masked completions.

Input: turns ``(pair_id, side, turn, role, text)`` with side ``chosen`` or ``rejected``. Per pair the longest common
prefix of whole turns (same role, same text) is found by comparing the two turn arrays position by position. The
prefix is rendered once as ``prompt``; the rest of each side is its completion. A completion comes with its mask:
spans of code points ``(start, length)`` that training counts, which are the texts of its assistant turns; role
headers, turn ends and other roles stay masked.

Only DataFrame functions run: one grouped collect of a pair's turns (a pair is one output row, so the group is no
larger than the row that is asked for), then array functions inside the row.

Nulls: a null role is ``user``, a null text is empty, a turn with a null number sorts last; rows with a null pair or
another side are left out. Equal turn numbers are ordered by role and text. Sides that are equal give empty
completions, and the pair has ``differs`` false. A pair with one side missing has an empty completion there and no
prompt. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MID, END = "<|", "|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    """Turns as ``<|role|>\\ntext<|end|>\\n`` blocks."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MID), t["text"],
                                                              F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """Spans of assistant texts in the rendering of ``turns``, walking it once."""
    span = "array<struct<start:int,length:int>>"

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + len(HEAD) + len(MID)
        size = F.length(t["text"])
        new = F.array(F.struct(start.cast("int").alias("start"), size.cast("int").alias("length")))
        return F.struct((start + size + len(END)).cast("int").alias("at"),
                        F.when(t["role"] == "assistant", F.concat(acc["spans"], new)).otherwise(acc["spans"])
                        .alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame) -> DataFrame:
    """``(pair_id, n_prefix, differs, prompt, chosen, chosen_mask, rejected, rejected_mask)``, one row per pair."""
    one = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"),
                   F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def side(name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == name, one))),
                           lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    pairs = (turns.where("pair_id is not null and side in ('chosen', 'rejected')").groupBy("pair_id")
             .agg(side("chosen").alias("_c"), side("rejected").alias("_r")))
    same = F.zip_with("_c", "_r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]),
                                                          F.lit(False)))
    cut = pairs.select("*", same.alias("_same")).select("*", F.when(
        F.array_position("_same", False) > 0, F.array_position("_same", False) - 1).otherwise(F.size("_same"))
        .cast("int").alias("n_prefix"))
    rest = lambda name: F.slice(name, F.col("n_prefix") + 1, F.size(name))
    parts = cut.select("pair_id", "n_prefix", F.slice("_c", 1, F.col("n_prefix")).alias("_p"),
                       F.when(F.size("_c") > 0, rest("_c")).otherwise(F.col("_c")).alias("_cc"),
                       F.when(F.size("_r") > 0, rest("_r")).otherwise(F.col("_r")).alias("_rr"))
    return parts.select("pair_id", "n_prefix", ((F.size("_cc") > 0) | (F.size("_rr") > 0)).alias("differs"),
                        _render(F.col("_p")).alias("prompt"),
                        _render(F.col("_cc")).alias("chosen"), _spans(F.col("_cc")).alias("chosen_mask"),
                        _render(F.col("_rr")).alias("rejected"), _spans(F.col("_rr")).alias("rejected_mask"))


def stale_answer_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations ``(conv_id, turn, role, text)``.

    For every conversation with two or more assistant turns: chosen is the conversation up to its last assistant
    turn; rejected is the same, but answers that last time with its previous assistant text again. Conversations with
    one assistant turn get an empty rejected answer; those without give no pair. A turn with a null number comes after all
    numbered ones, a null text is empty; turns that tie with the last answer's number stay. Rows with a null conversation
    are left out.
    """
    place = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"))
    order = F.struct(place.alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    heard = conversations.where("conv_id is not null")
    last = heard.where("role = 'assistant'").groupBy("conv_id").agg(F.max(order).alias("_last"))
    before = (heard.where("role = 'assistant'").join(last, "conv_id").where(order < F.col("_last"))
              .groupBy("conv_id").agg(F.max(order).alias("_before")))
    ends = last.join(before, "conv_id", "left")
    both = (heard.join(ends, "conv_id").where(place <= F.col("_last.place"))
            .withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected")))))
    stale = (F.col("side") == "rejected") & (F.col("role") == "assistant") & (order == F.col("_last"))
    return both.select(F.col("conv_id").alias("pair_id"), "side", "turn", "role",
                       F.when(stale, F.coalesce("_before.text", F.lit(""))).otherwise(F.col("text")).alias("text"))
