"""Packing plans: documents into prompt bundles, changes into diff chunks, history into few-shot examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import clip_tokens, token_count
from ..operators.packing import greedy_chunks, pick_examples
from ..session import materialize, never_broadcast, spread

# The library defaults of the original tool.
BUNDLE_TOKENS = 1600
DIFF_TOKENS = 1400
HISTORY_TOKENS = 1400
NUM_EXAMPLES = 10
EXAMPLE_OVERHEAD = 20


def block_tokens(path_col: str = "path", text_col: str = "text", tokenizer=None):
    """Tokens of a rendered bundle block (comment line with the path, fence, text, fence)."""
    return token_count(text_col, tokenizer) + token_count(path_col, tokenizer) + F.lit(4)


def pack_documents(files: DataFrame, group_col: str = "source", order_col: str = "doc_id",
                   max_tokens: int = BUNDLE_TOKENS, tokenizer=None) -> DataFrame:
    """Chunk number of each file when the files of a group are packed in order into bundles of at most
    ``max_tokens`` tokens (a file larger than that is alone). No empty chunk is emitted."""
    sized = spread(files, order_col).select(group_col, order_col,
                                            block_tokens(tokenizer=tokenizer).alias("n_tokens"))
    chunks = greedy_chunks(sized, group_col, order_col, "n_tokens", max_tokens)
    return chunks.select(group_col, order_col, F.col("n_tokens").cast("int").alias("n_tokens"), "chunk_no")


def pack_changes(changes: DataFrame, max_tokens: int = DIFF_TOKENS, charge_after_flush: bool = True,
                 tokenizer=None) -> DataFrame:
    """Diff chunks of the staged changes of each repo, in ``seq`` order.

    A change larger than ``max_tokens`` is clipped to its first ``max_tokens`` tokens and is a chunk of its own,
    emitted as soon as it is met (ahead of the open chunk). The others are packed next-fit; with
    ``charge_after_flush=False`` the change that opens a chunk is not counted (as the original tool did).

    Output per change: ``repo, seq, n_tokens, truncated, chunk_no`` (NULL for clipped changes) and
    ``emit_seq``: the ``seq`` at which its chunk is emitted (NULL = at the end), which orders chunks.
    """
    # both sides below need the counts: they are written once, as narrow rows, so no text is counted twice
    sized = materialize(spread(changes, "seq").select("repo", "seq", token_count("patch", tokenizer).alias("n_tokens")),
                        "change-sizes")
    normal = sized.filter(F.col("n_tokens") <= max_tokens)
    chunks = greedy_chunks(normal, "repo", "seq", "n_tokens", max_tokens, charge_after_flush)
    starts = chunks.groupBy("repo", "chunk_no").agg(F.min("seq").alias("emit_seq"))
    nxt = starts.select("repo", (F.col("chunk_no") - 1).alias("chunk_no"), "emit_seq")
    packed = (chunks.join(nxt, ["repo", "chunk_no"], "left")
              .select("repo", "seq", F.col("n_tokens").cast("int").alias("n_tokens"), F.lit(False).alias("truncated"),
                      "chunk_no", "emit_seq"))
    big = sized.filter(F.col("n_tokens") > max_tokens).select(
        "repo", "seq", "n_tokens", F.lit(True).alias("truncated"), F.lit(None).cast("bigint").alias("chunk_no"),
        F.col("seq").alias("emit_seq"))
    return packed.unionByName(big)


def chunk_texts(changes: DataFrame, packed: DataFrame, max_tokens: int = DIFF_TOKENS, tokenizer=None) -> DataFrame:
    """Text of each diff chunk: patches joined by newlines; a clipped change keeps its first tokens.

    The group is one chunk, whose size the budget bounds (clipped changes are single rows)."""
    rows = never_broadcast(changes.select("repo", "seq", "patch")).join(packed, ["repo", "seq"])
    body = F.when(F.col("truncated"), clip_tokens("patch", max_tokens, "head", tokenizer)).otherwise(F.col("patch"))
    return (rows.withColumn("_body", body)
            .groupBy("repo", "truncated", "chunk_no", "emit_seq")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "_body"))),
                                          lambda s: s["_body"]), "\n").alias("diff"),
                 F.min("seq").alias("first_seq")))


def conversation_examples(conversations: DataFrame, tokenizer=None) -> DataFrame:
    """History as (context, response) pairs: a user turn and the assistant turn right after it.

    ``cost`` = tokens of both + 20, the per-example overhead of the original tool."""
    u = conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("context"))
    a = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    pairs = u.join(a, ["conv_id", "turn"])
    return pairs.withColumn("cost", token_count("context", tokenizer) + token_count("response", tokenizer)
                            + F.lit(EXAMPLE_OVERHEAD))


def select_examples(pairs: DataFrame, budget: int = HISTORY_TOKENS, num_examples: int = NUM_EXAMPLES) -> DataFrame:
    return pick_examples(pairs, "conv_id", "turn", "cost", budget, num_examples)
