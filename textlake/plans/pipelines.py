"""End-to-end pipelines of the original commands, as DataFrame plans.

* :func:`rate_messages`      — rate commit messages (few-shot prompt → model → rating)
* :func:`summarize_changes`  — commit message per repo: pack diffs, pick history examples, one call per chunk,
  then a combining call where a repo has several chunks (two-stage map-reduce)
* :func:`transform_documents` — pack files into bundles, one call per bundle, parse the answer back into files,
  compare with the originals
* :func:`create_documents`   — request → model → files

Model calls go through :func:`textlake.operators.infer.batch_infer`; ``make_fn`` builds the user's model
function once per task. Chunks and bundles are answered in parallel, not one after another. Every pipeline takes ``log``, an
:class:`~textlake.operators.answer_log.AnswerLog`: answers are then cached and the calls resumable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.tokens import token_count
from ..operators import diffs as D
from ..operators import prompts as PR
from ..operators.answer_log import AnswerLog
from ..operators.infer import batch_infer
from ..operators.packing import pick_examples
from ..session import broadcast_if_light, broadcast_if_small, materialize, never_broadcast
from ..sources.changes import require_changes
from ..sources.tables import require_files
from . import packing as P
from .texts import BUILTIN_EXAMPLES, COMBINE_REQUEST, COMMIT_PRE_PROMPT, CREATE_PRE_PROMPT, DEFAULT_PRE_PROMPT
from .texts import RATING_PRE_PROMPT
from .texts import TRANSFORM_PRE_PROMPT

DEFAULT_OUTPUT_TOKENS = 400


def example_array(set_name: str) -> Column:
    """A built-in example set as a literal ``ARRAY<STRUCT<context, request, response>>`` (a few rows, fixed)."""
    items = sorted((seq, c, r, a) for s, seq, c, r, a in BUILTIN_EXAMPLES if s == set_name)
    return F.array(*[F.struct(F.lit(c).alias("context"), F.lit(r).cast("string").alias("request"),
                              F.lit(a).alias("response")) for _seq, c, r, a in items])


EXAMPLE_SETS = tuple(dict.fromkeys(s for s, *_ in BUILTIN_EXAMPLES))


def example_prompts(texts: DataFrame, key_cols, text_col: str = "text", pre_prompt: str = DEFAULT_PRE_PROMPT,
                    tokenizer=None) -> DataFrame:
    """``*keys, example_set, n_examples, prompt, prompt_tokens``: every text as a task behind each built-in example set, with
    the set's own request line. Row-local; the sets are literals of a few rows."""
    sets = F.array(*[F.struct(F.lit(s).alias("example_set"), example_array(s).alias("examples")) for s in EXAMPLE_SETS])
    each = texts.select(*key_cols, text_col, F.explode(sets).alias("_s")).select(*key_cols, text_col, "_s.*")
    request = F.element_at("examples", 1)["request"]
    out = each.select(*key_cols, "example_set", F.size("examples").alias("n_examples"),
                      PR.assemble_prompt(text_col, request, F.lit(pre_prompt), F.col("examples")).alias("prompt"))
    return out.withColumn("prompt_tokens", token_count("prompt", tokenizer))


def _answers(prompts: DataFrame, make_fn, key_cols, strip: bool = True, model: str | None = None,
             max_output_tokens: int | None = None, tokenizer=None, log: AnswerLog | None = None, **kw) -> DataFrame:
    """Model answers, cleaned; ``key_cols`` (any columns) are carried through the call.

    With ``log`` only prompts without a live answer in it are sent, each once, and a run that was cut short goes on where it
    was. The calls then run while the plan is built.

    With ``model`` its window holds: a prompt that leaves too little of it is not sent, and an answer beyond the output
    budget (``max_output_tokens``, else what the prompt leaves) is not used. Both give a row with ``error`` set. Without
    ``model`` only ``max_output_tokens`` is checked, where given."""
    keys, checked = list(key_cols), model is not None or max_output_tokens is not None
    def call(asked: DataFrame, carried: list[str]) -> DataFrame:
        if log is None:
            return batch_infer(asked, make_fn, key_cols=carried, **kw)
        return log.answer(asked, make_fn, key_cols=carried, model=model, **kw)

    if not checked:
        out = call(prompts, keys)
        return out.select(*keys, PR.clean_response("response", strip=strip).alias("answer"), "error")
    limit = None if max_output_tokens is None else F.lit(int(max_output_tokens))
    n, budget, fits = PR.prompt_budget("prompt", F.lit(model), limit, tokenizer=tokenizer)
    sized = prompts.select(*keys, "prompt", n, budget, fits)
    if model is not None and limit is not None:  # the asked output has to fit beside the prompt
        sized = sized.withColumn("fits", F.col("prompt_tokens") + limit <= PR.model_window(F.lit(model)))
    sent = sized.withColumn("prompt", F.when(F.col("fits"), F.col("prompt"))).withColumn("_long", F.when(
        ~F.col("fits"), F.concat(F.lit("prompt too long: "), F.col("prompt_tokens").cast("string"), F.lit(" tokens"))))
    out = call(sent, [*keys, "output_budget", "_long"])
    _finished, overflow = PR.response_flags("response", "output_budget", tokenizer)
    cut = F.when(overflow, F.concat(F.lit("answer longer than "), F.col("output_budget").cast("string"), F.lit(" tokens")))
    out = out.withColumn("error", F.coalesce("_long", "error", cut))
    return out.select(*keys, F.when(F.col("error").isNull(), PR.clean_response("response", strip=strip)).alias("answer"),
                      "error")


def _first_error(col: str = "error") -> Column:
    """One error of a group (the smallest text, so that reruns agree); NULL when no call failed."""
    return F.min(col)


def rate_messages(messages: DataFrame, make_fn, key_col: str = "msg_id", message_col: str = "message",
                  **kw) -> DataFrame:
    """``key, rating, comment, error``: each message rated 0-10 with the rating examples as few-shot context."""
    prompts = messages.select(key_col, PR.assemble_prompt(message_col, F.lit(None).cast("string"),
                                                          F.lit(RATING_PRE_PROMPT), example_array("rating"))
                              .alias("prompt"))
    ans = _answers(prompts, make_fn, [key_col], **kw)
    return ans.select(key_col, PR.extract_rating("answer").alias("rating"), F.col("answer").alias("comment"), "error")


def history_examples(history: DataFrame, make_rating_fn, max_log_tokens: int = P.HISTORY_TOKENS,
                     num_examples: int = P.NUM_EXAMPLES, tokenizer=None, **kw) -> DataFrame:
    """Few-shot examples per repo from its history ``(repo, seq, patch, message)``: newest first under the token
    budget, each rated by the model to set the quality of its request. ``repo, examples`` (at most
    ``num_examples`` per repo, so the collected list is bounded).

    The picks are made on narrow rows and written before any text moves: only picked texts leave the scan of the history.
    The ratings are asked, and the examples written, while the plan is built."""
    sized = materialize(history.select("repo", "seq", (token_count("message", tokenizer) + token_count("patch", tokenizer)
                                                       + F.lit(P.EXAMPLE_OVERHEAD)).alias("cost")), "history-sizes")
    picks = materialize(pick_examples(sized, "repo", "seq", "cost", max_log_tokens, num_examples).select(
        "repo", "seq", "pick_no"), "history-picks")
    msg_id = F.concat_ws("#", "repo", F.col("seq").cast("string")).alias("msg_id")
    picked = materialize(never_broadcast(history).join(broadcast_if_small(picks), ["repo", "seq"]).select(
        msg_id, "repo", "pick_no", "patch", "message"), "history-picked")
    rated = rate_messages(picked.select("msg_id", "message"), make_rating_fn, tokenizer=tokenizer, **kw)
    # a failed rating is no rating of 0: such an example is left out
    ex = never_broadcast(picked).join(rated, "msg_id").where(F.col("error").isNull()).select(
        "repo", "pick_no", F.struct(F.col("patch").alias("context"),
                                    PR.request_text(F.coalesce("rating", F.lit(0))).alias("request"),
                                    F.col("message").alias("response")).alias("ex"))
    return materialize(ex.groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct("pick_no", "ex"))),
                                                          lambda s: s["ex"]).alias("examples")), "history-examples")


def summarize_changes(changes: DataFrame, history: DataFrame, make_fn, make_rating_fn, *,
                      max_diff_tokens: int = P.DIFF_TOKENS, max_log_tokens: int = P.HISTORY_TOKENS,
                      num_examples: int = P.NUM_EXAMPLES, use_builtin_examples: bool = True, hint: str | None = None,
                      max_output_tokens: int | None = DEFAULT_OUTPUT_TOKENS, **kw) -> DataFrame:
    """``repo, n_chunks, message, error``: one commit message per repo for its staged changes.

    A message of more than ``max_output_tokens`` is an error. ``model`` and ``tokenizer`` are honoured throughout.
    ``error`` is set, and ``message`` NULL, where any model call of the repo failed."""
    require_changes(changes)
    packed = P.pack_changes(changes, max_diff_tokens, tokenizer=kw.get("tokenizer"))
    chunks = P.chunk_texts(changes, packed, max_diff_tokens, kw.get("tokenizer")).withColumn(
        "chunk_id", F.concat_ws("#", "repo", F.coalesce(F.col("emit_seq"), F.lit(-1)).cast("string"),
                                F.col("first_seq").cast("string")))
    tokenizer = kw.get("tokenizer")
    hist = history_examples(history, make_rating_fn, max_log_tokens, num_examples, tokenizer,
                            **{k: v for k, v in kw.items() if k != "tokenizer"})
    builtin = example_array("commit") if use_builtin_examples else F.array()
    ex_col = F.concat(builtin, F.coalesce(F.col("examples"), F.array()))
    request = PR.request_text(F.lit(10), F.lit(hint).cast("string"))
    # emit order of the chunks: by emit_seq, the final chunk (NULL) last; unique within a repo
    ord_key = F.coalesce(F.col("emit_seq"), F.lit(2 ** 62))
    # the chunks stay where they are if the examples of all repos are light; else these are joined by shuffle and AQE splits a
    # hot repo's chunks
    hist = broadcast_if_light(hist, F.octet_length(F.to_json("examples")))
    prompts = chunks.join(hist, "repo", "left").select(
        "repo", ord_key.alias("ord"),
        PR.assemble_prompt("diff", request, F.lit(COMMIT_PRE_PROMPT), ex_col).alias("prompt"))
    # one linear path from here: the answers are never joined back or split into two branches
    items = _answers(prompts, make_fn, ["repo", "ord"], max_output_tokens=max_output_tokens, **kw)
    # one combining call over all messages of a repo in emit order, whatever their number; the prompt that holds them
    # is one output row. A failed chunk leaves the repo without a message, never with one made of the others.
    agg = items.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_chunks"), _first_error().alias("_chunk_error"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "answer"))), lambda s: s["answer"]),
                     "\n").alias("joined"))
    prompt = F.when((F.col("n_chunks") > 1) & F.col("_chunk_error").isNull(), PR.assemble_prompt(
        "joined", F.lit(COMBINE_REQUEST), F.lit(DEFAULT_PRE_PROMPT), example_array("combine")))
    # a combined repo's messages travel in its prompt only: beside it, just the message of a single chunk is carried
    alone = F.when(F.col("n_chunks") == 1, F.col("joined"))
    ans = _answers(agg.withColumn("prompt", prompt).withColumn("joined", alone), make_fn,
                   ["repo", "n_chunks", "_chunk_error", "joined"], max_output_tokens=max_output_tokens, **kw)
    message = F.when(F.col("n_chunks") > 1, F.col("answer")).otherwise(F.col("joined"))
    return ans.withColumn("error", F.coalesce("_chunk_error", "error")).select(
        "repo", "n_chunks", F.when(F.col("error").isNull(), message).alias("message"), "error")


def originals_or_empty(results: DataFrame, originals: DataFrame, path_col: str = "path") -> DataFrame:
    """Each result file with the original text at its path, ``""`` where there is none (left outer join)."""
    o = originals.select(F.col(path_col), F.col("text").alias("original"))
    return results.join(o, path_col, "left").withColumn("original", F.coalesce("original", F.lit("")))


def transform_documents(files: DataFrame, request: str, make_fn, *, group_col: str = "source",
                        order_col: str = "doc_id", max_chunk_tokens: int | None = P.BUNDLE_TOKENS,
                        pre_prompt: str = TRANSFORM_PRE_PROMPT, **kw) -> DataFrame:
    """``path, text, original, added, removed, error``: files rewritten by the model, bundle by bundle.

    ``max_chunk_tokens=None`` puts each group in one bundle. A bundle whose call failed gives one row for each of its
    files, with ``error`` set and the text NULL."""
    require_files(files.select(order_col))
    if max_chunk_tokens is None:
        packed = files.select(group_col, order_col, F.lit(0).cast("bigint").alias("chunk_no"))
    else:
        packed = P.pack_documents(files, group_col, order_col, max_chunk_tokens, kw.get("tokenizer")).select(
            group_col, order_col, "chunk_no")
    bundles = PR.render_bundles(files.join(packed, [group_col, order_col]), [group_col, "chunk_no"], order_col)
    prompts = bundles.select(F.concat_ws("#", group_col, F.col("chunk_no").cast("string")).alias("bundle_id"),
                             PR.assemble_prompt("bundle", F.lit(request), F.lit(pre_prompt)).alias("prompt"))
    ans = _answers(prompts, make_fn, ["bundle_id"], strip=False, **kw)
    # answers feed two branches (files and failures): they are written once, so no call is repeated
    ans = materialize(ans, "transform-answers")
    out = PR.parse_bundle(ans, "answer", ["bundle_id"]).select("path", "text")
    merged = originals_or_empty(out, files.select("path", "text"))
    good = D.with_diff_stats(merged, "original", "text").withColumn("error", F.lit(None).cast("string"))
    failed = ans.where(F.col("error").isNotNull()).select("bundle_id", "error")
    members = files.join(packed, [group_col, order_col]).select(
        F.concat_ws("#", group_col, F.col("chunk_no").cast("string")).alias("bundle_id"), "path",
        F.col("text").alias("original"))
    bad = members.join(failed, "bundle_id").select("path", "original", "error")
    return good.unionByName(bad, allowMissingColumns=True)


def create_documents(requests: DataFrame, make_fn, key_col: str = "req_id", request_col: str = "request",
                     pre_prompt: str = CREATE_PRE_PROMPT, **kw) -> DataFrame:
    """``key, file_pos, path, text, error``: the files the model writes for each request (context: no input).

    A request whose call failed is one row with ``error`` set and no file."""
    prompts = requests.select(key_col, PR.assemble_prompt(F.lit(X.NO_INPUT), F.col(request_col),
                                                          F.lit(pre_prompt)).alias("prompt"))
    ans = _answers(prompts, make_fn, [key_col], strip=False, **kw)
    return PR.parse_bundle(ans, "answer", [key_col, "error"], keep_failed="error").select(
        key_col, "file_pos", "path", "text", "error")
