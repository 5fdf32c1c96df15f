"""Prompt building, bundle rendering/parsing and answer post-processing, as column expressions.

Everything here is row-local (no shuffle) except :func:`render_bundles`, which groups the blocks of one bundle;
a bundle is bounded by the packing budget (or is a single oversize file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.tokens import token_count


def _c(col) -> Column:
    if isinstance(col, Column):
        return col
    return F.col(col) if isinstance(col, str) else F.lit(col)


def request_text(quality, hint=None) -> Column:
    """``Write a commit message for the given diff (quality: q/10)`` plus `` (hint: h)`` when a hint is set."""
    base = F.concat(F.lit("Write a commit message for the given diff (quality: "), _c(quality).cast("string"),
                    F.lit("/10)"))
    if hint is None:
        return base
    h = _c(hint)
    return F.when(h.isNull(), base).otherwise(F.concat(base, F.lit(" (hint: "), h, F.lit(")")))


def _heading(text: str, mark: bool) -> Column:
    return F.lit(text + (X.EXAMPLE_SUFFIX if mark else ""))


def assemble_prompt(context, request, pre_prompt, examples=None, mark_examples: bool = False) -> Column:
    """The prompt text: pre-prompt, end-marker instruction, examples, then the task, ending at the start marker.

    ``examples`` is an ``ARRAY<STRUCT<context, request, response>>`` column (NULL or empty: none); a NULL request
    drops its heading and line, for the examples and for the task.
    """
    parts = [_c(pre_prompt), F.lit(X.END_INSTRUCTION)]
    if examples is not None:
        def one(e):
            req = F.when(e["request"].isNotNull(),
                         F.concat_ws("\n", _heading(X.REQUEST_HEADING, mark_examples), e["request"]))
            return F.concat_ws("\n", _heading(X.CONTEXT_HEADING, mark_examples), e["context"], req,
                               _heading(X.RESPONSE_HEADING, mark_examples), F.lit(X.START_MARKER), e["response"],
                               F.lit(X.END_MARKER))

        block = F.array_join(F.transform(F.coalesce(_c(examples), F.array()), one), "\n")
        parts.append(F.nullif(block, F.lit("")))
    req = _c(request)
    parts += [F.lit(X.CONTEXT_HEADING), _c(context),
              F.when(req.isNotNull(), F.concat_ws("\n", F.lit(X.REQUEST_HEADING), req)),
              F.lit(X.RESPONSE_HEADING), F.lit(X.START_MARKER)]
    return F.concat_ws("\n", *parts)


def model_window(model) -> Column:
    m = _c(model)
    expr = F.lit(X.DEFAULT_WINDOW)
    for name, window in X.MODEL_WINDOWS.items():
        expr = F.when(m == F.lit(name), F.lit(window)).otherwise(expr)
    return expr


def prompt_budget(prompt, model, max_output_tokens=None, min_output_tokens: int = X.MIN_OUTPUT_TOKENS,
                  tokenizer=None) -> list[Column]:
    """``prompt_tokens``, ``output_budget`` and ``fits``: with no output limit the budget is the model window
    minus the prompt; a prompt that leaves less than ``min_output_tokens`` is flagged instead of raising."""
    n = token_count(prompt, tokenizer)
    if max_output_tokens is None:
        budget = model_window(model) - n
    else:
        budget = _c(max_output_tokens)
    return [n.alias("prompt_tokens"), budget.cast("int").alias("output_budget"),
            (budget >= F.lit(int(min_output_tokens))).alias("fits")]


def longest_backtick_run(text) -> Column:
    runs = F.regexp_extract_all(_c(text), F.lit("`+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def render_block(path, text) -> Column:
    """One file of a bundle: ``<!-- path -->``, a fence longer than any backtick run in the text, text, fence."""
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_backtick_run(text) + 1))
    return F.concat(F.lit("<!-- "), _c(path), F.lit(" -->\n"), fence, F.lit("\n"), _c(text), F.lit("\n"), fence)


def render_bundles(files: DataFrame, bundle_cols, order_col: str, path_col: str = "path",
                   text_col: str = "text") -> DataFrame:
    """Files → one markdown text per bundle, blocks in ``order_col`` order joined by newlines."""
    blocks = files.select(*bundle_cols, order_col, render_block(path_col, text_col).alias("_block"))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("_block").alias("b"))))
    return blocks.groupBy(*bundle_cols).agg(F.array_join(F.transform(parts, lambda p: p["b"]), "\n").alias("bundle"))


# A file block: comment with the path (its fence may follow on the same line), opening fence with an optional
# info string, body, and a closing fence line equal to the opening one.
BLOCK_PATTERN = r"(?ms)^<!-- ([^\n]+?) -->\n?(`{3,})[^`\n]*\n(.*?)^\2[ \t]*$"
BLOCK_HEAD, BLOCK_END = r"\A<!-- ([^\n]+?) -->\n?`{3,}[^`\n]*\n", r"\n?`{3,}[ \t]*\z"
# DuckDB's regex engine has no back-references: the oracle reads three-backtick fences only.
BLOCK_PATTERN_SQL = r"(?ms)^<!-- ([^\n]+?) -->\n?```[^`\n]*\n(.*?)^```[ \t]*$"


def parse_bundle(df: DataFrame, bundle_col: str, keep_cols=(), keep_failed: str | None = None) -> DataFrame:
    """Markdown → rows ``(*keep_cols, file_pos, path, text)``, one per file block (generator, no shuffle).

    Paths are anything on one line. ``keep_failed`` names a column: rows where it is set stay, without a file."""
    blocks = F.regexp_extract_all(F.col(bundle_col), F.lit(BLOCK_PATTERN), F.lit(0))
    explode = F.posexplode if keep_failed is None else F.posexplode_outer
    out = df.select(*keep_cols, explode(blocks).alias("file_pos", "_block"))
    if keep_failed is not None:
        out = out.where(F.col("file_pos").isNotNull() | F.col(keep_failed).isNotNull())
    # the pattern with its back-reference runs once per bundle; a block's head and closing fence are cut off by plain ones
    body = F.regexp_replace(F.regexp_replace("_block", BLOCK_HEAD, ""), BLOCK_END, "")
    return out.select(*keep_cols, F.col("file_pos").cast("int").alias("file_pos"),
                      F.nullif(F.regexp_extract("_block", BLOCK_HEAD, 1), F.lit("")).alias("path"), body.alias("text"))


def clean_response(response, strip: bool = True) -> Column:
    """Remove every end marker; ``strip`` also trims white space as Python's ``str.strip``."""
    r = F.replace(_c(response), F.lit(X.END_MARKER), F.lit(""))
    if strip:
        r = F.regexp_replace(r, f"^{X.STRIP_CLASS}+|{X.STRIP_CLASS}+$", "")
    return r


def response_flags(response, max_output_tokens, tokenizer=None) -> list[Column]:
    """``finished``: the end marker is present; ``overflow``: the answer used more than the output budget."""
    r = _c(response)
    return [F.contains(r, F.lit(X.END_MARKER)).alias("finished"),
            (token_count(r, tokenizer) > _c(max_output_tokens)).alias("overflow")]


def extract_rating(response) -> Column:
    """First ``(RATING: d/10)`` (one or two digits) as INT; NULL when there is none."""
    return F.regexp_extract(_c(response), X.RATING_PATTERN, 1).try_cast("int")
