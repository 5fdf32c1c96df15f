"""Registered queries: one DataFrame plan per operator of the inventory, each with its DuckDB twin.

Every plan reads whole tables from ``sf_dir`` (or data Spark derives from them); parameters are the tool's
defaults unless the key says otherwise.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lines import flatten_newlines
from ..functions.tokens import clip_tokens, token_count
from ..functions.vectors import cosine, round6, round_half_away
from ..operators.embed import HashedEmbedder
from ..operators.fragments import combine_fragments, with_end_line
from ..operators.search import top_n_search
from ..operators.vector_cache import VectorCache, embed_with_cache
from ..operators.vector_index import build_index, indexed_search
from ..session import broadcast_if_small, ensure_checkpoint_dir, ship_package, spread
from ..sources.tables import DOCUMENT_PATH_SQL, non_empty, read_documents, read_table, table_path
from . import search as S
from .sqlparts import (bucket_sql, cosine_sql, hashed_tokens_sql, hashed_vector_sql, round6_sql, split_lines_sql,
                       token_count_sql)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return deco


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


# ---------------------------------------------------------------- sources
@register("read_documents", f"SELECT doc_id, source, {DOCUMENT_PATH_SQL} AS path, text FROM documents")
def q_read_documents(spark, sf_dir):
    """Documents as files (path, whole text)."""
    return read_documents(spark, sf_dir)


@register("non_empty_documents", f"SELECT doc_id, {DOCUMENT_PATH_SQL} AS path, text FROM documents WHERE text <> ''")
def q_non_empty(spark, sf_dir):
    return non_empty(read_documents(spark, sf_dir).select("doc_id", "path", "text"))


# ---------------------------------------------------------------- fragments
def fragments_sql(n: int, min_lines: int = 0, with_end: bool = False) -> str:
    extra = f" AND len({split_lines_sql('contents')}) >= {int(min_lines)}" if min_lines > 0 else ""
    end = (", CAST(start_line + length(contents) - length(replace(contents, chr(10), '')) AS INTEGER) AS end_line"
           if with_end else "")
    return f"""
WITH d AS (SELECT doc_id, {split_lines_sql('text')} AS lines FROM documents WHERE text <> ''),
e AS (SELECT doc_id, lines, unnest(range(0, CAST(ceil(len(lines) / {n}.0) AS BIGINT))) AS i FROM d),
f AS (SELECT doc_id, CAST(i * {n} AS INTEGER) AS start_line,
             array_to_string(lines[i * {n} + 1 : i * {n} + {n}], chr(10)) AS contents FROM e)
SELECT doc_id, start_line, contents{end} FROM f WHERE contents <> ''{extra}"""


@register("fragments", fragments_sql(10))
def q_fragments(spark, sf_dir):
    """split_file: 10-line fragments, empty ones dropped."""
    return S.fragments(_docs(spark, sf_dir), 10)


@register("fragments_min_lines", fragments_sql(20, 12))
def q_fragments_min_lines(spark, sf_dir):
    """20-line fragments keeping those with at least 12 lines."""
    return S.fragments(_docs(spark, sf_dir), 20, 12)


@register("fragment_spans", fragments_sql(20, with_end=True))
def q_fragment_spans(spark, sf_dir):
    return with_end_line(S.fragments(_docs(spark, sf_dir), 20))


@register("combine_fragments", f"""
WITH f AS ({fragments_sql(10)})
SELECT doc_id, string_agg(contents, chr(10) ORDER BY start_line) AS text FROM f GROUP BY doc_id""")
def q_combine_fragments(spark, sf_dir):
    """Fragments joined back per file with a newline separator (round trip of the split)."""
    return combine_fragments(S.fragments(_docs(spark, sf_dir), 10), ["doc_id"], "\n")


@register("flatten_newlines", "SELECT doc_id, replace(text, chr(10), ' ') AS flat_text FROM documents")
def q_flatten(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", flatten_newlines("text").alias("flat_text"))


# ---------------------------------------------------------------- embedding
@register("hash_embed", f"""
SELECT doc_id, CAST({bucket_sql('t')} AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS n
FROM (SELECT doc_id, unnest({hashed_tokens_sql('text')}) AS t FROM documents) GROUP BY ALL""")
def q_hash_embed(spark, sf_dir):
    """Sparse hashed bag of words per document: (doc_id, bucket, n)."""
    docs = spread(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return HashedEmbedder().sparse(docs, ["doc_id"], "text")


# ---------------------------------------------------------------- similarity
CENTROIDS_SQL = """
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (
        SELECT label, i, avg(x) AS m FROM (
          SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x,
                 unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i)
      GROUP BY label)"""


@register("cosine", f"""
WITH {CENTROIDS_SQL.strip()}
SELECT e.vec_id, e.label, {round6_sql(cosine_sql('CAST(e.embedding AS DOUBLE[])', 'c.centroid'))} AS cosine
FROM embeddings e JOIN c ON e.label = c.label""")
def q_cosine(spark, sf_dir):
    """Cosine of each stored vector with its label's centroid (JVM-side array functions)."""
    emb = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    cells = emb.select("label", F.posexplode("embedding").alias("i", "x"))
    cent = (cells.groupBy("label", "i").agg(F.avg("x").alias("m"))
            .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("_c"))
            .select("label", F.transform("_c", lambda s: s["m"]).alias("centroid")))
    # few labels: every label is a hot key, so the centroids are broadcast once their row count is checked
    return emb.join(broadcast_if_small(cent), "label").select(
        "vec_id", "label", round6(cosine("embedding", "centroid")).alias("cosine"))


def search_sql(n_lines: int, top_n: int | None, threshold: float | None, min_lines: int = 0,
               extra_cols: str = "") -> str:
    rank_filter = f"WHERE rank <= {int(top_n)}" if top_n is not None else ""
    thr = f"AND sim >= {threshold!r}" if threshold is not None else ""
    return f"""
WITH f AS ({fragments_sql(n_lines, min_lines)}),
fv AS (SELECT doc_id, start_line, {hashed_vector_sql('contents')} AS v FROM f),
q AS (SELECT item_id, {hashed_vector_sql('text')} AS v FROM benchmark),
s AS (SELECT q.item_id, fv.doc_id, fv.start_line, {cosine_sql('fv.v', 'q.v')} AS sim FROM q, fv),
r AS (SELECT item_id, doc_id, start_line, round(sim, 6) AS similarity,
             CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 6) DESC, doc_id, start_line)
                  AS INTEGER) AS rank
      FROM s WHERE sim IS NOT NULL {thr})
SELECT item_id, doc_id, start_line, similarity, rank{extra_cols} FROM r {rank_filter}"""


@register("semantic_search", search_sql(20, 3, 0.0))
def q_semantic_search(spark, sf_dir):
    """search: every benchmark text as a query over all documents, 20-line fragments, top 3, threshold 0."""
    return S.semantic_search(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@register("semantic_search_batch", search_sql(10, 5, 0.25, min_lines=3))
def q_semantic_search_batch(spark, sf_dir):
    """Many-query search with the other knobs set: 10-line fragments of at least 3 lines, top 5, threshold 0.25."""
    return S.semantic_search(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), fragment_lines=10,
                             min_fragment_lines=3, top_n=5, threshold=0.25)


@register("search_threshold", search_sql(20, None, 0.6))
def q_search_threshold(spark, sf_dir):
    """Every fragment with similarity >= 0.6 to a query (no top-n)."""
    return S.semantic_search(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), top_n=None,
                             threshold=0.6)


@register("similarity_stats", f"""
WITH f AS ({fragments_sql(20)}),
fv AS (SELECT doc_id, start_line, {hashed_vector_sql('contents')} AS v FROM f),
q AS (SELECT item_id, {hashed_vector_sql('text')} AS v FROM benchmark),
s AS (SELECT q.item_id, {cosine_sql('fv.v', 'q.v')} AS sim FROM q, fv)
SELECT item_id, count(sim) AS n_scored, round(min(sim), 6) AS sim_min, round(max(sim), 6) AS sim_max,
       round(avg(sim), 6) AS sim_mean, round(median(sim), 6) AS sim_median, round(stddev_pop(sim), 6) AS sim_std
FROM s GROUP BY item_id""")
def q_similarity_stats(spark, sf_dir):
    return S.search_statistics(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@register("search_topn", search_sql(10, 10, 0.0))
def q_search_topn(spark, sf_dir):
    """Top 10 per query over 10-line fragments."""
    return S.semantic_search(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), fragment_lines=10,
                             top_n=10)


@register("search_ranked", search_sql(20, 3, 0.0, extra_cols=(
    ", CAST(count(*) OVER (PARTITION BY item_id) - rank + 1 AS INTEGER) AS display_pos")))
def q_search_ranked(spark, sf_dir):
    """Ranked results with the display position of the default ``ascending`` order (best shown last)."""
    res = S.semantic_search(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    n = F.count(F.lit(1)).over(Window.partitionBy("item_id"))
    return res.withColumn("display_pos", (n - F.col("rank") + 1).cast("int"))


@register("search_report", f"""
WITH r AS ({search_sql(20, 3, 0.0)}), f AS ({fragments_sql(20)})
SELECT r.item_id, r.doc_id, r.start_line, r.rank, 'Result ' || CAST(r.rank AS VARCHAR) AS header,
       round(r.similarity, 2) AS similarity_2, {DOCUMENT_PATH_SQL.replace('source', 'd.source').replace('doc_id', 'd.doc_id')} AS path,
       f.contents
FROM r JOIN f ON r.doc_id = f.doc_id AND r.start_line = f.start_line JOIN documents d ON d.doc_id = r.doc_id""")
def q_search_report(spark, sf_dir):
    """Result rows as printed: header, similarity to 2 places, path, first line number, text."""
    docs = _docs(spark, sf_dir)
    res = S.semantic_search(docs, read_table(spark, sf_dir, "benchmark"))
    rep = S.search_report(docs, res)
    return rep.select("item_id", "doc_id", "start_line", "rank", "header",
                      round_half_away(F.col("similarity"), 2).alias("similarity_2"), "path", "contents")


_VECTOR_TOPN_SQL = f"""
WITH q AS (SELECT item_id, {hashed_vector_sql('text')} AS v FROM benchmark),
s AS (SELECT q.item_id, e.vec_id, {cosine_sql('CAST(e.embedding AS DOUBLE[])', 'q.v')} AS sim FROM q, embeddings e),
r AS (SELECT item_id, vec_id, round(sim, 6) AS similarity,
             CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 6) DESC, vec_id) AS INTEGER) AS rank
      FROM s WHERE sim IS NOT NULL AND sim >= 0.0)
SELECT * FROM r WHERE rank <= 3"""


def _stored_vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


@register("vector_topn", _VECTOR_TOPN_SQL)
def q_vector_topn(spark, sf_dir):
    """Search over stored vectors: each benchmark text (hashed, 64 buckets) against ``embeddings``."""
    q = S.embedded_queries(read_table(spark, sf_dir, "benchmark"))
    return top_n_search(spread(_stored_vectors(spark, sf_dir), "vec_id"), q, item_keys=["vec_id"], query_key="item_id",
                        top_n=3, threshold=0.0)


@register("vector_topn_indexed", _VECTOR_TOPN_SQL)
def q_vector_topn_indexed(spark, sf_dir):
    """The same rows as ``vector_topn`` through the exact cell index: cells that cannot reach the n-th score are skipped."""
    index = build_index(spread(_stored_vectors(spark, sf_dir), "vec_id"), item_keys=["vec_id"])
    q = S.embedded_queries(read_table(spark, sf_dir, "benchmark"))
    return indexed_search(index, q, query_key="item_id", top_n=3, threshold=0.0)[0]


# ---------------------------------------------------------------- tokens
@register("token_counts", f"SELECT doc_id, CAST({token_count_sql('text')} AS INTEGER) AS n_tokens FROM documents")
def q_token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", token_count("text").alias("n_tokens"))


def _clip_sql(keep: str, n: int) -> str:
    toks = "regexp_extract_all(text, '[^ \\t\\n\\r]+')"
    part = (f"{toks}[1:{n}]" if keep == "head"
            else f"{toks}[greatest(len({toks}) - {n} + 1, 1):len({toks})]")
    return (f"SELECT doc_id, CASE WHEN len({toks}) > {n} THEN array_to_string({part}, ' ') ELSE text END AS clipped "
            f"FROM documents")


@register("clip_head", _clip_sql("head", 64))
def q_clip_head(spark, sf_dir):
    """First 64 tokens of each document (unchanged when it fits)."""
    return _docs(spark, sf_dir).select("doc_id", clip_tokens("text", 64, "head").alias("clipped"))


@register("clip_tail", _clip_sql("tail", 64))
def q_clip_tail(spark, sf_dir):
    """Last 64 tokens of each document (unchanged when it fits)."""
    return _docs(spark, sf_dir).select("doc_id", clip_tokens("text", 64, "tail").alias("clipped"))


# ---------------------------------------------------------------- packing
from . import packing as P  # noqa: E402
from ..sources.changes import changes_from_documents  # noqa: E402


def _fold_sql(items_sql: str, max_tokens: int, charge: bool) -> str:
    """Recursive CTE of next-fit packing over ``items(g, o, n)``; DuckDB oracle of the block-parallel fold."""
    restart = "i.n" if charge else "0"
    return f"""
items AS (SELECT g, o, n, row_number() OVER (PARTITION BY g ORDER BY o) AS rn FROM ({items_sql})),
fold AS (
  SELECT g, rn, o, n, n AS s, CAST(0 AS BIGINT) AS chunk_no FROM items WHERE rn = 1
  UNION ALL
  SELECT i.g, i.rn, i.o, i.n,
         CASE WHEN f.s + i.n > {max_tokens} THEN {restart} ELSE f.s + i.n END,
         f.chunk_no + CASE WHEN f.s + i.n > {max_tokens} THEN 1 ELSE 0 END
  FROM fold f JOIN items i ON i.g = f.g AND i.rn = f.rn + 1)"""


_DOC_BLOCK_TOKENS_SQL = f"({token_count_sql('text')} + {token_count_sql(DOCUMENT_PATH_SQL)} + 4)"


@register("pack_documents", f"""
WITH RECURSIVE {_fold_sql(f"SELECT source AS g, doc_id AS o, {_DOC_BLOCK_TOKENS_SQL} AS n FROM documents", 1600, True).strip()}
SELECT g AS source, o AS doc_id, CAST(n AS INTEGER) AS n_tokens, chunk_no FROM fold""")
def q_pack_documents(spark, sf_dir):
    """Documents of each source packed in doc_id order into bundles of at most 1,600 tokens."""
    return P.pack_documents(read_documents(spark, sf_dir))


def _pack_changes_sql(max_tokens: int, charge: bool) -> str:
    items = f"SELECT source AS g, doc_id AS o, {token_count_sql('text')} AS n FROM documents"
    return f"""
WITH RECURSIVE {_fold_sql(items + f" WHERE {token_count_sql('text')} <= {max_tokens}", max_tokens, charge).strip()},
starts AS (SELECT g, chunk_no, min(o) AS emit_seq FROM fold GROUP BY g, chunk_no)
SELECT f.g AS repo, f.o AS seq, CAST(f.n AS INTEGER) AS n_tokens, false AS truncated, f.chunk_no, s.emit_seq
FROM fold f LEFT JOIN starts s ON s.g = f.g AND s.chunk_no = f.chunk_no + 1
UNION ALL
SELECT source AS repo, doc_id AS seq, CAST({token_count_sql('text')} AS INTEGER) AS n_tokens, true AS truncated,
       CAST(NULL AS BIGINT) AS chunk_no, doc_id AS emit_seq
FROM documents WHERE {token_count_sql('text')} > {max_tokens}"""


@register("pack_changes", _pack_changes_sql(1400, True))
def q_pack_changes(spark, sf_dir):
    """Staged changes (one per document, repo = source) packed into diff chunks of at most 1,400 tokens."""
    return P.pack_changes(changes_from_documents(_docs(spark, sf_dir)))


@register("pack_changes_compat", _pack_changes_sql(1400, False))
def q_pack_changes_compat(spark, sf_dir):
    """As ``pack_changes`` with the original accounting: the change that opens a chunk is not counted."""
    return P.pack_changes(changes_from_documents(_docs(spark, sf_dir)), charge_after_flush=False)


def _examples_sql(budget: int, k: int) -> str:
    pick = f"f.npicks < {k} AND f.total + i.cost <= {budget}"
    return f"""
WITH RECURSIVE p AS (
  SELECT u.conv_id, u.turn, {token_count_sql('u.text')} + {token_count_sql('a.text')} + 20 AS cost
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
items AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM p),
fold AS (
  SELECT conv_id, rn, turn, cost,
         CASE WHEN {k} > 0 AND cost <= {budget} THEN cost ELSE 0 END AS total,
         CASE WHEN {k} > 0 AND cost <= {budget} THEN 1 ELSE 0 END AS npicks,
         CASE WHEN {k} > 0 AND cost <= {budget} THEN 1 ELSE 0 END AS picked
  FROM items WHERE rn = 1
  UNION ALL
  SELECT i.conv_id, i.rn, i.turn, i.cost,
         CASE WHEN {pick} THEN f.total + i.cost ELSE f.total END,
         f.npicks + CASE WHEN {pick} THEN 1 ELSE 0 END,
         CASE WHEN {pick} THEN 1 ELSE 0 END
  FROM fold f JOIN items i ON i.conv_id = f.conv_id AND i.rn = f.rn + 1)
SELECT conv_id, turn, CAST(cost AS BIGINT) AS cost, CAST(npicks AS INTEGER) AS pick_no FROM fold WHERE picked = 1"""


@register("select_examples", _examples_sql(1400, 10))
def q_select_examples(spark, sf_dir):
    """Few-shot picks per conversation, newest first: budget 1,400 tokens, at most 10, 20 tokens overhead each."""
    return P.select_examples(P.conversation_examples(read_table(spark, sf_dir, "conversations")))


@register("select_examples_tight", _examples_sql(120, 2))
def q_select_examples_tight(spark, sf_dir):
    """As ``select_examples`` with a budget of 120 tokens and 2 examples, so that skipping and stopping occur."""
    return P.select_examples(P.conversation_examples(read_table(spark, sf_dir, "conversations")), 120, 2)


# ---------------------------------------------------------------- prompts and answers
from ..functions import fixed as X  # noqa: E402
from ..operators import prompts as PR  # noqa: E402
from .texts import DEFAULT_PRE_PROMPT  # noqa: E402


def _q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


@register("request_text", f"""
SELECT l.doc_id, 'Write a commit message for the given diff (quality: ' || CAST(l.quality * 10 AS VARCHAR) || '/10)'
       || CASE WHEN l.toxic = 1 THEN ' (hint: ' || d.lang || ')' ELSE '' END AS request
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def q_request_text(spark, sf_dir):
    """Commit request per labelled document: quality = 10·label, hint = language for flagged documents."""
    lab = read_table(spark, sf_dir, "labels")
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    j = lab.join(docs, "doc_id")
    hint = F.when(F.col("toxic") == 1, F.col("lang"))
    return j.select("doc_id", PR.request_text(F.col("quality") * 10, hint).alias("request"))


def _prev_pair_examples(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    users = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("context"))
    pairs = P.conversation_examples(conv).select(
        "conv_id", (F.col("turn") + 2).alias("turn"),
        F.struct(F.col("context"), F.lit(None).cast("string").alias("request"), F.col("response")).alias("ex"))
    j = users.join(pairs, ["conv_id", "turn"], "left")
    return j.select("conv_id", "turn", "context",
                    F.when(F.col("ex").isNotNull(), F.array("ex")).alias("examples"))


def _prompt_sql(request_sql: str, mark: bool) -> str:
    sfx = X.EXAMPLE_SUFFIX if mark else ""
    ex = (f"list_transform(examples, lambda e: concat_ws(chr(10), {_q(X.CONTEXT_HEADING + sfx)}, e.context, "
          f"CASE WHEN e.request IS NOT NULL THEN concat_ws(chr(10), {_q(X.REQUEST_HEADING + sfx)}, e.request) END, "
          f"{_q(X.RESPONSE_HEADING + sfx)}, {_q(X.START_MARKER)}, e.response, {_q(X.END_MARKER)}))")
    return f"""
WITH conv AS (SELECT * FROM conversations),
u AS (SELECT conv_id, turn, text AS context FROM conv WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS response FROM conv WHERE role = 'assistant'),
p AS (SELECT u.conv_id, u.turn + 2 AS turn, u.context, a.response FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn),
x AS (SELECT u.conv_id, u.turn, u.context,
             CASE WHEN p.context IS NULL THEN NULL
                  ELSE [{{'context': p.context, 'request': CAST(NULL AS VARCHAR), 'response': p.response}}] END AS examples
      FROM u LEFT JOIN p ON p.conv_id = u.conv_id AND p.turn = u.turn),
y AS (SELECT conv_id, turn, concat_ws(chr(10), {_q(DEFAULT_PRE_PROMPT)}, {_q(X.END_INSTRUCTION)},
        nullif(array_to_string(coalesce({ex}, []), chr(10)), ''), {_q(X.CONTEXT_HEADING)}, context,
        CASE WHEN {request_sql} IS NOT NULL THEN concat_ws(chr(10), {_q(X.REQUEST_HEADING)}, {request_sql}) END,
        {_q(X.RESPONSE_HEADING)}, {_q(X.START_MARKER)}) AS prompt FROM x)"""


@register("assemble_prompt", _prompt_sql("CAST(NULL AS VARCHAR)", False) + "\nSELECT conv_id, turn, prompt FROM y")
def q_assemble_prompt(spark, sf_dir):
    """Prompt per user turn: the previous (user, assistant) pair of the conversation as example, no request."""
    x = _prev_pair_examples(spark, sf_dir)
    return x.select("conv_id", "turn", PR.assemble_prompt("context", F.lit(None).cast("string"),
                                                          F.lit(DEFAULT_PRE_PROMPT), F.col("examples")).alias("prompt"))


_REQ10 = "Write a commit message for the given diff (quality: 10/10)"


@register("assemble_prompt_marked", _prompt_sql(_q(_REQ10), True) + "\nSELECT conv_id, turn, prompt FROM y")
def q_assemble_prompt_marked(spark, sf_dir):
    """As ``assemble_prompt`` with a request line and example headings marked ``(Example)``."""
    x = _prev_pair_examples(spark, sf_dir)
    return x.select("conv_id", "turn", PR.assemble_prompt("context", PR.request_text(F.lit(10)),
                                                          F.lit(DEFAULT_PRE_PROMPT), F.col("examples"),
                                                          mark_examples=True).alias("prompt"))


@register("prompt_budget", _prompt_sql("CAST(NULL AS VARCHAR)", False) + f"""
SELECT conv_id, turn, CAST({token_count_sql('prompt')} AS INTEGER) AS prompt_tokens,
       CAST(8000 - {token_count_sql('prompt')} AS INTEGER) AS output_budget,
       (8000 - {token_count_sql('prompt')}) >= 1 AS fits FROM y""")
def q_prompt_budget(spark, sf_dir):
    """Prompt tokens, output budget (window of gpt-3.5-turbo minus prompt) and whether the prompt fits."""
    p = QUERIES["assemble_prompt"](spark, sf_dir)
    return p.select("conv_id", "turn", *PR.prompt_budget(F.col("prompt"), F.lit("gpt-3.5-turbo")))


_BLOCK_SQL = ("'<!-- ' || path || ' -->' || chr(10) || repeat('`', greatest(3, coalesce(list_max(list_transform("
              "regexp_extract_all(text, '`+'), lambda r: length(r))), 0) + 1)) || chr(10) || text || chr(10) || "
              "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), "
              "lambda r: length(r))), 0) + 1))")

_BUNDLES_SQL = f"""
WITH RECURSIVE {_fold_sql(f"SELECT source AS g, doc_id AS o, {_DOC_BLOCK_TOKENS_SQL} AS n FROM documents", 1600, True).strip()},
docs AS (SELECT doc_id, {DOCUMENT_PATH_SQL} AS path, text FROM documents),
bundles AS (SELECT f.g AS source, f.chunk_no, string_agg({_BLOCK_SQL}, chr(10) ORDER BY f.o) AS bundle
            FROM fold f JOIN docs d ON d.doc_id = f.o GROUP BY f.g, f.chunk_no)"""


def _bundles(spark, sf_dir):
    files = read_documents(spark, sf_dir)
    packed = P.pack_documents(files).select("source", "doc_id", "chunk_no")
    return PR.render_bundles(files.join(packed, ["source", "doc_id"]), ["source", "chunk_no"], "doc_id")


@register("render_bundle", _BUNDLES_SQL + "\nSELECT source, chunk_no, bundle FROM bundles")
def q_render_bundle(spark, sf_dir):
    """Packed documents rendered as one markdown text per bundle."""
    return _bundles(spark, sf_dir)


@register("parse_bundle", _BUNDLES_SQL + f""",
parsed AS (SELECT source, chunk_no,
                  regexp_extract_all(bundle, {_q(PR.BLOCK_PATTERN_SQL)}, 1) AS paths,
                  regexp_extract_all(bundle, {_q(PR.BLOCK_PATTERN_SQL)}, 2) AS bodies FROM bundles)
SELECT source, chunk_no, CAST(unnest(range(len(paths))) AS INTEGER) AS file_pos, unnest(paths) AS path,
       regexp_replace(unnest(bodies), '\\n$', '') AS text FROM parsed""")
def q_parse_bundle(spark, sf_dir):
    """Rendered bundles parsed back into (path, text) rows."""
    return PR.parse_bundle(_bundles(spark, sf_dir), "bundle", ["source", "chunk_no"])


_ASSIST = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"


@register("clean_response", f"""
SELECT conv_id, turn, regexp_replace(replace(text || chr(10) || {_q(X.END_MARKER)} || '  ', {_q(X.END_MARKER)}, ''),
       '^{X.STRIP_CLASS_SQL}+|{X.STRIP_CLASS_SQL}+$', '', 'g') AS cleaned FROM ({_ASSIST})""")
def q_clean_response(spark, sf_dir):
    """Assistant turns as raw answers (text, end marker, trailing blanks) cleaned: marker removed, stripped."""
    conv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    raw = F.concat(F.col("text"), F.lit("\n" + X.END_MARKER + "  "))
    return conv.select("conv_id", "turn", PR.clean_response(raw).alias("cleaned"))


_FLAG_RESP_SQL = (f"CASE WHEN {token_count_sql('text')} >= 10 THEN text || chr(10) || {_q(X.END_MARKER)} "
                  f"ELSE text END")


@register("response_flags", f"""
SELECT conv_id, turn, contains(r, {_q(X.END_MARKER)}) AS finished, {token_count_sql('r')} > 30 AS overflow
FROM (SELECT conv_id, turn, {_FLAG_RESP_SQL} AS r FROM ({_ASSIST}))""")
def q_response_flags(spark, sf_dir):
    """Finished / overflow flags of assistant answers (marker added to answers of 10+ tokens; budget 30)."""
    conv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    r = F.when(token_count("text") >= 10, F.concat(F.col("text"), F.lit("\n" + X.END_MARKER))).otherwise(F.col("text"))
    return conv.select("conv_id", "turn", *PR.response_flags(r, F.lit(30)))


@register("extract_rating", f"""
SELECT conv_id, turn, TRY_CAST(regexp_extract(r, {_q(X.RATING_PATTERN)}, 1) AS INTEGER) AS rating
FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant'
        THEN text || ' (RATING: ' || CAST({token_count_sql('text')} % 11 AS VARCHAR) || '/10)' ELSE text END AS r
      FROM conversations)""")
def q_extract_rating(spark, sf_dir):
    """Rating of each turn: assistant turns carry ``(RATING: tokens mod 11/10)``, other turns none."""
    conv = read_table(spark, sf_dir, "conversations")
    r = F.when(F.col("role") == "assistant",
               F.concat(F.col("text"), F.lit(" (RATING: "), (token_count("text") % 11).cast("string"),
                        F.lit("/10)"))).otherwise(F.col("text"))
    return conv.select("conv_id", "turn", PR.extract_rating(r).alias("rating"))


# ---------------------------------------------------------------- cache and inference
from ..operators import cache as C  # noqa: E402
from ..operators.infer import batch_infer  # noqa: E402
from .models import make_token_echo  # noqa: E402

# Fixed values of the derived cache table: base time (2024-01-01 00:00:00 UTC), seconds of age per character,
# model names. Timestamps are built from epoch seconds so the session time zone does not matter.
AS_OF = "2024-01-01 00:00:00"
AS_OF_EPOCH = 1704067200
AGE_PER_CHAR = 20
EMBED_MODE, EMBED_MODEL = "openai", "text-embedding-ada-002"

_FLAT_SQL = "replace(text, chr(10), ' ')"
_KEY_SQL = C.cache_key_sql(_q(EMBED_MODE), _q(EMBED_MODEL), _FLAT_SQL)
_CACHE_SQL = f"""
cache AS (SELECT {_KEY_SQL} AS cache_key, 'cached:' || CAST(doc_id AS VARCHAR) AS response,
                 TIMESTAMP '{AS_OF}' - to_seconds(n_chars * {AGE_PER_CHAR}) AS ts FROM documents),
latest AS (SELECT cache_key, response, ts FROM (
             SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, response DESC) AS rn FROM cache)
           WHERE rn = 1),
live AS (SELECT * FROM latest WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 86400 SECOND),
requests AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS req_id, {_KEY_SQL} AS cache_key, {_FLAT_SQL} AS input
             FROM documents
             UNION ALL
             SELECT 'b' || CAST(item_id AS VARCHAR), {_KEY_SQL}, {_FLAT_SQL} FROM benchmark)"""


def _as_of():
    return F.timestamp_seconds(F.lit(AS_OF_EPOCH))


def _flat_key():
    return C.cache_key(EMBED_MODE, EMBED_MODEL, flatten_newlines("text"))


def _cache_table(spark, sf_dir):
    """Cache derived from the documents: one entry per document, aged 20 s per character at ``AS_OF``."""
    d = _docs(spark, sf_dir)
    ts = F.timestamp_seconds(F.lit(AS_OF_EPOCH) - F.col("n_chars") * AGE_PER_CHAR)
    return d.select(_flat_key().alias("cache_key"),
                    F.concat(F.lit("cached:"), F.col("doc_id").cast("string")).alias("response"), ts.alias("ts"))


def _requests(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("req_id"), "text")
    b = read_table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("req_id"), "text")
    return d.unionByName(b).select("req_id", _flat_key().alias("cache_key"), flatten_newlines("text").alias("input"))


def _epoch(col):
    return F.unix_seconds(F.col(col))


@register("cache_latest", f"""
WITH {_CACHE_SQL.strip()}
SELECT cache_key, response, CAST(epoch(ts) AS BIGINT) AS ts_epoch FROM latest""")
def q_cache_latest(spark, sf_dir):
    """Newest entry per key of the cache table (append-only; latest wins)."""
    return C.latest(_cache_table(spark, sf_dir)).select("cache_key", "response", _epoch("ts").alias("ts_epoch"))


@register("cache_hits", f"""
WITH {_CACHE_SQL.strip()}
SELECT r.req_id, r.cache_key, l.response FROM requests r JOIN live l ON l.cache_key = r.cache_key""")
def q_cache_hits(spark, sf_dir):
    """Requests (documents and benchmark texts) answered from live entries (age <= 86,400 s at AS_OF)."""
    hit = C.hits(_requests(spark, sf_dir).select("req_id", "cache_key"), _cache_table(spark, sf_dir), _as_of())
    return hit.select("req_id", "cache_key", "response")


@register("cache_misses", f"""
WITH {_CACHE_SQL.strip()}
SELECT r.req_id, r.cache_key FROM requests r ANTI JOIN live l ON l.cache_key = r.cache_key""")
def q_cache_misses(spark, sf_dir):
    """Requests without a live entry: absent keys and expired entries."""
    return C.misses(_requests(spark, sf_dir).select("req_id", "cache_key"), _cache_table(spark, sf_dir), _as_of())


def _echo(df):
    return batch_infer(df, make_token_echo, key_cols=["cache_key"], prompt_col="input")


_FRESH_SQL = f"""
fresh AS (SELECT DISTINCT r.cache_key, CAST({token_count_sql('r.input')} AS VARCHAR) || ' tokens' AS response
          FROM requests r ANTI JOIN live l ON l.cache_key = r.cache_key)"""


@register("cache_upsert", f"""
WITH {_CACHE_SQL.strip()}, {_FRESH_SQL.strip()},
merged AS (SELECT cache_key, response, ts FROM cache
           UNION ALL SELECT cache_key, response, TIMESTAMP '{AS_OF}' FROM fresh)
SELECT cache_key, response, CAST(epoch(ts) AS BIGINT) AS ts_epoch FROM (
  SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, response DESC) AS rn FROM merged) WHERE rn = 1""")
def q_cache_upsert(spark, sf_dir):
    """Cache after computing each distinct miss once (offline token-echo model) and appending it at AS_OF."""
    cache = _cache_table(spark, sf_dir)
    _answers, new = C.with_cache(_requests(spark, sf_dir), cache, _echo, _as_of())
    return C.latest(C.upsert(cache, new)).select("cache_key", "response", _epoch("ts").alias("ts_epoch"))


@register("infer_with_cache", f"""
WITH {_CACHE_SQL.strip()}, {_FRESH_SQL.strip()}
SELECT r.req_id, coalesce(l.response, f.response) AS response, l.response IS NOT NULL AS from_cache
FROM requests r LEFT JOIN live l ON l.cache_key = r.cache_key LEFT JOIN fresh f ON f.cache_key = r.cache_key""")
def q_infer_with_cache(spark, sf_dir):
    """Every request answered: from the cache when live, else by the model (each distinct miss once)."""
    answers, _new = C.with_cache(_requests(spark, sf_dir), _cache_table(spark, sf_dir), _echo, _as_of())
    return answers.select("req_id", "response", "from_cache")


@register("embed_with_cache", f"""
WITH {_CACHE_SQL.strip()},
v AS (SELECT r.req_id, l.cache_key IS NOT NULL AS from_cache, {hashed_vector_sql('r.input')} AS v
      FROM requests r LEFT JOIN live l ON l.cache_key = r.cache_key)
SELECT req_id, from_cache, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') AS counts
FROM v""")
def q_embed_with_cache(spark, sf_dir):
    """Vectors of documents and benchmark texts from a table of cached ones (entry ages as in the other cache queries);
    missing and expired texts are embedded once each and appended."""
    cache = VectorCache(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/vector-cache-{uuid.uuid4().hex}")
    old = _docs(spark, sf_dir).select(_flat_key().alias("cache_key"), "n_chars", flatten_newlines("text").alias("text"))
    ts = F.timestamp_seconds(F.lit(AS_OF_EPOCH) - F.col("n_chars") * AGE_PER_CHAR)
    cache.append(HashedEmbedder().embed(spread(old, "cache_key"), ["cache_key", "n_chars"]).select(
        "cache_key", "embedding", ts.alias("ts")))
    requests = _requests(spark, sf_dir).select("req_id", F.col("input").alias("text"))
    out = embed_with_cache(spread(requests, "req_id"), cache, HashedEmbedder(), _as_of(), key_cols=["req_id"],
                           mode=EMBED_MODE, model=EMBED_MODEL)
    return out.select("req_id", "from_cache", F.array_join(F.transform(
        "embedding", lambda x: x.cast("int").cast("string")), ",").alias("counts"))


@register("batch_infer", _prompt_sql("CAST(NULL AS VARCHAR)", False) + f"""
SELECT conv_id, turn, CAST({token_count_sql('prompt')} AS VARCHAR) || ' tokens' AS response,
       CAST(NULL AS VARCHAR) AS error FROM y""")
def q_batch_infer(spark, sf_dir):
    """Prompts of ``assemble_prompt`` through the (offline token-echo) model in slices of 16 per call."""
    prompts = QUERIES["assemble_prompt"](spark, sf_dir)
    return batch_infer(prompts, make_token_echo, key_cols=["conv_id", "turn"], batch_size=16)


# ---------------------------------------------------------------- diffs
from ..functions.lines import split_lines  # noqa: E402
from ..operators import diffs as D  # noqa: E402


def edit_pairs(spark, sf_dir, delete: bool = False) -> DataFrame:
    """Constructed edits of every document: old = its lines numbered ``i: line`` (so all lines differ), new =
    the same with a marker line ``@@ inserted j @@`` after every 7th line. ``delete`` swaps old and new."""
    d = spread(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    numbered_lines = F.transform(split_lines("text"), lambda x, i: F.concat(i.cast("string"), F.lit(": "), x))
    with_marks = F.flatten(F.transform(numbered_lines, lambda x, i: F.when(
        i % 7 == 6, F.array(x, F.concat(F.lit("@@ inserted "), F.floor(i / 7).cast("string"), F.lit(" @@"))))
        .otherwise(F.array(x))))
    old, new = F.array_join(numbered_lines, "\n"), F.array_join(with_marks, "\n")
    if delete:
        old, new = new, old
    return d.select(F.col("doc_id").alias("pair_id"), old.alias("old"), new.alias("new"))


_LINES_SQL = f"""
d AS (SELECT doc_id, source, {split_lines_sql('text')} AS lines FROM documents),
o AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS x FROM d),
marks AS (SELECT doc_id, i // 7 AS j FROM o WHERE i % 7 = 6)"""


def _diff_lines_sql(delete: bool) -> str:
    mop = "-" if delete else "+"
    return f"""
WITH {_LINES_SQL.strip()}
SELECT doc_id AS pair_id, CAST(i + i // 7 AS INTEGER) AS pos, ' ' AS op, CAST(i AS VARCHAR) || ': ' || x AS line FROM o
UNION ALL
SELECT doc_id, CAST(8 * j + 7 AS INTEGER), '{mop}', '@@ inserted ' || CAST(j AS VARCHAR) || ' @@' FROM marks"""


@register("diff_lines", _diff_lines_sql(False))
def q_diff_lines(spark, sf_dir):
    """Diff rows of the constructed insert-only edit of every document."""
    return D.diff_lines(edit_pairs(spark, sf_dir))


@register("diff_lines_delete", _diff_lines_sql(True))
def q_diff_lines_delete(spark, sf_dir):
    """Diff rows of the constructed delete-only edit (old and new swapped)."""
    return D.diff_lines(edit_pairs(spark, sf_dir, delete=True))


@register("diff_stats", f"""
WITH {_LINES_SQL.strip()}
SELECT doc_id AS pair_id, CAST(len(lines) // 7 AS INTEGER) AS added, 0 AS removed FROM d""")
def q_diff_stats(spark, sf_dir):
    """Lines added / removed per document edit."""
    return D.diff_stats(edit_pairs(spark, sf_dir))


@register("diff_stats_by_source", f"""
WITH {_LINES_SQL.strip()}
SELECT source, CAST(0 AS BIGINT) AS added, CAST(sum(len(lines) // 7) AS BIGINT) AS removed FROM d GROUP BY source""")
def q_diff_stats_by_source(spark, sf_dir):
    """Delete-only edits: lines added / removed summed per source."""
    st = D.diff_stats(edit_pairs(spark, sf_dir, delete=True))
    src = _docs(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), "source")
    return st.join(src, "pair_id").groupBy("source").agg(
        F.sum("added").cast("bigint").alias("added"), F.sum("removed").cast("bigint").alias("removed"))


@register("diff_numbered", f"""
WITH {_LINES_SQL.strip()}
SELECT doc_id AS pair_id, CAST(i + i // 7 AS INTEGER) AS pos, ' ' AS op, CAST(i + 1 AS INTEGER) AS new_line FROM o
UNION ALL
SELECT doc_id, CAST(8 * j + 7 AS INTEGER), '-', CAST(NULL AS INTEGER) FROM marks""")
def q_diff_numbered(spark, sf_dir):
    """New-side line numbers of the delete-only edits (removed lines have none)."""
    return D.numbered(D.diff_lines(edit_pairs(spark, sf_dir, delete=True))).select("pair_id", "pos", "op",
                                                                                   "new_line")


def _hunks_sql(c: int) -> str:
    if 8 > 2 * c:  # markers 8 rows apart: one hunk per marker
        body = f"""
SELECT m.doc_id AS pair_id, CAST(m.j AS INTEGER) AS hunk_no, CAST(greatest(8 * m.j + 7 - {c}, 0) AS INTEGER) AS start,
       CAST(least(8 * m.j + 7 + {c}, len(d.lines) + len(d.lines) // 7) AS INTEGER) AS "end"
FROM marks m JOIN d ON d.doc_id = m.doc_id"""
    else:  # all markers of a document in one hunk
        body = f"""
SELECT d.doc_id AS pair_id, 0 AS hunk_no, CAST(greatest(7 - {c}, 0) AS INTEGER) AS start,
       CAST(least(8 * (len(d.lines) // 7 - 1) + 7 + {c}, len(d.lines) + len(d.lines) // 7) AS INTEGER) AS "end"
FROM d WHERE len(d.lines) >= 7"""
    return f"""
WITH {_LINES_SQL.strip()}, h AS ({body})
SELECT pair_id, hunk_no, start, "end", CAST(start + 1 AS VARCHAR) || '-' || CAST("end" AS VARCHAR) AS title FROM h"""


@register("diff_hunks", _hunks_sql(3))
def q_diff_hunks(spark, sf_dir):
    """Context hunks (context 3) of the insert-only edits."""
    return D.hunks(D.diff_lines(edit_pairs(spark, sf_dir)), 3)


@register("diff_hunks_wide", _hunks_sql(4))
def q_diff_hunks_wide(spark, sf_dir):
    """Context 4: changes 8 rows apart now merge into one hunk per document."""
    return D.hunks(D.diff_lines(edit_pairs(spark, sf_dir)), 4)


@register("diff_hunk_lines", f"""
WITH rows AS ({_diff_lines_sql(False)}), hunk AS ({_hunks_sql(3)})
SELECT h.pair_id, h.hunk_no, r.pos, r.op, r.line,
       CAST(r.pos + 1 AS INTEGER) AS new_line
FROM hunk h JOIN rows r ON r.pair_id = h.pair_id AND r.pos >= h.start AND r.pos < h."end" """)
def q_diff_hunk_lines(spark, sf_dir):
    """The lines of each context hunk (context 3) of the insert-only edits, with new-side line numbers."""
    return D.hunk_lines(D.diff_lines(edit_pairs(spark, sf_dir)), 3)


# ---------------------------------------------------------------- pipelines
# The offline stand-in models are deterministic; where their answers follow in SQL the query has an oracle,
# which then checks the whole prompt → model → cleaning → parsing path (for commit summaries: packing, chunk
# texts, per-chunk calls and the combining call; for transforms an edit that only inserts).
from . import pipelines as PL  # noqa: E402
from ..operators.answer_log import AnswerLog  # noqa: E402
from .texts import BUILTIN_EXAMPLES  # noqa: E402
from .models import make_commit_model, make_create_model, make_marking_model, make_rating_model  # noqa: E402


@register("rate_messages", f"""
SELECT CAST(conv_id AS VARCHAR) || '#' || CAST(turn AS VARCHAR) AS msg_id,
       CAST({token_count_sql('text')} % 11 AS INTEGER) AS rating,
       'Rated by length. (RATING: ' || CAST({token_count_sql('text')} % 11 AS VARCHAR) || '/10)' AS comment,
       CAST(NULL AS VARCHAR) AS error
FROM conversations WHERE role = 'assistant'""")
def q_rate_messages(spark, sf_dir):
    """Rating of each assistant turn read as a commit message (offline rating model)."""
    conv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    msgs = conv.select(F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
                       .alias("msg_id"), F.col("text").alias("message"))
    return PL.rate_messages(msgs, make_rating_model)


def _refusing():
    def fn(prompts):
        raise AssertionError("asked again")
    return fn


@register("rate_messages_logged", ORACLE["rate_messages"])
def q_rate_messages_logged(spark, sf_dir):
    """As ``rate_messages``, from an answer log: a first run fills it, the second finds every answer there (its model would
    fail if it was asked)."""
    conv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    msgs = conv.select(F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
                       .alias("msg_id"), F.col("text").alias("message"))
    log = AnswerLog(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/answer-log-{uuid.uuid4().hex}", _as_of())
    PL.rate_messages(msgs, make_rating_model, log=log)
    return PL.rate_messages(msgs, _refusing, log=log, attempts=1)


def _example_prompts_sql() -> str:
    """Examples as plain text parts per set; the prompt is these, the headings and the text."""
    rows = []
    for name in PL.EXAMPLE_SETS:
        items = sorted((seq, c, r, a) for s, seq, c, r, a in BUILTIN_EXAMPLES if s == name)
        lines = []
        for _seq, context, request, response in items:
            lines += [X.CONTEXT_HEADING, context, *([] if request is None else [X.REQUEST_HEADING, request]),
                      X.RESPONSE_HEADING, X.START_MARKER, response, X.END_MARKER]
        ask = items[0][2]
        tail = [*([] if ask is None else [X.REQUEST_HEADING, ask]), X.RESPONSE_HEADING, X.START_MARKER]
        head = [DEFAULT_PRE_PROMPT, X.END_INSTRUCTION, *lines, X.CONTEXT_HEADING, ""]
        rows.append(f"({_q(name)}, {len(items)}, {_q(chr(10).join(head))}, {_q(chr(10).join(['', *tail]))})")
    return f"""
WITH s(example_set, n_examples, head, tail) AS (VALUES {', '.join(rows)}),
p AS (SELECT item_id, example_set, n_examples, head || text || tail AS prompt FROM benchmark, s)
SELECT item_id, example_set, CAST(n_examples AS INTEGER) AS n_examples, prompt,
       CAST({token_count_sql('prompt')} AS INTEGER) AS prompt_tokens FROM p"""


@register("example_prompts", _example_prompts_sql())
def q_example_prompts(spark, sf_dir):
    """Every benchmark text as a task behind each built-in example set (commit, rating, combine), with its tokens."""
    return PL.example_prompts(read_table(spark, sf_dir, "benchmark"), ["item_id"])


def _clip_head_sql(expr: str, n: int) -> str:
    toks = f"regexp_extract_all({expr}, '[^ \\t\\n\\r]+')"
    return f"(CASE WHEN len({toks}) > {n} THEN array_to_string({toks}[1:{n}], ' ') ELSE {expr} END)"


@register("summarize_changes", f"""
WITH pc AS ({_pack_changes_sql(1400, True)}),
chunks AS (
  SELECT pc.repo, pc.truncated, pc.chunk_no, pc.emit_seq,
         string_agg(CASE WHEN pc.truncated THEN {_clip_head_sql('d.text', 1400)} ELSE d.text END, chr(10)
                    ORDER BY pc.seq) AS diff
  FROM pc JOIN documents d ON d.source = pc.repo AND d.doc_id = pc.seq
  GROUP BY pc.repo, pc.truncated, pc.chunk_no, pc.emit_seq),
per AS (SELECT repo, count(*) AS n_chunks, any_value(diff) AS diff FROM chunks GROUP BY repo)
SELECT repo, n_chunks, 'Update ' || CAST(CASE WHEN n_chunks > 1 THEN n_chunks ELSE len({split_lines_sql('diff')}) END
       AS VARCHAR) || ' lines' AS message, CAST(NULL AS VARCHAR) AS error FROM per""")
def q_summarize_changes(spark, sf_dir):
    """Commit message per repo (source) for its staged changes, history examples from the same change table."""
    ch = changes_from_documents(_docs(spark, sf_dir))
    return PL.summarize_changes(ch, ch, make_commit_model, make_rating_model)


@register("transform_documents", f"""
SELECT {DOCUMENT_PATH_SQL} AS path, text || chr(10) || '@@ end @@' AS text, text AS original, CAST(1 AS INTEGER) AS added,
       CAST(0 AS INTEGER) AS removed, CAST(NULL AS VARCHAR) AS error FROM documents WHERE text <> ''""")
def q_transform_documents(spark, sf_dir):
    """All documents rewritten bundle by bundle (an offline model that adds a last line), with line counts against the
    originals."""
    return PL.transform_documents(non_empty(read_documents(spark, sf_dir)), "Add a last line.", make_marking_model)


@register("create_documents", f"""
SELECT item_id AS req_id, 0 AS file_pos, 'created/' || CAST({token_count_sql('text')} AS VARCHAR) || '.txt' AS path,
       text, CAST(NULL AS VARCHAR) AS error FROM benchmark""")
def q_create_documents(spark, sf_dir):
    """One request per benchmark text → files written by the (offline) model."""
    req = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("req_id"),
                                                        F.col("text").alias("request"))
    return PL.create_documents(req, make_create_model)


@register("originals_or_empty", f"""
WITH r AS (SELECT {DOCUMENT_PATH_SQL} AS path FROM documents
           UNION ALL SELECT 'created/' || CAST(item_id AS VARCHAR) || '.txt' FROM benchmark)
SELECT r.path, coalesce(d.text, '') AS original
FROM r LEFT JOIN (SELECT {DOCUMENT_PATH_SQL} AS path, text FROM documents) d ON d.path = r.path""")
def q_originals_or_empty(spark, sf_dir):
    """Result paths (every document, plus one new file per benchmark item) with their original text or ''."""
    docs = read_documents(spark, sf_dir)
    created = read_table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("created/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"))
    results = docs.select("path").unionByName(created)
    return PL.originals_or_empty(results, docs).select("path", "original")


@register("write_results", f"SELECT {DOCUMENT_PATH_SQL} AS path, text FROM documents")
def q_write_results(spark, sf_dir):
    """Files written as parquet under a fresh folder of the checkpoint location, then read back."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import write_results

    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/results-{uuid.uuid4().hex}"
    write_results(read_documents(spark, sf_dir).select("path", "text"), out, yes=True)
    return spark.read.parquet(out)


# ---------------------------------------------------------------- streaming
@register("stream_ingest", f"""
WITH f AS ({fragments_sql(20)})
SELECT doc_id, start_line, {hashed_vector_sql('contents')} AS embedding FROM f""")
def q_stream_ingest(spark, sf_dir):
    """The documents table, one file or a folder of them, ingested by the streaming source (available-now trigger) into a
    vectors table."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming.ingest import read_vectors, start_vector_ingest

    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/ingest-{uuid.uuid4().hex}"
    q = start_vector_ingest(spark, table_path(sf_dir, "documents"), base + "/vectors", base + "/stream-checkpoint", glob=None)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_vectors(spark, base + "/vectors")
