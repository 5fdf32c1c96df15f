"""Semantic search over a document table: split → embed → score → top-n per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.embed import HashedEmbedder
from ..operators.fragments import min_lines, split_fragments
from ..operators.search import similarity_statistics, top_n_search
from ..session import materialize, spread
from ..sources.tables import document_path, non_empty, require_files

FRAGMENT_KEYS = ("doc_id", "start_line")


def fragments(documents: DataFrame, fragment_lines: int = 20, min_fragment_lines: int = 0) -> DataFrame:
    files = non_empty(spread(documents.select("doc_id", "text"), "doc_id"))
    return min_lines(split_fragments(files, fragment_lines), min_fragment_lines)


def embedded_fragments(documents: DataFrame, fragment_lines: int = 20, min_fragment_lines: int = 0,
                       embedder=None) -> DataFrame:
    embedder = embedder or HashedEmbedder()
    frags = fragments(documents, fragment_lines, min_fragment_lines).select(*FRAGMENT_KEYS, "contents")
    return embedder.embed(frags, list(FRAGMENT_KEYS), "contents").select(*FRAGMENT_KEYS, "embedding")


def embedded_queries(queries: DataFrame, query_key: str = "item_id", text_col: str = "text",
                     embedder=None) -> DataFrame:
    embedder = embedder or HashedEmbedder()
    return embedder.embed(queries.select(query_key, text_col), [query_key], text_col).select(query_key, "embedding")


def semantic_search(documents: DataFrame, queries: DataFrame, *, query_key: str = "item_id",
                    query_text: str = "text", fragment_lines: int = 20, min_fragment_lines: int = 0,
                    top_n: int | None = 3, threshold: float = 0.0, embedder=None) -> DataFrame:
    """Top-n fragments per query: ``query_key, doc_id, start_line, similarity, rank``. No document with text is an error."""
    require_files(non_empty(documents.select("text")))
    frags = embedded_fragments(documents, fragment_lines, min_fragment_lines, embedder)
    q = embedded_queries(queries, query_key, query_text, embedder)
    # one vector per query row at most: the source row count (cheap on parquet) bounds the broadcast
    return top_n_search(frags, q, item_keys=FRAGMENT_KEYS, query_key=query_key, top_n=top_n, threshold=threshold,
                        query_row_bound=queries.count())


def search_report(documents: DataFrame, results: DataFrame, fragment_lines: int = 20,
                  order: str = "ascending") -> DataFrame:
    """Result rows as the command line printed them: header, similarity (2 places), path, first line, text.

    Texts come last: the ranked results (narrow, n rows per query) are written once, a semi-join keeps the documents that
    occur in them, and only these are split again. The documents are read once. No broadcast hint, since the number of
    queries is not bounded (AQE broadcasts the results' ids at run time when they are few).
    """
    results = materialize(results, "search-results")
    found = documents.select("doc_id", "text", document_path().alias("path")).join(
        results.select("doc_id"), "doc_id", "left_semi")
    frag_text = split_fragments(non_empty(spread(found, "doc_id")), fragment_lines, key_cols=("doc_id", "path"))
    out = frag_text.join(results, list(FRAGMENT_KEYS)).select(
        *[c for c in results.columns if c not in FRAGMENT_KEYS], "doc_id", "start_line",
        F.concat(F.lit("Result "), F.col("rank").cast("string")).alias("header"),
        F.round("similarity", 2).alias("similarity_2"), "path", "contents")
    # "ascending" lists the best result last, any other value lists it first
    first = [c for c in results.columns if c not in (*FRAGMENT_KEYS, "rank", "similarity")]
    return out.orderBy(*first, F.col("rank").desc() if order == "ascending" else F.col("rank").asc())


def search_statistics(documents: DataFrame, queries: DataFrame, *, query_key: str = "item_id",
                      query_text: str = "text", fragment_lines: int = 20, embedder=None) -> DataFrame:
    # every pass of the statistics reads the vectors: embed once, keep them in the checkpoint folder
    frags = materialize(embedded_fragments(documents, fragment_lines, 0, embedder), "embedded-fragments")
    q = embedded_queries(queries, query_key, query_text, embedder)
    return similarity_statistics(frags, q, item_keys=FRAGMENT_KEYS, query_key=query_key, query_row_bound=queries.count())
