"""DuckDB twins of the column functions, used by the oracle SQL of the registered queries."""

from __future__ import annotations

from ..functions.lines import split_lines_sql
from ..functions.tokens import token_count_sql

__all__ = ["split_lines_sql", "token_count_sql", "hashed_vector_sql", "bucket_sql", "hashed_tokens_sql",
           "cosine_sql", "round6_sql"]


def hashed_tokens_sql(expr: str) -> str:
    return f"regexp_extract_all(lower(replace({expr}, chr(10), ' ')), '[^ \\t\\n\\r]+')"


def bucket_sql(tok: str, dims: int = 64) -> str:
    return f"(('0x' || substr(md5({tok}), 1, 8))::BIGINT % {int(dims)})"


def hashed_vector_sql(expr: str, dims: int = 64) -> str:
    bk = f"list_transform({hashed_tokens_sql(expr)}, lambda t: {bucket_sql('t', dims)})"
    return (f"list_transform(range({int(dims)}), lambda b: CAST(len(list_filter({bk}, lambda x: x = b)) "
            f"AS DOUBLE))")


def cosine_sql(a: str, b: str) -> str:
    sa, sb = f"list_dot_product({a}, {a})", f"list_dot_product({b}, {b})"
    return (f"(CASE WHEN {sa} = 0 OR {sb} = 0 THEN NULL "
            f"ELSE list_dot_product({a}, {b}) / (sqrt({sa}) * sqrt({sb})) END)")


def round6_sql(x: str) -> str:
    return f"round({x}, 6)"
