"""Token counting and clipping.

The tokenizer is pluggable. The default counts runs of characters other than space, tab, newline and carriage
return; it runs inside the JVM (whole-stage code generation) and has an exact DuckDB twin, so every budget
decision can be checked in SQL. An encoder-backed tokenizer can be passed wherever a tokenizer is accepted.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what one token is for the default tokenizer (a run of characters other than these four).
TOKEN_PATTERN = r"[^ \t\n\r]+"
TOKEN_SEPARATORS = r"[ \t\n\r]+"
TOKEN_PATTERN_SQL = r"[^ \t\n\r]+"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


class WhitespaceTokenizer:
    """Default tokenizer, JVM-side."""

    def tokens(self, text: Column | str) -> Column:
        """Non-empty pieces between separator runs: the matches of TOKEN_PATTERN, about twice as fast as
        extracting the matches with a regular expression."""
        return F.filter(F.split(_c(text), TOKEN_SEPARATORS, -1), lambda p: p != "")

    def count(self, text: Column | str) -> Column:
        return F.coalesce(F.size(self.tokens(text)), F.lit(0)).cast("int")

    def clip(self, text: Column | str, max_tokens: int | Column, keep: str = "head") -> Column:
        """Keep the first (``head``) or last (``tail``) ``max_tokens`` tokens; text that fits is unchanged.

        Clipped text has its tokens joined by single spaces.
        """
        t = _c(text)
        n = max_tokens if isinstance(max_tokens, Column) else F.lit(int(max_tokens))
        toks = self.tokens(t)
        size = F.size(toks)
        if keep == "head":
            part = F.slice(toks, F.lit(1), n)
        elif keep == "tail":
            part = F.slice(toks, F.greatest(size - n + 1, F.lit(1)), n)
        else:
            raise ValueError(f"keep must be 'head' or 'tail', not {keep!r}")
        return F.when(size > n, F.array_join(part, " ")).otherwise(t)


class EncoderTokenizer:
    """Tokenizer backed by a Python encoder ``str -> list[int]`` (for example a byte-pair encoding).

    Runs as Arrow-batched pandas UDFs; the encoder is built once per Python worker by ``make_encoder``.
    """

    def __init__(self, make_encoder: Callable[[], Callable[[str], list]], make_decoder=None):
        self.make_encoder = make_encoder
        self.make_decoder = make_decoder

    def count(self, text: Column | str) -> Column:
        make = self.make_encoder

        @F.pandas_udf("int")
        def _count(s: pd.Series) -> pd.Series:
            enc = make()
            return s.map(lambda x: 0 if x is None else len(enc(x))).astype("int32")

        return _count(_c(text))

    def clip(self, text: Column | str, max_tokens: int, keep: str = "head") -> Column:
        if self.make_decoder is None:
            raise ValueError("clipping needs a decoder")
        make, make_dec, n = self.make_encoder, self.make_decoder, int(max_tokens)
        if keep not in ("head", "tail"):
            raise ValueError(f"keep must be 'head' or 'tail', not {keep!r}")

        @F.pandas_udf("string")
        def _clip(s: pd.Series) -> pd.Series:
            enc, dec = make(), make_dec()

            def one(x):
                if x is None:
                    return None
                ids = enc(x)
                if len(ids) <= n:
                    return x
                return dec(ids[:n] if keep == "head" else ids[len(ids) - n:])

            return s.map(one)

        return _clip(_c(text))


DEFAULT_TOKENIZER = WhitespaceTokenizer()


def token_count(text: Column | str, tokenizer=None) -> Column:
    return (tokenizer or DEFAULT_TOKENIZER).count(text)


def clip_tokens(text: Column | str, max_tokens: int | Column, keep: str = "head", tokenizer=None) -> Column:
    return (tokenizer or DEFAULT_TOKENIZER).clip(text, max_tokens, keep)


def token_count_sql(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '{TOKEN_PATTERN_SQL}'))"
