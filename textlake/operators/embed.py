"""Embedders: a vector per text row.

The hosted embedding service of the original tool is replaced by a pluggable embedder. Two are provided:

* :class:`HashedEmbedder` (default, offline, deterministic): lower-cased tokens of the newline-flattened text are
  hashed into ``dims`` buckets (first 8 hex digits of the token's MD5, modulo ``dims``) and counted. It has an exact SQL
  twin, which is what lets search results be checked against DuckDB.
* :class:`PandasEmbedder`: any Python model ``list[str] -> list[list[float]]`` applied with ``mapInPandas`` in
  batches of at most ``batch_size`` texts, the model built once per task.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Iterator
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import flatten_newlines
from ..session import bound_batches, give_back

DEFAULT_DIMS = 64
TOKEN = re.compile(r"[^ \t\n\r]+")
#: tokens whose bucket a task remembers: the first it meets, which the frequent ones are among
MAX_BUCKETS = 100_000
# Fixed value: the longest wait between two attempts of an embedding call, in seconds.
MAX_WAIT_SECONDS = 10.0


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def token_bucket(token: Column, dims: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % F.lit(int(dims))).cast("int")


def _token_pieces(text: Column | str) -> Column:
    """Lower-cased pieces between runs of space, tab, newline and carriage return: the default tokenizer's
    tokens, plus possibly empty pieces at the ends (dropped by the callers)."""
    return F.split(F.lower(_c(text)), r"[ \t\n\r]+", -1)


class HashedEmbedder:
    def __init__(self, dims: int = DEFAULT_DIMS):
        self.dims = int(dims)

    def sparse(self, df: DataFrame, key_cols, text_col: str = "text") -> DataFrame:
        """``*keys, bucket, n``: one row per non-empty bucket. Partial aggregation runs before the shuffle, so
        at most ``dims`` rows per text cross the network."""
        toks = df.select(*key_cols, F.explode(_token_pieces(text_col)).alias("_tok")).filter(F.col("_tok") != "")
        return (
            toks.groupBy(*key_cols, token_bucket(F.col("_tok"), self.dims).alias("bucket"))
            .agg(F.count(F.lit(1)).cast("double").alias("n"))
        )

    def embed(self, df: DataFrame, key_cols, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        """Dense count vector ``ARRAY<DOUBLE>`` (length ``dims``) per row of ``df``, keyed by ``key_cols``.

        Each row is embedded where it lies (Arrow batches), so no vector is shuffled. Text is lower-cased in the JVM, as
        in the sparse form and its SQL twin. A text without tokens (or a null one) gets the zero vector. Batches are bounded
        by bytes and a task turns one text at a time into Python objects, so its memory does not grow with the table.
        """
        bound_batches(df.sparkSession)
        keys, dims = list(key_cols), self.dims
        src = df.select(*keys, F.lower(_c(text_col)).alias("_text"))
        schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys) + f", `{out_col}` array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            buckets = Buckets(dims)
            for batch in batches:
                counts = np.zeros((batch.num_rows, dims))
                for row, value in zip(counts, batch.column(len(keys)), strict=True):
                    text = value.as_py()
                    if text:
                        row += np.bincount([buckets[t] for t in TOKEN.findall(text)], minlength=dims)
                ends = pa.array(np.arange(0, counts.size + 1, dims, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(counts.ravel()))], [*keys, out_col])
            buckets.clear()
            give_back()

        return src.mapInArrow(run, schema)


class Buckets(dict):
    """Bucket of any token, by the first 8 hex digits of its MD5; those of the first ``most`` tokens met are remembered."""

    def __init__(self, dims: int, most: int = MAX_BUCKETS):
        super().__init__()
        self.dims, self.most = dims, most

    def __missing__(self, token: str) -> int:
        b = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dims
        if len(self) < self.most:
            self[token] = b
        return b


def _call_model(model, texts: list, attempts: int = 3, max_wait: float = MAX_WAIT_SECONDS, sleep=time.sleep) -> list:
    """One embedding call, repeated on failure or a wrong number of vectors after a random, growing wait; the last
    failure is raised."""
    for left in range(attempts - 1, -1, -1):
        try:
            out = list(model(texts))
            if len(out) != len(texts):
                raise ValueError(f"model returned {len(out)} vectors for {len(texts)} texts")
            return out
        except Exception:
            if not left:
                raise
            sleep(random.uniform(0, min(max_wait, 2 ** (attempts - 1 - left))))
    return []


class PandasEmbedder:
    """Embed with a user model: ``make_model()`` returns ``list[str] -> list[list[float]]``.

    Texts are newline-flattened first. Each task builds the model once and sends at most ``batch_size`` texts
    per call (the hosted service took 1 to 2,047 texts per call).
    """

    def __init__(self, make_model: Callable[[], Callable[[list], list]], batch_size: int = 2047):
        if not 0 < batch_size < 2048:
            raise ValueError("batch_size must be between 1 and 2047")
        self.make_model = make_model
        self.batch_size = batch_size

    def embed(self, df: DataFrame, key_cols, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        bound_batches(df.sparkSession)
        make, bs = self.make_model, self.batch_size
        src = df.select(*key_cols, flatten_newlines(text_col).alias("_text"))
        fields = [f for f in src.schema.fields if f.name != "_text"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out_col}` array<double>"

        def run(batches):
            model = make()
            for pdf in batches:
                texts = pdf["_text"].tolist()
                vecs = []
                for i in range(0, len(texts), bs):
                    vecs.extend(_call_model(model, texts[i:i + bs]))
                out = pdf.drop(columns=["_text"])
                out[out_col] = pd.Series(vecs, index=pdf.index, dtype=object)
                yield out
                give_back()

        return src.mapInPandas(run, schema)
