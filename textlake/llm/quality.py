"""Quality rules with host verdicts, in DataFrame functions only.

Per document, over the whole text: words ``[^\\x20\\x09-\\x0D]+``, their code points, symbol characters, repeated
lines, and words covered by a 3-word window that occurs twice or more. A document fails its base rules when it has
fewer than ``min_words`` words or more than ``max_repeat`` percent of repeated words.

Host level: a document also counts as a failure of its host when it breaks one of the softer rules (symbol share,
repeated-line share). Failures are summed per host. A beta prior is fitted to the hosts' rates by moments (mean and
variance weighted by documents, the binomial part of the variance taken off), and each host's rate is shrunk by it:
``(failures + alpha) / (documents + alpha + beta)``, so a host with few documents stays near the corpus rate. Hosts
whose shrunk rate is above ``max_host_rate`` are rejected with all their documents.

How repeats are found without exploding words: every window's 64-bit hash is packed with its position into one long
(as many position bits as the text needs), the longs are sorted in the row, and neighbours with equal hash parts are
confirmed on the full hash. Windows that repeat come out as positions, and the covered words are summed from the
gaps between them.

Nulls: a null text has no words (and fails its base rules). A null host is a host of its own. Empty tables give an
empty result. Extra columns pass through ``judge`` untouched; its own columns win over columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import WORD_GAP, free_prefix, write_table
from textlake.session import broadcast_if_small

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(p: Column) -> Column:
    """Words covered by 3-word windows at the ascending positions ``p`` (0-based, distinct)."""
    gaps = F.aggregate(F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
                                  F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))),
                                  lambda a, b: F.least(a - b, F.lit(3).cast("long"))),
                       F.lit(0).cast("long"), lambda acc, g: acc + g)
    return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(gaps + 3)


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the five base features, computed row by row over whole texts (no shuffle)."""
    docs = docs.drop(*[c for c in FEATURES if c != text])
    prefix = free_prefix(docs.columns)
    words_c, lines_c, hash_c, distinct_c, bits_c, sorted_c, repeat_c, place_c = (prefix + k for k in "wlhdbsrp")
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.select("*", F.filter(F.split(t, WORD_GAP), lambda w: w != "").alias(words_c),
                        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines_c),
                        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    n = F.size(words_c)
    second = first.select(
        *[c for c in first.columns if c not in (words_c, lines_c)],
        n.cast("long").alias("n_words"),
        F.aggregate(words_c, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        (F.size(lines_c) - F.size(F.array_distinct(lines_c))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice(words_c, 1, F.greatest(n - 2, F.lit(0))),
                    lambda w, i: F.xxhash64(w, F.element_at(words_c, i + 2), F.element_at(words_c, i + 3))).alias(hash_c))
    # window positions need this many low bits
    bits = F.length(F.bin(F.size(hash_c)))
    third = second.select("*", F.size(F.array_distinct(hash_c)).alias(distinct_c), bits.alias(bits_c))
    fourth = third.select("*", F.when(F.col(distinct_c) == F.size(hash_c), F.array().cast("array<bigint>")).otherwise(
        F.sort_array(F.transform(hash_c, lambda h, i: F.call_function("shiftleft", F.call_function(
            "shiftright", h, F.col(bits_c)), F.col(bits_c)).bitwiseOR(i.cast("long"))))).alias(sorted_c))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bits_c)) - 1

    def same(x: Column, y: Column) -> Column:
        at = lambda z: F.get(hash_c, z.bitwiseAND(mask).cast("int"))
        return (x.bitwiseOR(mask) == y.bitwiseOR(mask)) & (at(x) == at(y))

    fifth = fourth.select("*", F.filter(sorted_c, lambda x, i: F.coalesce(same(x, F.get(sorted_c, i + 1)), F.lit(False))
                                        | F.coalesce(same(x, F.get(sorted_c, i - 1)), F.lit(False))).alias(repeat_c))
    sixth = fifth.select("*", F.sort_array(F.transform(repeat_c, lambda x: x.bitwiseAND(mask))).alias(place_c))
    keep = [c for c in docs.columns if c.lower() not in FEATURES]
    return sixth.select(*keep, *FEATURES[:4], _covered(F.col(place_c)).alias("n_repeat_words"))


def host_verdicts(flags: DataFrame, max_host_rate: float = 0.5) -> DataFrame:
    """``(host, docs, failures, rate, host_kept)`` from ``flags (host, failed)``; one row per host."""
    hosts = flags.groupBy("host").agg(F.count(F.lit(1)).alias("docs"),
                                      F.sum(F.col("failed").cast("long")).alias("failures"))
    r = F.col("failures") / F.col("docs")
    # moments over hosts, weighted by documents; sums only, so they combine before any shuffle
    prior = hosts.agg(F.sum("docs").alias("n"), F.sum("failures").alias("f"), F.count(F.lit(1)).alias("k"),
                      F.sum(r * F.col("failures")).alias("sq"))
    m = F.col("f") / F.col("n")
    spread = F.greatest(F.col("sq") / F.col("n") - m * m - m * (1 - m) * F.col("k") / F.col("n"), F.lit(0.0))
    strength = F.when(m * (1 - m) == 0, F.lit(1.0)).otherwise(
        F.least(F.greatest(m * (1 - m) / F.greatest(spread, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1000.0)))
    prior = prior.select((m * strength).alias("alpha"), ((1 - m) * strength).alias("beta"))
    # prior is a single row by construction
    rated = hosts.join(F.broadcast(prior)).select(
        "host", "docs", "failures",
        ((F.col("failures") + F.col("alpha")) / (F.col("docs") + F.col("alpha") + F.col("beta"))).alias("rate"))
    return rated.withColumn("host_kept", F.col("rate") <= max_host_rate)


def judge(docs: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None,
          min_words: int = 50, max_repeat: int = 50, max_symbols: int = 10, max_dup_lines: int = 30,
          max_host_rate: float = 0.5) -> DataFrame:
    """``carry`` columns (default: all) plus features, ``base_failed`` and ``kept`` for every row of ``docs``.

    ``max_symbols``: symbols per 100 word characters; ``max_dup_lines``: repeated lines per 100 words. The features
    are written once, because the host verdicts and the result both read them.
    """
    made = (*FEATURES, "base_failed", "kept")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in made]
    host_c, failed_c, key_c, ok_c = (free_prefix(docs.columns) + k for k in ("host", "failed", "key", "ok"))
    base = text_features(docs.select(*{*carry, text}, F.col(host).alias(host_c)), text)
    base = base.withColumn("base_failed", (F.col("n_words") < min_words)
                           | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    soft = ((100 * F.col("n_symbols") > max_symbols * F.col("word_chars"))
            | (100 * F.col("n_dup_lines") > max_dup_lines * F.col("n_words")))
    kept_cols = [*dict.fromkeys(carry), *FEATURES, "base_failed"]
    base = write_table(base.withColumn(failed_c, F.col("base_failed") | soft).select(*kept_cols, host_c, failed_c),
                       "quality")
    verdicts = write_table(host_verdicts(base.select(F.col(host_c).alias("host"), F.col(failed_c).alias("failed")),
                                         max_host_rate).select(F.col("host").alias(key_c), F.col("host_kept").alias(ok_c)),
                           "verdicts")
    # a row a host: where a count proves the table small it goes to the documents, which then stay where they are
    joined = base.join(broadcast_if_small(verdicts), F.col(host_c).eqNullSafe(F.col(key_c)), "left")
    return joined.select(*kept_cols, (~F.col("base_failed") & F.col(ok_c)).alias("kept"))
