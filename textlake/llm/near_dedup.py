"""MinHash near-duplicate groups: one-permutation hashing, optimal densification, banded buckets, star candidates.

A document's set is its distinct ``shingle``-word windows (ASCII lower case, words ``[^\\x20\\x09-\\x0D]+``); a text
with fewer words has its whole sequence as one element. Two documents are linked when
``100 * |A & B| >= percent * |A | B|``; groups are the connected components of these links.

1. One Arrow pass hashes every text once: set size, a 128-bit order-free set key, and one band hash per band. The
   signature has ``bands * rows`` bins; one 64-bit hash per shingle picks its bin and competes there by value. An
   empty bin borrows from the first filled bin of its own fixed random order over all bins.
2. Equal sets collapse to their smallest doc_id, so a group of exact copies of any size is one row from here on.
3. Documents that share a band bucket are candidates. A bucket of g documents gives g - 1 pairs: each member with
   the bucket's centre, its smallest id. Every pair is confirmed on the full shingle sets.
4. Buckets that then still hold several groups draw four more centres each, by hash, so that a centre which is
   itself an outlier does not hide the links between its bucket's other members.
5. What is still open after that is settled exactly: members of buckets with several groups are compared across groups
   by a prefix filter (see ``_prefix_pairs``), so a star never costs a link that the buckets had found, and a large
   group of texts just below the threshold does not give all its pairs.

Nulls and empty texts: set size 0, linked with nothing. A null doc_id links with nothing and is its own (kept) row.
Repeated rows share a doc_id and so a group. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import connected_components, give_back, long_lists, mix64, prepare, write_table

#: distinct words whose hash a worker remembers before it starts afresh
WORD_CACHE = 400_000


class WordHashes(dict):
    """64-bit hashes of words, computed once per distinct word and forgotten when the table is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of one whole text."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    span = min(n, k)
    h = np.full(n - span + 1, span, np.uint64)
    for j in range(span):
        h = mix64(h * np.uint64(0xC2B2AE3D27D4EB4F) + w[j:n - span + 1 + j])
    return np.unique(h)


class Signer:
    """Band hashes of shingle sets: one permutation, ``bands * rows`` bins, optimal densification."""

    def __init__(self, bands: int, rows: int, tries: int = 6):
        self.bands, self.rows, self.bins, self.tries = bands, rows, bands * rows, tries
        rng = np.random.default_rng(20_24)
        self.order = np.stack([rng.permutation(self.bins) for _ in range(self.bins)]).astype(np.int32)
        self.odd = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def signature(self, s: np.ndarray) -> np.ndarray:
        sig, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        at = (s % np.uint64(self.bins)).astype(np.int64)[::-1]
        sig[at] = s[::-1]  # ascending values written backwards: the smallest of each bin stays
        full[at] = True
        empty = np.flatnonzero(~full)
        for t in range(self.tries):
            if not len(empty):
                return sig
            source = self.order[empty, t]
            hit = full[source]
            sig[empty[hit]] = sig[source[hit]]
            empty = empty[~hit]
        if len(empty):
            source = self.order[empty]
            sig[empty] = sig[source[np.arange(len(empty)), full[source].argmax(axis=1)]]
        return sig

    def bands_of(self, sigs: np.ndarray) -> np.ndarray:
        """(n, bins) signatures to (n, bands) bucket keys; the band's number is part of a key."""
        x = mix64(sigs.reshape(len(sigs), self.bands, self.rows) * self.odd)
        h = x.sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        return mix64(h).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    cache, signer = WordHashes(), Signer(bands, rows)
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [shingle_set(t, k, cache) for t in batch.column(1).to_pylist()]
            some = [s for s in sets if len(s)]
            keys = signer.bands_of(np.stack([signer.signature(s) for s in some])) if some else None
            empty, at, lists = np.zeros(0, np.int64), 0, []
            for s in sets:
                lists.append(keys[at] if len(s) else empty)
                at += bool(len(s))
            total = [int(s.sum(dtype=np.uint64)) for s in sets]
            mixed = [int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(np.array(total, np.uint64).view(np.int64)), pa.array(np.array(mixed, np.uint64).view(np.int64)),
                 long_lists(lists)], ["doc_id", "n_shingles", "k1", "k2", "bands"])
    del cache
    give_back()


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [shingle_set(t, k, cache).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), long_lists(sets)], ["id", "s"])
    del cache
    give_back()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets meet the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    near = pairs.join(left, "a").join(right, "b").where(100 * small >= percent * large)
    both = near.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"),
                       F.size(F.array_intersect("sa", "sb")).alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b").distinct()


def _open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``(key, id, g)``: members, with their group, of the buckets that hold several groups."""
    grouped = write_table(members.join(groups, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("g")), "grouped")
    mixed = grouped.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("key")
    return write_table(grouped.join(mixed, "key", "left_semi"), "open")


def _more_stars(mixed: DataFrame, stars: int = 4) -> DataFrame:
    """Pairs of members with centres of other groups; every bucket draws ``stars`` centres of its own by hash."""
    draws = [F.min(F.struct(F.xxhash64("id", "key", F.lit(k)).alias("h"), "id", "g")).alias(f"c{k}") for k in range(stars)]
    centres = mixed.groupBy("key").agg(*draws).select("key", F.explode(F.array(*[f"c{k}" for k in range(stars)]))
                                                      .alias("c")).select("key", "c.id", "c.g").distinct()
    centres = centres.select("key", F.col("id").alias("b"), F.col("g").alias("gb"))
    return (mixed.join(centres, "key").where("g <> gb")
            .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct())


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of different groups among ``members (id, g)`` that can still meet the threshold.

    Shingles are ordered by how many members hold them, rarest first. Two sets at the threshold share a shingle among
    the first ``n - ceil(percent n / 100) + 1`` of each, and after it enough are left on both sides to reach the
    overlap. So only pairs that share such a shingle come out: a member whose first shingles are all its own has none.
    """
    flat = members.join(sets, "id").select("id", "g", F.size("s").alias("n"), F.explode("s").alias("x"))
    flat = write_table(flat, "rest_shingles")
    df = flat.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "x"))
    first = (flat.join(df, "x").withColumn("i", place)
             .where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1).where("df > 1"))
    first = write_table(first.select("x", "id", "g", "n", "i"), "prefixes")
    mixed = first.groupBy("x").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("x")
    first = first.join(mixed, "x", "left_semi")
    other = first.select("x", *[F.col(c).alias(f"{c}2") for c in ("id", "g", "n", "i")])
    most = 1 + F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))
    return (first.join(other, "x").where((F.col("id") < F.col("id2")) & (F.col("g") != F.col("g2"))
                                         & ((100 + percent) * most >= percent * (F.col("n") + F.col("n2"))))
            .select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40,
                    rows: int = 6) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs (doc_id, text)``; see the module text."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = write_table(texts.mapInArrow(
        lambda it: _sign(it, shingle, bands, rows),
        "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "minhash")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    reps = write_table(known.groupBy("n_shingles", "k1", "k2")
                       .agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")), "reps")
    members = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
    centres = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("hi")
    shared = write_table(members.join(centres, "key"), "buckets")
    wanted = shared.select("id").distinct()
    sets = write_table(texts.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi").mapInArrow(
        lambda it: _sets(it, shingle), "id long, s array<long>").distinct(), "sets")

    first = shared.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    links = write_table(_confirm(first, sets, percent), "links")
    mixed = _open_members(shared.select("key", "id"), connected_components(links))
    links = write_table(links.unionByName(_confirm(_more_stars(mixed), sets, percent)), "links")
    groups = connected_components(links)
    mixed = _open_members(mixed.select("key", "id"), groups)
    rest = write_table(_confirm(_prefix_pairs(mixed.select("id", "g").distinct(), sets, percent), sets, percent), "rest")
    if rest.limit(1).count():
        groups = connected_components(links.unionByName(rest))
    groups = groups.withColumnRenamed("id", "rep")
    named = write_table(reps.drop("bands").join(groups, "rep", "left").select(
        "n_shingles", "k1", "k2", F.coalesce("component", "rep").alias("g")), "groups")
    out = signed.drop("bands").join(named, ["n_shingles", "k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("g", "doc_id"))
                      .alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
