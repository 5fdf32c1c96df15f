"""Compressed vector codes: one small codebook per part of the vectors, nearest entries by equal-average search.

* A component x becomes the integer ``floor(256 x)``. A vector is cut into ``parts`` equal consecutive parts, each coded
  by the number of the nearest entry of its position's codebook.
* Equal-average search: a codebook is sorted by the sum of its entries' components. By the Cauchy-Schwarz inequality
  the squared distance of a part and an entry is at least the squared gap of their sums over the part's length. The
  search starts at the part's own sum and expands outward, nearer sum first, until that bound strictly exceeds the best
  distance. Entries at the bound are still compared, so ties end at the lower index. A batch's parts advance together;
  finished ones leave.
* Training: entries start as the parts of the rows with the smallest ids, and each round replaces every used entry by
  the floor of the mean of its parts. Tasks send one sum per entry and component, whatever their rows.

All arithmetic is on integers, in Python's own where 64 bits might not do; an error beyond 64 bits is null.

Vectors that are null, empty, or hold a null or non-finite component are left out; so are vectors whose length is not
the table's commonest (ties: the shorter). A length that ``parts`` does not divide is filled up with zeros. Rows are
ordered by id (null last), then by vector: that settles which rows of a repeated id start the codebooks. With fewer than
``entries`` rows the codebooks are smaller. Null labels are one label. Extra columns are ignored. Empty tables give an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import prepare, write_table
from textlake.llm.vectors import matrix, plain, vector_length
from textlake.session import broadcast_if_small

SCALE = 256
#: components below this in size keep every sum of squares within 64 bits for parts of up to 2^15 components
_NARROW = 1 << 22


def integers(v: np.ndarray, parts: int) -> np.ndarray:
    """``(rows, parts, part length)`` integers of vectors; Python integers where a component is large."""
    z = np.floor(SCALE * v)
    if z.shape[1] % parts:
        z = np.concatenate([z, np.zeros((len(z), parts - z.shape[1] % parts))], axis=1)
    small = float(np.abs(z).max(initial=0.0)) < _NARROW
    z = z.astype(np.int64) if small else np.array([int(c) for c in z.reshape(-1)], object).reshape(z.shape)
    return z.reshape(len(z), parts, -1)


class Codebooks:
    """Entries of every part position, ``(parts, entries, part length)``, sorted by component sum for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries, (self.parts, self.size, self.dim) = entries, entries.shape
        sums = entries.sum(axis=2)
        self.order = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.order, axis=1)
        flat = np.take_along_axis(entries, self.order[:, :, None], axis=1)
        self.flat, self.flat_sums, self.flat_order = flat.reshape(-1, self.dim), self.sums.ravel(), self.order.ravel()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance, ``(rows, parts)`` each, of the nearest entries to the parts ``x``."""
        kind = object if object in (x.dtype, self.entries.dtype) else np.int64
        flat, sums, own = self.flat.astype(kind), self.flat_sums.astype(kind), x.sum(axis=2).astype(kind)
        first = np.arange(self.parts) * self.size
        right = np.stack([first[p] + np.searchsorted(self.sums[p].astype(kind), own[:, p])
                          for p in range(self.parts)], axis=1).ravel()
        index, error = np.zeros(right.size, np.int64), np.zeros(right.size, kind)
        floor = np.tile(first, len(x))
        x, own, at, left, top = x.reshape(-1, self.dim).astype(kind), own.ravel(), np.arange(right.size), right - 1, \
            floor + self.size
        best, found = np.full(right.size, -1).astype(kind), np.zeros(right.size, np.int64)
        while len(at):
            below, above = left >= floor, right < top
            gap_left = own - sums[np.where(below, left, floor)]
            gap_right = sums[np.where(above, right, floor)] - own
            down = below & (~above | (gap_left <= gap_right).astype(bool))
            gap = np.where(down, gap_left, gap_right)
            over = ~(below | above) | ((best >= 0) & (gap * gap > self.dim * best)).astype(bool)
            if over.any():
                index[at[over]], error[at[over]] = found[over], best[over]
                go = ~over
                x, own, at, left, right, floor, top, best, found, down = (
                    a[go] for a in (x, own, at, left, right, floor, top, best, found, down))
            pick = np.where(down, left, right)
            off = x - flat[pick]
            d, e = (off * off).sum(axis=1), self.flat_order[pick]
            better = ((best < 0) | (d < best) | ((d == best) & (e < found))).astype(bool)
            best, found = np.where(better, d, best), np.where(better, e, found)
            left, right = left - down, right + ~down
        return index.reshape(-1, self.parts), error.reshape(-1, self.parts)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for c in self.entries.ravel()).encode()).hexdigest()


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks, dim: int) -> Iterator[pa.RecordBatch]:
    """Per entry and component: how many parts chose the entry, and the sum of their components."""
    p, k, d = books.entries.shape
    count, total = np.zeros(p * k, np.int64), np.zeros((p * k, d), object)
    for batch in batches:
        _, v = matrix(batch.column(0), dim)
        if not len(v):
            continue
        x = integers(v, p)
        slot = (books.nearest(x)[0] + np.arange(p) * k).ravel()
        part = np.zeros((p * k, d), x.dtype)
        np.add.at(part, slot, x.reshape(-1, d))
        count += np.bincount(slot, minlength=p * k)
        total = total + part
    used = np.flatnonzero(count)
    if len(used):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, d)), pa.array(np.tile(np.arange(d), len(used))), pa.array(np.repeat(count[used], d)),
             pa.array([Decimal(int(s)) for s in total[used].ravel()], pa.decimal128(38, 0))], ["slot", "pos", "n", "s"])


def _first_entries(rows: DataFrame, dim: int, parts: int, entries: int) -> Codebooks:
    """Codebooks of the parts of the rows with the smallest ids; at most ``entries`` rows reach the driver."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, _ = matrix(batch.column(1), dim)
            yield batch.filter(pa.array(mask))

    first = rows.select("vec_id", "v").mapInArrow(keep, "vec_id long, v array<double>").orderBy(
        F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    return Codebooks(integers(np.array([r["v"] for r in first], np.float64), parts).transpose(1, 0, 2))


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[Codebooks, int] | None:
    """Codebooks and vector length; None without a usable vector."""
    prepare(vectors.sparkSession)
    rows = plain(vectors)
    dim = vector_length(rows)
    if dim is None:
        return None
    books = _first_entries(rows, dim, parts, entries)
    for _ in range(rounds):
        sums = (rows.select("v").mapInArrow(lambda it, books=books: _sums(it, books, dim),
                                            "slot long, pos long, n long, s decimal(38,0)")
                .groupBy("slot", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
        new = books.entries.astype(object).reshape(-1, books.dim)
        for r in sums:
            new[r["slot"], r["pos"]] = int(r["s"]) // int(r["n"])
        new = new.reshape(books.entries.shape)
        small = max((abs(int(c)) for c in new.ravel()), default=0) < _NARROW
        books = Codebooks(new.astype(np.int64) if small else new)
    return books, dim


def _codes(batches: Iterator[pa.RecordBatch], books: Codebooks, dim: int) -> Iterator[pa.RecordBatch]:
    hexes = np.array([f"{k:02x}" for k in range(books.size)], object)
    for batch in batches:
        mask, v = matrix(batch.column(1), dim)
        if not len(v):
            continue
        index, error = books.nearest(integers(v, books.parts))
        picked = batch.filter(pa.array(mask))
        whole = [int(e) for e in error.sum(axis=1)]
        yield pa.RecordBatch.from_arrays(
            [picked.column(0), pa.array(["".join(r) for r in hexes[index]], pa.string()),
             pa.array([e if e < 1 << 63 else None for e in whole], pa.int64()), picked.column(2)],
            ["vec_id", "code", "error", "label"])


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """``(vec_id, code, error, label, label_error, codebooks_sha256)`` per usable row of ``vectors (vec_id, embedding,
    label)``. ``label_error`` is the error summed over the rows of the label."""
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, code string, error long, label {label}"
    trained = train(vectors, parts, entries, rounds)
    if trained is None:
        return vectors.sparkSession.createDataFrame([], schema + ", label_error long, codebooks_sha256 string")
    books, dim = trained
    coded = write_table(plain(vectors, "label").mapInArrow(lambda it: _codes(it, books, dim), schema), "codes")
    # one row a label: sent to all tasks where a count proves it small, so a hot label's rows stay where they are
    sums = broadcast_if_small(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"]), "left").drop("of").withColumn(
        "codebooks_sha256", F.lit(books.digest()))
