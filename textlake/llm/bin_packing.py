"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised (end id appended); only those longer than ``capacity`` are cut, into pieces of ``capacity``
tokens whose last one may be shorter. A full piece is a sequence of its own. All shorter pieces are packed:

* Pieces are dealt by hash into bounded groups. Several islands evolve the same group from different seeds.
* An individual is a list of bins. It starts as best fit over a randomly perturbed order of falling sizes. Crossover
  injects whole well-filled bins of one parent into the other, removes the other's bins that hold any of the same
  pieces, and puts the pieces thereby displaced back by best fit. Fitness is the mean square of the fill.
* After an epoch each island's elite goes to the next island of its ring, and a second epoch starts with it.
* The best island's well-filled bins are final; where those hold less than half of a group's pieces, so are the fullest
  others up to half. Pieces of the worse bins of all groups are dealt again, level by level, until they are one group,
  so unfilled space does not add up over groups. Every level sends on at most half of what it got.

Group state travels as one row of bounded arrays per island. Piece lengths and row numbers are all that is shuffled.
Random numbers are seeded by level, group and island.

Nulls: a null text is empty and packs as the end id alone; a null doc_id is a row like others. Repeated rows are
separate documents. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import give_back, prepare, write_table
from textlake.llm.tokens import encoder as encoder_of

Bins = list[list[int]]


def best_fit(order: list[int], size: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """``bins`` plus every item of ``order``, each in the fullest bin that takes it, else in a new bin."""
    bins = [list(b) for b in bins] if bins else []
    free = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(free, (size[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > size[i]:
            insort(free, (room - size[i], k))
    return bins


def fitness(bins: Bins, size: list[int], capacity: int) -> float:
    """Mean square of the fill; higher for fewer, fuller bins."""
    return sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Child of ``a`` with a random half of the well-filled bins of ``b`` injected."""
    fill = [sum(size[i] for i in x) for x in b]
    well = sorted(range(len(b)), key=lambda k: (-fill[k], k))[:max(1, (len(b) + 1) // 2)]
    take = [b[k] for k, r in zip(well, rng.random(len(well)), strict=True) if r < 0.5] or [b[well[0]]]
    held = {i for x in take for i in x}
    kept, displaced = list(take), []
    for x in a:
        if held.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in held]
    displaced.sort(key=lambda i: (-size[i], i))
    return best_fit(displaced, size, capacity, kept)


def mutate(a: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """The worst-filled bins and a few random ones dissolved, their items put back by best fit."""
    rank = sorted(range(len(a)), key=lambda k: sum(size[i] for i in a[k]))
    out = set(rank[:max(1, len(a) // 50)]) | set(rng.integers(0, len(a), max(1, len(a) // 50)).tolist())
    loose = [i for k in out for i in a[k]]
    order = np.argsort(-np.array([size[i] for i in loose]) * (1 + 0.2 * rng.random(len(loose))), kind="stable")
    return best_fit([loose[k] for k in order], size, capacity, [b for k, b in enumerate(a) if k not in out])


def evolve(size: list[int], capacity: int, seed: int, elite: list[Bins], population: int = 4,
           generations: int = 8) -> Bins:
    """One island's epoch; stops early at the lower bound. Returns its elite."""
    rng, s = np.random.default_rng(seed), np.array(size, np.float64)
    least = -(-int(s.sum()) // capacity)
    people = [list(e) for e in elite]
    while len(people) < population:
        order = np.argsort(-s * (1 + (0.05 * len(people)) * rng.random(len(s))), kind="stable").tolist()
        people.append(best_fit(order, size, capacity))
        if len(people[-1]) <= least:
            break
    scored = sorted(((len(x), -fitness(x, size, capacity), k, x) for k, x in enumerate(people)))
    for g in range(generations):
        if scored[0][0] <= least or len(scored) < 2:
            break
        i, j = sorted(rng.choice(len(scored), 2, replace=False).tolist())
        child = mutate(crossover(scored[i][3], scored[j][3], size, capacity, rng), size, capacity, rng)
        scored = sorted([*scored, (len(child), -fitness(child, size, capacity), population + g, child)])[:population]
    return scored[0][3]


def _assignment(bins: Bins, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(assign: np.ndarray) -> Bins:
    out: Bins = [[] for _ in range(int(assign.max()) + 1)]
    for i, k in enumerate(assign.tolist()):
        out[k].append(i)
    return out


def _epoch(frames: Iterator[pd.DataFrame], capacity: int, level: int, epoch: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            size = [int(x) for x in r.sizes]
            elite = [_bins(np.asarray(e)) for e in (getattr(r, "own", None), getattr(r, "guest", None)) if e is not None]
            seed = zlib.crc32(f"{level}|{epoch}|{r.grp}|{r.island}".encode())
            bins = evolve(size, capacity, seed, elite)
            rows.append((r.grp, r.island, r.uids, r.sizes, _assignment(bins, len(size)), len(bins),
                         fitness(bins, size, capacity)))
        yield pd.DataFrame(rows, columns=["grp", "island", "uids", "sizes", "own", "n_bins", "fit"])


_STATE = "grp long, island int, uids array<long>, sizes array<int>, own array<int>, n_bins int, fit double"


def settled(fill: np.ndarray, count: np.ndarray, enough: float) -> np.ndarray:
    """Which bins are final: those filled enough, and the fullest ones until they hold half of the pieces."""
    order = np.argsort(-fill, kind="stable")
    held = np.cumsum(count[order]) - count[order]
    out = np.empty(len(fill), bool)
    out[order] = (fill[order] >= enough) | (2 * held < count.sum())
    return out


def _placed(frames: Iterator[pd.DataFrame], capacity: int, last: bool, well: float) -> Iterator[pd.DataFrame]:
    """Rows ``(uid, size, grp, bin, offset, final)``; pieces of bins that are not final are dealt again."""
    for f in frames:
        for r in f.itertuples(index=False):
            size, own, uids = np.asarray(r.sizes, np.int64), np.asarray(r.own), np.asarray(r.uids)
            order = np.argsort(own, kind="stable")
            ends = np.cumsum(size[order])
            first = np.r_[True, own[order][1:] != own[order][:-1]]
            offset = ends - size[order]
            offset = offset - np.maximum.accumulate(np.where(first, offset, 0))
            done = last | settled(np.bincount(own, weights=size), np.bincount(own), well * capacity)
            yield pd.DataFrame({"uid": uids[order], "size": size[order], "grp": r.grp, "bin": own[order].astype(np.int64),
                                "offset": offset, "final": done[own[order]]})


def pack(items: DataFrame, capacity: int = 4096, group: int = 2048, islands: int = 2,
         well_filled: float = 0.999) -> DataFrame:
    """``(uid, sequence_id, offset)`` for ``items (uid long unique, size int in 1..capacity)``."""
    todo, done, level = items.select("uid", "size"), [], 0
    while True:
        n = todo.count()
        groups = max(1, -(-n // group))
        last = groups == 1
        # a group's epoch is short work, so a task takes several
        tasks = -(-groups * islands // 16)
        rows = (todo.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)).alias("grp"))
                .agg(F.array_sort(F.collect_list(F.struct("size", "uid"))).alias("x"))
                .select("grp", F.col("x.uid").alias("uids"), F.col("x.size").alias("sizes")))
        held = write_table(rows, "pack_groups")
        spread = held.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).repartition(
            tasks, "grp", "island")
        state = write_table(spread.mapInPandas(lambda it, level=level: _epoch(it, capacity, level, 0), _STATE), "epoch")
        guest = state.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"),
                             F.col("own").alias("guest"))
        state = write_table(state.drop("n_bins", "fit").join(guest, ["grp", "island"]).repartition(
            tasks, "grp", "island").mapInPandas(
            lambda it, level=level: _epoch(it, capacity, level, 1), _STATE), "epoch")
        best = state.groupBy("grp").agg(F.min_by(F.struct("uids", "sizes", "own"), F.struct("n_bins", -F.col("fit"),
                                                                                             "island")).alias("b"))
        placed = write_table(best.select("grp", "b.uids", "b.sizes", "b.own").mapInPandas(
            lambda it, last=last: _placed(it, capacity, last, well_filled),
            "uid long, size int, grp long, bin long, offset long, final boolean"), "placed")
        done.append(placed.where("final").select(
            "uid", (F.lit((1 + level) << 56) + F.col("grp") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id"),
            "offset"))
        if last:
            break
        todo, level = placed.where("not final").select("uid", "size"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int, with_ids: bool
         ) -> Iterator[pa.RecordBatch]:
    give_back()  # what earlier tasks of this worker freed
    encoder, end = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        doc_ids, rows = batch.column(0).to_pylist(), []
        for doc_id, raw in zip(doc_ids, encoder.encode(batch.column(1)), strict=True):
            raw += end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                ids = raw[at:at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                         ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        give_back()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False,
                   group: int = 2048, islands: int = 2) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece of ``docs (doc_id, text)``.

    ``with_ids`` adds the piece's ids as little-endian unsigned 32-bit bytes.
    """
    prepare(docs.sparkSession)
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda it: _cut(it, tokenizer, end_id, capacity, with_ids),
        "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary")
    pieces = write_table((pieces if with_ids else pieces.drop("ids")).withColumn(
        "uid", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity).select("uid", F.col("length").alias("size"))
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn(
        "offset", F.lit(0).cast("long"))
    placed = pieces.join(pack(short, capacity, group, islands), "uid")
    return placed.unionByName(full).drop("uid")


def build_sequences(packed: DataFrame) -> DataFrame:
    """Real sequences ``(sequence_id, n_tokens, ids, doc_ids)`` from ``pack_documents(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"))
