"""Mixing sources to target weights by the cube method.

Targets: sources in code-point order (null last) get the weights, repeating; they share ``budget`` times all words.
No target is above ``max_copies`` times its source's words; what is cut off is shared again by weight until no source
is above. Each document of a source then has the same expected number of copies, target / source words: the whole
part is taken for certain, the fraction is its inclusion probability.

Long documents come first: those with ``1 / LONG`` or more of their source's words and four times its mean length
(fewer than ``LONG`` a source). They are settled one by one, longest first, each by a draw of its own; after each, the
source's other documents get the ratio that the words still wanted ask for, so many short ones make up for it. A
draw that would put this ratio below 0 or above ``max_copies`` gives way to the other choice if that one misses the
target by less; but for this, every document keeps its expected number of copies.

The cube method turns the fractions into 0 or 1. Within a block of documents of one source, the vector of
probabilities moves along the null space of the balancing constraints (document count, words), so both totals stay
exactly as expected, until a probability reaches 0 or 1; then the next document enters. A block ends with at most as
many undecided documents as there are constraints. These go on to the next level, in blocks again, until one block
of the source is left, whatever the other sources need; the first block of each earlier level sets a dozen documents
aside that go on undecided too. The last block's undecided documents, and a dozen set aside before that flight, are the
landing problem: of all 0/1 choices the one with the totals nearest to what was expected. Blocks are dealt by a hash of the document, so a hot source is many tasks, and random numbers
are seeded by source, level and block, so reruns agree.

Nulls: a null text has size 0 and takes nothing; a null source is a source of its own, sorted last; a null doc_id is
a row like others. Repeated rows are separate documents. Empty tables and tables without a word give empty results
or zero targets. Extra columns are carried by ``mix`` where asked for; its own columns win.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import free_prefix, prepare, write_table
from textlake.session import broadcast_if_small

EPS = 1e-9


def word_count(text: str = "text"):
    t = F.coalesce(F.col(text), F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5,
                   max_copies: float = 2.0) -> DataFrame:
    """``(source, source_size, n_docs, target)``, one row per source.

    The source table is one row per source (a grouped sum); only it is numbered in one task. Each round of resharing
    is one aggregate over it; the driver holds one number per round, and every round but the last fixes a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = write_table(per.select("*", w.alias("w"), (F.col("source_size") * max_copies).alias("most")), "sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0) * budget
    free, rate = F.lit(True), 0.0
    while True:
        got = per.agg(F.sum(F.when(free, F.col("w"))).alias("w"), F.sum(F.when(~free, F.col("most"))).alias("fixed"),
                      F.sum(F.when(~free, 1).otherwise(0)).alias("n")).first()
        if not got["w"]:
            break
        rate = (total - (got["fixed"] or 0.0)) / got["w"]
        free = F.col("w") * rate <= F.col("most")
        if per.where(~free).count() == got["n"]:
            break
    return per.select("source", "source_size", "n_docs",
                      F.least(F.col("w") * rate, F.col("most")).alias("target"))


def null_vector(a: np.ndarray) -> np.ndarray:
    """A vector of the null space of ``a`` (constraints x units, more units than constraints)."""
    if len(a) == 2 and a.shape[1] == 3:
        u = np.cross(a[0], a[1])
        if np.abs(u).max() > EPS:
            return u / np.abs(u).max()
    u = np.linalg.svd(a)[2][-1]
    return u / np.abs(u).max()


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: ``p`` moved within ``x.T @ p`` until at most ``x.shape[1]`` entries are strictly inside (0, 1)."""
    p, m = p.copy(), x.shape[1]
    scale = np.abs(x).max(axis=0)
    x = x / np.where(scale > 0, scale, 1)
    todo = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))][::-1]
    draws, d = rng.random(max(len(todo), 1)), 0
    active: list[int] = []
    while True:
        while len(active) <= m and todo:
            active.append(todo.pop())
        if len(active) <= m:
            return p
        u = null_vector(x[active].T)
        q = p[active]
        up, down = u > EPS, u < -EPS
        far = min(((1 - q[up]) / u[up]).min(initial=np.inf), (-q[down] / u[down]).min(initial=np.inf))
        back = min((q[up] / u[up]).min(initial=np.inf), ((q[down] - 1) / u[down]).min(initial=np.inf))
        q = q + far * u if draws[d % len(draws)] * (far + back) < back else q - back * u
        d += 1
        q[q < EPS] = 0.0
        q[q > 1 - EPS] = 1.0
        p[active] = q
        active = [i for i, v in zip(active, q.tolist(), strict=True) if 0 < v < 1]


#: documents set aside for the landing besides those the flight leaves undecided
RESERVE = 12
#: a document with this part of its source's words or more is settled before the flight
LONG = 64


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The undecided entries set to 0 or 1: of all choices the one whose totals are nearest to the expected ones.

    Misses are added up over the constraints in units of their mean, the last constraint (words) twenty times.
    """
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    out = p.copy()
    if len(left):
        choices = ((np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1).astype(np.float64)
        miss = np.abs(choices @ x[left] - p[left] @ x[left]) / np.maximum(np.abs(x).mean(axis=0), EPS)
        miss[:, -1] *= 20
        out[left] = choices[int(np.argmin(np.round(miss.sum(axis=1), 6)))]
    return np.rint(out)


def settle(size: np.ndarray, words: float, target: float, max_copies: float, rng: np.random.Generator) -> list[int]:
    """Copies of a source's long documents, in the order given; the rest of its ``words`` makes up for each."""
    out = []
    for n in size.tolist():
        ratio = target / words
        low = int(np.floor(ratio + EPS))
        pick = [low + 1, low] if rng.random() < ratio - low else [low, low + 1]
        words -= n
        miss = [max(c * n - target, target - c * n - max_copies * words, 0.0) for c in pick]
        # whole copies leave no choice
        c = pick[0] if miss[0] <= miss[1] + EPS * n or abs(ratio - low) <= EPS else pick[1]
        out.append(c)
        target = min(max(target - c * n, 0.0), max_copies * words)
    return out


def _settler(max_copies: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "uid"], ascending=[False, True, True], kind="stable")
        rng = np.random.default_rng(zlib.crc32(f"{pdf['source'].iloc[0]}|long".encode()))
        copies = settle(pdf["size"].to_numpy(np.float64), float(pdf["source_size"].iloc[0]),
                        float(pdf["target"].iloc[0]), max_copies, rng)
        return pdf[["uid", "size", "source"]].assign(copies=copies)

    return run


def _decide(pdf: pd.DataFrame, level: int, block: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "size", "uid"], kind="stable")
    p, x = pdf["p"].to_numpy(np.float64), np.stack([np.ones(len(pdf)), pdf["size"].to_numpy(np.float64)], axis=1)
    seed = zlib.crc32(f"{pdf['source'].iloc[0]}|{level}|{pdf['blk'].iloc[0]}".encode())
    rng = np.random.default_rng(seed)
    last = pdf["n"].iloc[0] <= block
    reserve = RESERVE if last else _reserve(block) if pdf["blk"].iloc[0] == 0 else 0
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    aside = open_[max(len(open_) - reserve, 0):]
    flown = p.copy()
    flown[aside] = 0.0
    flown = flight(flown, x, rng)
    flown[aside] = p[aside]
    return pdf.assign(p=landing(flown, x) if last else flown)


def _reserve(block: int) -> int:
    """Documents that a source's first block sets aside before its last level; few enough that levels shrink."""
    return min(RESERVE, block // 4)


def _decider(level: int, block: int):
    return lambda pdf: _decide(pdf, level, block)


def mix(docs: DataFrame, carry: Sequence[str] = ("doc_id",), weights: Sequence[float] = (3, 1, 2),
        budget: float = 1.5, max_copies: float = 2.0, block: int = 8192) -> DataFrame:
    """``carry`` columns plus ``size, source_size, target, copies`` for every row of ``docs (doc_id, text, source)``."""
    prepare(docs.sparkSession)
    carry = [c for c in carry if c.lower() not in ("size", "source_size", "target", "copies")]
    uid_c, size_c, hash_c, source_c, key_c = (free_prefix([*docs.columns]) + k for k in ("uid", "size", "h", "source", "key"))
    sized = write_table(docs.select(F.monotonically_increasing_id().alias(uid_c), word_count().alias(size_c),
                                    F.xxhash64("doc_id").alias(hash_c), F.col("source").alias(source_c), *carry), "sized")
    base = sized.select(F.col(uid_c).alias("uid"), F.col(size_c).alias("size"), F.col(hash_c).alias("h"),
                        F.col(source_c).alias("source"))
    targets = write_table(source_targets(base, weights, budget, max_copies), "targets")
    per = targets.select(F.col("source").alias("s2"), "source_size", "target", "n_docs")
    is_long = (F.col("size") * LONG >= F.col("source_size")) & (F.col("size") * F.col("n_docs") >= 4 * F.col("source_size"))
    # fewer than LONG rows a source
    settled = write_table(
        base.where("size > 0").join(per, base["source"].eqNullSafe(F.col("s2"))).where(is_long)
        .select("uid", "size", "h", "source", "source_size", "target").groupBy("source")
        .applyInPandas(_settler(max_copies), "uid long, size long, source string, copies int"), "settled")
    gone = settled.groupBy(F.col("source").alias("s3")).agg(
        F.sum("size").alias("gone"), F.sum(F.col("size") * F.col("copies")).alias("taken"))
    rest = F.col("source_size") - F.col("gone")
    per = per.join(gone, F.col("s2").eqNullSafe(F.col("s3")), "left").select(
        "s2", "n_docs", "source_size", F.when(F.col("gone").isNull(), F.when(
            F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).when(rest > 0, F.least(
                F.greatest((F.col("target") - F.col("taken")) / rest, F.lit(0.0)), F.lit(float(max_copies))))
        .otherwise(0.0).alias("ratio"))
    # rows that are alike in id, size and source are dealt by row number too, all others by their content alone
    alike = base.where("size > 0").groupBy("h", "size").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = base.where("size > 0").join(alike, ["h", "size"], "left").withColumn(
        "salt", F.when(F.col("c") > 1, F.col("uid")).otherwise(0)).drop("c")
    todo = rows.join(per, rows["source"].eqNullSafe(F.col("s2"))).where(~is_long).select(
        "uid", "size", "h", "source", "salt", F.floor("ratio").cast("int").alias("whole"),
        (F.col("ratio") - F.floor("ratio")).alias("p"), F.col("n_docs").alias("n"))
    schema = "uid long, size long, h long, source string, salt long, whole int, p double, n long, blk long"
    done, level = [settled.select("uid", "copies")], 0
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    while True:
        blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
        dealt = todo.withColumn("blk", F.pmod(F.xxhash64("h", "size", "salt", F.lit(level)), blocks))
        decided = write_table(dealt.groupBy("source", "blk").applyInPandas(_decider(level, block), schema),
                              f"flight{level}")
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(decided.where(~open_).select("uid", (F.col("whole") + F.rint("p").cast("int")).alias("copies")))
        if most <= block:
            break
        # at most two undecided documents a block and the reserve go on
        todo = decided.where(open_).withColumn(
            "n", 2 * F.ceil(F.col("n") / F.lit(block)).cast("long") + _reserve(block)).drop("blk")
        most, level = 2 * -(-most // block) + _reserve(block), level + 1
    copies = done[0]
    for more in done[1:]:
        copies = copies.unionByName(more)
    per = broadcast_if_small(targets.select(F.col("source").alias(key_c), "source_size", "target"))
    out = sized.join(copies.withColumnRenamed("uid", uid_c), uid_c, "left").join(
        per, F.col(source_c).eqNullSafe(F.col(key_c)), "left")
    return out.select(*carry, F.col(size_c).alias("size"), "source_size", "target",
                      F.coalesce("copies", F.lit(0)).alias("copies"))


def materialise(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: every row as often as its ``copies`` say."""
    one = free_prefix(mixed.columns)
    return (mixed.where("copies > 0").withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
            .drop(one, "copies", "size", "source_size", "target"))
