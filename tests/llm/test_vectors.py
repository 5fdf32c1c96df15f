"""Whitening, vector codes and nearest neighbours against plain numpy or brute force, with odd and hostile rows."""

import hashlib
import math
import struct

import numpy as np
import pytest

from textlake.llm import neighbour_graph, registry, vector_codes, whitening
from textlake.llm.common import table

SF01, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, label int, part string, x int"
NAN, INF = float("nan"), float("inf")


def f32(v):
    return None if v is None else [None if c is None else struct.unpack("f", struct.pack("f", c))[0] for c in v]


def make(spark, rows):
    """Rows ``(vec_id, vector, label)``; two more columns carry names that the operators use inside."""
    return spark.createDataFrame([(i, f32(v), l, "p", 7) for i, v, l in rows], SCHEMA)


def usable(rows, dim):
    return [(i, f32(v), l) for i, v, l in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]


def odd_rows(rng, n=150, dim=32):
    rows = [(k, (rng.normal(0, 0.3, dim) * np.linspace(1, 0.2, dim)).tolist(), None if k % 7 == 0 else k % 4)
            for k in range(n)]
    rows += [(900, rows[3][1], 1), (3, rows[3][1], 1), (3, rows[5][1], 2), (None, rows[8][1], 2), (901, None, 1),
             (902, [], 1), (903, [0.1] * (dim - 1) + [None], 1), (904, [NAN] * dim, 1), (905, [INF] + [0.0] * (dim - 1), 1),
             (906, [0.5] * (dim + 1), 1), (907, [0.0] * dim, None)]
    rows += [(1000 + k, rows[4][1], 3) for k in range(80)]  # a group of copies
    return rows


# ------------------------------------------------------------------ whitening
def expected_whitening(rows, dim):
    good = usable(rows, dim)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = (np.array([[n * a - s for a, s in zip(r, sums)] for r in fit], np.float64)) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    dev = [(i, sum((n * a - s) ** 2 for a, s in zip(r, sums))) for (i, _, _), r in zip(good, x)]
    rows_y = np.array([[n * a - s for a, s in zip(r, sums)] for r in x], np.float64) / n
    return n, values[::-1], vectors[:, ::-1], dev, rows_y


def test_whitening_matches_numpy(spark):
    rows = odd_rows(np.random.default_rng(1))
    n, values, vectors, dev, y = expected_whitening(rows, 32)
    got = whitening.whiten(make(spark, rows)).collect()
    assert len(got) == 16 * len(dev) and {r.n for r in got} == {n}
    assert sorted({(r.vec_id, r.deviation) for r in got}, key=str) == sorted(set(dev), key=str)
    assert {type(r.component) for r in got} == {int} and {r.component for r in got} == set(range(1, 17))
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    for k in range(16):
        mine = [r for r in got if r.component == k + 1]
        assert mine[0].explained == pytest.approx(values[k] / values.sum(), rel=1e-10)
        want = y @ vectors[:, k] / np.sqrt(values[k])
        by_row = sorted(zip([str(i) for i, _ in dev], np.round(want, 7).tolist()))
        flip = sorted(zip([str(i) for i, _ in dev], np.round(-want, 7).tolist()))
        have = sorted((str(r.vec_id), round(r.whitened, 7)) for r in mine)
        near = lambda a, b: all(p == q and abs(u - w) < 1e-6 for (p, u), (q, w) in zip(a, b, strict=True))
        assert near(have, by_row) or near(have, flip)


def test_jacobi_decomposition_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    want = 10.0 ** -np.arange(9)
    values, directions = whitening.decompose((q * want) @ q.T, 1, 9)
    assert np.allclose(values, want, rtol=1e-6)
    assert np.allclose(directions.T @ directions, np.eye(9), atol=1e-9)
    low = rng.normal(size=(9, 3))  # rank 3
    values, directions = whitening.decompose(low @ low.T, 1, 9)
    assert len(values) == 3 and np.allclose((directions * values) @ directions.T, low @ low.T)


def test_whitening_edges(spark):
    assert whitening.whiten(make(spark, [])).count() == 0
    assert whitening.whiten(make(spark, [(1, None, 1), (2, [NAN], 1)])).count() == 0
    assert whitening.whiten(make(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).count() == 0  # rank 0
    got = whitening.whiten(make(spark, [(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in sorted(got)] == [(1, 1, 2, 64**2), (2, 1, 2, 64**2),
                                                                              (2, 1, 2, 64**2)]
    assert sorted(abs(r.whitened) for r in got) == pytest.approx([1.0, 1.0, 1.0]) and got[0].explained == pytest.approx(1.0)
    # entries near the end of 64 bits stay exact; beyond it a deviation is null and a row without an x is left out
    big = whitening.whiten(spark.createDataFrame([(1, [1e12, 1.0]), (2, [0.0, 3.0]), (3, [1e30, 0.0])],
                                                 "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in big} == {1, 2} and {r.deviation for r in big} == {None}


def test_whitening_moments_merge_as_one(spark):
    from textlake.llm.vectors import moments

    data = np.random.default_rng(3).normal(5, 2, (400, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in data], "v array<double>").repartition(40)
    n, mean, scatter = moments(df, lambda b: np.array(b.column(0).to_pylist()).reshape(-1, 3))
    assert n == 400 and np.allclose(mean, data.mean(axis=0))
    assert np.allclose(scatter, (data - data.mean(axis=0)).T @ (data - data.mean(axis=0)))


# ------------------------------------------------------------------ vector codes
def expected_codes(rows, dim, parts=16, entries=64, rounds=2):
    good = sorted(usable(rows, dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(256 * c) for c in v] + [0] * (-dim % parts) for _, v, _ in good]
    w = len(x[0]) // parts
    cut = [[r[p * w:(p + 1) * w] for p in range(parts)] for r in x]
    books = [[list(r[p]) for r in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[nearest(p, r[p])[1] for p in range(parts)] for r in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [r[p] for r, c in zip(cut, chosen) if c[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[nearest(p, r[p]) for p in range(parts)] for r in cut]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, l), e in zip(good, error):
        total[l] = total.get(l, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[l], sha)
                   for (i, _, l), f, e in zip(good, found, error)), key=str)


@pytest.mark.parametrize("dim", [32, 21])
def test_codes_match_brute_force(spark, dim):
    rows = odd_rows(np.random.default_rng(4), dim=dim)
    got = vector_codes.encode(make(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == expected_codes(rows, dim)


def test_equal_average_search_takes_the_lower_of_equal_entries():
    rng = np.random.default_rng(5)
    entries = rng.integers(-3, 4, (5, 40, 3))  # many equal entries, equal sums and equal distances
    x = rng.integers(-4, 5, (300, 5, 3))
    index, error = vector_codes.Codebooks(entries).nearest(x)
    d = ((x[:, :, None, :] - entries[None]) ** 2).sum(axis=3)
    assert (index == d.argmin(axis=2)).all() and (error == d.min(axis=2)).all()
    big = x.astype(object) * 10**12
    index_big, error_big = vector_codes.Codebooks(entries.astype(object) * 10**12).nearest(big)
    assert (index_big == index).all() and (error_big == error.astype(object) * 10**24).all()


def test_codes_edges(spark):
    assert vector_codes.encode(make(spark, [])).count() == 0
    assert vector_codes.encode(make(spark, [(1, None, 1)])).count() == 0
    one = vector_codes.encode(make(spark, [(5, [0.5] * 16, None), (5, [0.5] * 16, None)])).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(5, "00" * 16, 0, 0)] * 2
    # large components are coded in Python's integers; an error beyond 64 bits is null
    far = [(k, [1e9 * (1 + k % 3)] + [float(k)] * 15, k % 2) for k in range(70)] + [(99, [1e25] + [0.0] * 15, 0)]
    want = [(i, c, e if e < 1 << 63 else None, sha) for i, c, e, _, sha in expected_codes(far, 16, entries=4)]
    got = vector_codes.encode(make(spark, far), entries=4)
    assert sorted(map(tuple, got.select("vec_id", "code", "error", "codebooks_sha256").collect()), key=str) == want
    assert {e for _, _, e, _ in want} > {None}


# ------------------------------------------------------------------ nearest neighbours
def expected_neighbours(rows, dim, every=50, k=5):
    good = sorted({(i, tuple(v)) for i, v, _ in usable(rows, dim) if i is not None and any(v)})
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in good])
    out = []
    for j, (q, _) in enumerate(good):
        if q % every == 0:
            s = unit @ unit[j]
            best = sorted((-s[m], i) for m, (i, _) in enumerate(good) if i != q)[:k]
            out += [(q, i, -c) for c, i in best]
    return out


def recall(got, want, k=5):
    mine = {}
    for q, i, s in got:
        mine.setdefault(q, []).append((i, s))
    hit = total = 0
    worst = {}
    for q, _, s in want:
        worst[q] = min(worst.get(q, 2.0), s)
        total += 1
    for q, found in mine.items():
        hit += sum(s >= worst[q] - 1e-12 for _, s in found)  # any row as near as the k-th counts
    return hit / total


def test_neighbours_of_small_tables_are_exact(spark):
    rows = odd_rows(np.random.default_rng(6))
    want = expected_neighbours(rows, 32)
    got = neighbour_graph.search_all(make(spark, rows)).collect()
    assert [(r.query_id, r.rank) for r in sorted(got)][:5] == [(0, k) for k in range(1, 6)]
    assert len(got) == len(want) and recall([(r.query_id, r.vec_id, r.score) for r in got], want) == 1.0
    scores = {(q, i): s for q, i, s in want}
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in scores)
    # the copies of row 4 come in the order of their ids
    copies = [r.vec_id for r in sorted(got) if r.query_id == 1000]
    assert copies == [4, 1001, 1002, 1003, 1004]


def test_neighbour_edges(spark):
    assert neighbour_graph.search_all(make(spark, [])).count() == 0
    assert neighbour_graph.search_all(make(spark, [(0, [1.0, 2.0], 1)])).count() == 0
    few = neighbour_graph.search_all(make(spark, [(0, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [-1.0, 0.0], 1),
                                                  (9, [0.0, 0.0], 1), (10, [1.0], 1)])).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(few)] == [(0, 1, 7, 0.0), (0, 2, 8, -1.0)]


def test_every_node_is_reached():
    rng = np.random.default_rng(7)
    far = rng.normal(size=(6, 16)) * 3
    near = np.concatenate([c + 1e-5 * rng.normal(size=(300, 16)) for c in far])  # tight groups of near copies
    graph = neighbour_graph.Graph(neighbour_graph.unit_rows(near), degree=8, beam=16).build()
    reached = np.zeros(graph.n + 1, bool)
    reached[graph.n] = True
    graph.spread(reached, np.array([graph.start]))
    assert reached.all()


@pytest.mark.parametrize("shard_rows", [400, 16_384])
def test_neighbour_recall_on_given_vectors(spark, shard_rows):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF1, "embeddings").collect()]
    want = expected_neighbours(rows, 64)
    got = neighbour_graph.search_all(table(spark, SF1, "embeddings"), shard_rows=shard_rows).collect()
    assert len(got) == len(want)
    assert recall([(r.query_id, r.vec_id, r.score) for r in got], want) >= 0.9


def test_queries_are_registered(spark):
    names = {"op11_embedding_whitening", "op12_vector_codes", "op13_nearest_neighbours"}
    assert names <= set(registry.QUERIES)
    for name in sorted(names):
        assert registry.QUERIES[name](spark, SF01).count() > 0
