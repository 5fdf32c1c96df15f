"""Columns with the names that the operators use inside, and a host whose documents fail."""

from textlake.llm import mixing, quality

GOOD = " ".join(f"w{k}" for k in range(60))
NAMES = ["_w", "_l", "_h", "_d", "_b", "_s", "_r", "_p", "_host", "_failed", "host", "host_kept", "_t_w", "_t_host",
         "_uid", "_size", "_source", "s2", "s3", "uid", "h", "copies_", "N_Words"]


def rows(spark):
    data = [(k, GOOD if k % 3 else "short", "a" if k < 20 else None) for k in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    return df.selectExpr("*", *[f"concat('v', doc_id) AS `{n}`" for n in NAMES])


def test_judge_passes_extra_columns_untouched(spark):
    got = quality.judge(rows(spark)).collect()
    assert len(got) == 40 and {r.doc_id for r in got if r.kept} == {k for k in range(40) if k % 3}
    assert all(r[n] == f"v{r.doc_id}" for r in got for n in NAMES if n != "N_Words")
    assert {r.n_words for r in got} == {1, 60}


def test_mix_passes_extra_columns_untouched(spark):
    docs = rows(spark)
    mixed = mixing.mix(docs, carry=docs.columns)
    got = mixed.collect()
    assert len(got) == 40 and all(r[n] == f"v{r.doc_id}" for r in got for n in NAMES)
    out = mixing.materialise(mixed)
    assert out.count() == sum(r.copies for r in got) and set(out.columns) == set(docs.columns)


def test_a_failing_host_takes_its_good_documents_along(spark):
    bad = "# | $ " * 20 + GOOD  # no base rule fails, the symbols do
    data = [(k, GOOD, "good") for k in range(200)] + [(1000 + k, bad, "bad") for k in range(60)]
    data += [(2000, GOOD, "bad"), (2001, bad, "good")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert not got[2000].base_failed and not got[2000].kept  # its host is rejected
    assert got[2001].kept and got[0].kept and not got[1000].base_failed and not got[1000].kept


def test_embedding_ids_that_stand_for_several_vectors(spark):
    from textlake.llm import embed_dedup

    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(7, a, 1), (7, b, 1), (2, near(a), 1), (9, near(b), 1), (7, c, 2), (1, c, 2), (5, a, 2)]
    got = embed_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [
        (1, 1, 1), (2, 1, 2), (5, 0, 5), (7, 1, 1), (7, 1, 2), (7, 1, 7), (9, 1, 7)]


def test_components_with_hubs_and_long_chains(spark, monkeypatch):
    import random

    from textlake.llm import common

    rnd = random.Random(9)
    star = [(5, 1000 + k) for k in range(900)] + [(1000 + k, 7000) for k in range(0, 900, 3)]  # two hubs share leaves
    chain = [(2000 + k, 2001 + k) for k in range(40)]
    loose = [(rnd.randrange(3000, 3400), rnd.randrange(3000, 3400)) for _ in range(250)]
    links = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in star + chain + loose] + [(1, 1), (None, 2)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in list(root)}
    got = common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
