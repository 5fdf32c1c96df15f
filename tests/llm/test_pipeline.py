"""The pipeline's stages on the smallest tables, each against what its own input demands."""

import corpus_pipeline as P
from textlake.llm.common import table, write_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    sizes, after = [docs.count()], {}
    for name, stage in P.STAGES:
        out = write_table(stage(spark, docs, SF), "test_stage")
        if name != P.STAGES[-1][0]:
            assert out.columns == P.COLUMNS
            assert out.exceptAll(docs).count() == 0 or name == "mixing"
        after[name], docs = out, out
        sizes.append(out.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    clean = {i for i, t in labels.items() if t == 0}
    kept = {r.doc_id for r in after["toxicity"].select("doc_id").collect()}
    assert len(clean & kept) >= 0.95 * len(clean)
    copies = after["mixing"].groupBy("doc_id").count().collect()
    assert {r["count"] for r in copies} <= {1, 2}
    assert after["packing"].where("piece = 0").count() == after["mixing"].count()


def test_one_row_of_each_group_whatever_its_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (None, a), (2, b), (2, a + " more"), (None, c), (None, c), (3, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.keep_one_of_each(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (None, c), (3, ""), (3, None)], key=str)


def test_stages_delete_what_earlier_ones_wrote_for_themselves(spark):
    import os

    words = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"{words} {k % 4}", "en", "s", 1) for k in range(12)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    there = lambda p: os.path.exists(p.split(":", 1)[-1])
    judged = P.apply_quality_rules(spark, write_table(docs, "input"), SF)
    first = list(P._spent)
    assert first and all(there(p) for p in first)
    P.keep_one_of_each(spark, judged, SF).count()  # not written in between: what it reads has to stay
    assert judged.count() == 12 and any(there(p) for p in first)
    out = write_table(judged, "judged")
    mixed = write_table(P.mix_sources(spark, out, SF), "mixed")
    assert not any(there(p) for p in first) and out.count() == 12 and mixed.count() > 0
