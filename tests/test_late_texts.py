"""Result rows fetch only the texts they show; plans that take files refuse to run on none."""

import pytest
from pyspark.sql import functions as F

from textlake.plans import pipelines as PL
from textlake.plans import search as S
from textlake.plans.models import make_marking_model


def test_report_splits_only_documents_in_the_result(spark):
    docs = spark.range(50).selectExpr("id doc_id", "'s' source", "concat('a', id, '\\nb', id, '\\nc', id) text")
    results = spark.createDataFrame([(1, 7, 2, 0.5, 1), (1, 7, 0, 0.4, 2), (2, 9, 0, 0.126, 1), (2, 99, 0, 0.1, 2)],
                                    "item_id int, doc_id long, start_line int, similarity double, rank int")
    out = S.search_report(docs, results, fragment_lines=2)
    assert [(r.item_id, r.path, r.start_line, r.header, r.similarity_2, r.contents) for r in out.collect()] == [
        (1, "s/7.txt", 0, "Result 2", 0.4, "a7\nb7"), (1, "s/7.txt", 2, "Result 1", 0.5, "c7"),
        (2, "s/9.txt", 0, "Result 1", 0.13, "a9\nb9")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftSemi")  # documents are cut down below the split
    assert plan.count("Range (0, 50") == 1


def test_no_file_is_an_error(spark):
    docs = spark.createDataFrame([(1, "s", "p", "")], "doc_id int, source string, path string, text string")
    queries = spark.createDataFrame([(1, "word")], "item_id int, text string")
    with pytest.raises(ValueError, match="no file"):
        S.semantic_search(docs, queries)
    with pytest.raises(ValueError, match="no file"):
        PL.transform_documents(docs.where(F.lit(False)), "Edit.", make_marking_model)


def test_every_example_set_stands_before_the_task(spark):
    out = PL.example_prompts(spark.createDataFrame([(1, "the task"), (2, None)], "id int, text string"), ["id"])
    rows = {(r.id, r.example_set): r for r in out.collect()}
    assert {s: rows[1, s].n_examples for s in PL.EXAMPLE_SETS} == {"commit": 2, "rating": 3, "combine": 1}
    for (key, _s), r in rows.items():
        assert r.prompt.count("## Response") == r.n_examples + 1 and ("the task" in r.prompt) == (key == 1)
