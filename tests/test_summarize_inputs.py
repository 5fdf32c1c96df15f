"""Commit messages over odd texts, and what the plan moves."""

import duckdb
from pyspark.sql import functions as F

from textlake.functions.lines import first_line
from textlake.plans import registry

from conftest import SF001
from test_lines_tokens import LINE_CASES


def test_first_line_is_the_first_of_split_lines(spark):
    df = spark.createDataFrame([*enumerate(LINE_CASES), (-1, None)], "id int, text string")
    got = {r.id: r.line for r in df.select("id", first_line("text").alias("line")).collect()}
    assert got == {-1: "", **{i: (t.splitlines() or [""])[0] for i, t in enumerate(LINE_CASES)}}


def test_summarize_with_empty_and_null_texts(spark, tmp_path):
    """A change without any line has the message ``""``; it does not end the job. Rows as the query's SQL gives them."""
    docs = registry.read_table(spark, SF001, "documents")
    first = docs.agg(F.max("doc_id")).first()[0] + 1
    odd = [("", "src0"), (None, "src0"), ("\r\n", "src1"), ("", "solo"), ("", "pair"), ("", "pair")]
    rows = [(first + i, text, "en", source, len(text or "")) for i, (text, source) in enumerate(odd)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["summarize_changes"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLE["summarize_changes"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 22


def test_summarize_moves_only_picked_history_and_chunk_texts(spark):
    """The plan that makes the messages scans the texts once, for the chunks: token counts and picks were written as narrow rows,
    and the few examples go to the chunks instead of the chunks to the examples."""
    plan = registry.QUERIES["summarize_changes"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "text#" in line]
    assert len(scans) == 1, plan
    by_repo = [line for line in plan.splitlines() if "Exchange hashpartitioning(repo#" in line and ", seq#" not in line
               and "chunk_no#" not in line]
    assert len(by_repo) == 1, plan  # the answers of a repo, for the combining call


def test_summarize_never_broadcasts_whole_texts(spark):
    """By the size of its files alone Spark would broadcast this table with its texts; a table of repeated texts is as small on
    disk however large it is in memory, and the driver cannot hold it."""
    df = registry.QUERIES["summarize_changes"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "FileScan parquet" in line and "text#" in line)
    depth = plan[at].index("FileScan")
    for line in reversed(plan[:at]):  # the operators on the way from the scan up
        here = len(line) - len(line.lstrip(" :+-"))
        if here < depth and line[:here].strip():
            depth = here
            assert not line[here:].startswith("BroadcastExchange"), line
