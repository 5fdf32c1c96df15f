"""Prompt assembly, bundle round trips, answer parsing, cache TTL boundary."""

import datetime as dt

from pyspark.sql import functions as F

from textlake.functions import fixed as X
from textlake.operators import cache as C
from textlake.operators import prompts as PR


PROMPT_CASES = [
    (("ctx one", None, []), """PRE
Once you're finished responding, write <| END OF RESPONSE |> on a line by itself.
## Context
ctx one
## Response
<| START OF RESPONSE |>"""),
    (("ctx three", "do it", [("c1", None, "r1"), ("c2", "q2", "r2")]), """PRE
Once you're finished responding, write <| END OF RESPONSE |> on a line by itself.
## Context@
c1
## Response@
<| START OF RESPONSE |>
r1
<| END OF RESPONSE |>
## Context@
c2
## Request@
q2
## Response@
<| START OF RESPONSE |>
r2
<| END OF RESPONSE |>
## Context
ctx three
## Request
do it
## Response
<| START OF RESPONSE |>"""),
    (("", None, [("", "", "")]), """PRE
Once you're finished responding, write <| END OF RESPONSE |> on a line by itself.
## Context@

## Request@

## Response@
<| START OF RESPONSE |>

<| END OF RESPONSE |>
## Context

## Response
<| START OF RESPONSE |>"""),
]


def test_assemble_prompt_cases(spark):
    """Whole prompts written out; ``@`` stands for the mark on example headings."""
    rows = [(i, c, r, [{"context": a, "request": b, "response": d} for a, b, d in ex])
            for i, ((c, r, ex), _) in enumerate(PROMPT_CASES)]
    df = spark.createDataFrame(rows, "id int, context string, request string, "
                                     "examples array<struct<context:string,request:string,response:string>>")
    for mark in (False, True):
        got = {r.id: r.p for r in df.select("id", PR.assemble_prompt("context", "request", F.lit("PRE"), "examples",
                                                                     mark_examples=mark).alias("p")).collect()}
        for i, (_, want) in enumerate(PROMPT_CASES):
            assert got[i] == want.replace("@", " (Example)" if mark else "")


def test_request_text(spark):
    df = spark.createDataFrame([(7, None), (10, "fix typo")], "q int, h string")
    got = [r.t for r in df.select(PR.request_text("q", "h").alias("t")).collect()]
    assert got == ["Write a commit message for the given diff (quality: 7/10)",
                   "Write a commit message for the given diff (quality: 10/10) (hint: fix typo)"]


BUNDLE_FILES = [("a/x.py", "print(1)\n```\nnot a fence end"), ("b.txt", ""), ("c.md", "```` four\n"),
                ("d.txt", "plain\ntext"), ("dir with blanks/e f.txt", "text")]


def test_bundle_round_trip(spark):
    df = spark.createDataFrame([(1, i, p, t) for i, (p, t) in enumerate(BUNDLE_FILES)],
                               "g int, o int, path string, text string")
    b = PR.render_bundles(df, ["g"], "o")
    back = [(r.path, r.text) for r in sorted(PR.parse_bundle(b, "bundle", ["g"]).collect(), key=lambda r: r.file_pos)]
    assert back == BUNDLE_FILES


def test_parse_same_line_fence_and_no_block(spark):
    text = "intro\n<!-- p/q.py -->```python\ndef f():\n    pass\n```\nno block here"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, md string")
    got = [(r.id, r.path, r.text) for r in PR.parse_bundle(df, "md", ["id"]).collect()]
    assert got == [(1, "p/q.py", "def f():\n    pass")]


def test_ratings_and_cleaning(spark):
    cases = ["(RATING: 0/10)", "ok (RATING: 7/10)", "(RATING: 10/10)", "no rating", "(RATING: 3/10) (RATING: 9/10)"]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, r string")
    got = [r.v for r in df.orderBy("id").select(PR.extract_rating("r").alias("v")).collect()]
    assert got == [0, 7, 10, None, 3]
    raw = f"\n  answer text \x0b\n{X.END_MARKER}\u2028 "
    df2 = spark.createDataFrame([(raw,)], "r string")
    row = df2.select(PR.clean_response("r").alias("c"), *PR.response_flags("r", F.lit(1))).collect()[0]
    assert row.c == raw.replace(X.END_MARKER, "").strip()
    assert row.finished and row.overflow


def test_prompt_budget(spark):
    df = spark.createDataFrame([("a b c", "gpt-3.5-turbo"), ("a " * 4000, "other")], "p string, m string")
    rows = df.select(*PR.prompt_budget(F.col("p"), F.col("m"))).collect()
    assert (rows[0].prompt_tokens, rows[0].output_budget, rows[0].fits) == (3, 7997, True)
    assert (rows[1].prompt_tokens, rows[1].output_budget, rows[1].fits) == (4000, 0, False)


def test_cache_ttl_boundary_and_latest(spark):
    as_of = dt.datetime(2024, 1, 1, 0, 0, 0)
    cache = spark.createDataFrame([
        ("exact", "v1", as_of - dt.timedelta(seconds=86400)),       # age exactly the TTL: live
        ("over", "v2", as_of - dt.timedelta(seconds=86401)),        # one second over: expired
        ("two", "old", as_of - dt.timedelta(seconds=100000)),       # two rows for a key: newest wins
        ("two", "new", as_of - dt.timedelta(seconds=10)),
        ("stale_newest", "x", as_of - dt.timedelta(seconds=90000)),
        ("stale_newest", "y", as_of - dt.timedelta(seconds=200000)),
    ], "cache_key string, response string, ts timestamp")
    req = spark.createDataFrame([(k,) for k in ["exact", "over", "two", "stale_newest", "absent"]], "cache_key string")
    hits = {r.cache_key: r.response for r in C.hits(req, cache, as_of).collect()}
    misses = {r.cache_key for r in C.misses(req, cache, as_of).collect()}
    assert hits == {"exact": "v1", "two": "new"}
    assert misses == {"over", "stale_newest", "absent"}

    calls = []

    def compute(df):
        calls.append(1)
        return df.select("cache_key", F.concat(F.lit("fresh:"), F.col("input")).alias("response"))

    req2 = req.withColumn("input", F.col("cache_key")).unionByName(
        spark.createDataFrame([("absent", "absent")], "cache_key string, input string"))
    answers, new = C.with_cache(req2, cache, compute, as_of)
    got = sorted((r.cache_key, r.response, r.from_cache) for r in answers.collect())
    assert ("absent", "fresh:absent", False) in got and ("two", "new", True) in got
    assert new.count() == 3  # one entry per distinct missing key
    after = C.live(C.upsert(cache, new), as_of)
    assert after.count() == 5
