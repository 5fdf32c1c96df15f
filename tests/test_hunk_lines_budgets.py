"""Lines of hunks against slices of the diff, one-pass counts, and model windows in the pipelines."""

import random

import pytest
from pyspark.sql import functions as F

from textlake.operators import diffs as D
from textlake.operators.prompts import parse_bundle, render_bundles
from textlake.plans import pipelines as PL
from textlake.plans.models import make_rating_model


def random_pairs(n, seed):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        old = [f"line {rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 60))]
        new = [x for x in old if rnd.random() > 0.06]
        for _ in range(rnd.randint(0, 3)):
            new.insert(rnd.randint(0, len(new)), f"added {rnd.randint(0, 99)}")
        out.append((k, "\n".join(old), "\n".join(new)))
    return [*out, (n, "same\ntext", "same\ntext"), (n + 1, "", ""), (n + 2, None, "x")]


@pytest.mark.parametrize("context", [0, 1, 3, 8, None])
def test_hunk_lines_are_slices_of_the_diff(spark, context):
    pairs = spark.createDataFrame(random_pairs(40, 5), "pair_id int, old string, new string")
    rows = D.diff_lines(pairs)
    diff, spans, lines = {}, {}, {}
    for r in D.numbered(rows).collect():
        diff.setdefault(r.pair_id, []).append((r.pos, r.op, r.line, r.new_line))
    for r in D.hunks(rows, context).collect():
        spans[r.pair_id, r.hunk_no] = (r.start, r.end)
    for r in D.hunk_lines(rows, context).collect():
        lines.setdefault((r.pair_id, r.hunk_no), []).append((r.pos, r.op, r.line, r.new_line))
    want = {k: sorted(diff[k[0]])[a:b] for k, (a, b) in spans.items() if b > a}
    assert {k: sorted(v) for k, v in lines.items()} == want
    if context is None:
        assert spans[40, 0] == (0, 2) and (41, 0) not in spans  # equal texts too; no rows, no hunk


def test_hunk_lines_compute_the_diff_once(spark):
    pairs = spark.createDataFrame(random_pairs(5, 6), "pair_id int, old string, new string")
    for out in (D.hunk_lines(D.diff_lines(pairs)), D.hunks(D.diff_lines(pairs)), D.diff_stats(pairs)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == 1 and "Join" not in plan


def test_bundles_round_trip(spark):
    texts = ["", "a", "a\n", "\n", "``` x\n```", "foo```\n````", "`````", "tail ```", "<!-- b -->\n```\ninner\n```", "a\n\n"]
    files = spark.createDataFrame([(1, k, f"dir {k}/f.txt", t) for k, t in enumerate(texts)],
                                  "b int, o int, path string, text string")
    got = parse_bundle(render_bundles(files, ["b"], "o"), "bundle").collect()
    assert [(r.path, r.text) for r in sorted(got, key=lambda r: r.file_pos)] == [
        (f"dir {k}/f.txt", t) for k, t in enumerate(texts)]


def test_prompts_beyond_the_window_are_not_sent(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        inner = make_rating_model()

        def fn(prompts):
            calls.add(len(prompts))
            return inner(prompts)

        return fn

    words = lambda n: " ".join(["word"] * n)
    msgs = spark.createDataFrame([(1, "short"), (2, words(5000)), (3, words(9000))], "msg_id int, message string")
    for model, sent, failed in (("gpt-3.5-turbo", 2, {3}), ("other", 1, {2, 3}), (None, 3, set())):
        before = calls.value
        got = {r.msg_id: r for r in PL.rate_messages(msgs, counting, model=model).collect()}
        assert calls.value - before == sent
        assert {k for k, r in got.items() if r.error and "too long" in r.error and r.rating is None} == failed
    got = PL.rate_messages(msgs.where("msg_id = 1"), make_rating_model, max_output_tokens=2).collect()[0]
    assert got.rating is None and got.error == "answer longer than 2 tokens"


def test_a_tokenizer_reaches_every_step(spark):
    class Characters:
        def count(self, text):
            return F.length(text if not isinstance(text, str) else F.col(text)).cast("int")

        def clip(self, text, n, keep="head"):
            return F.substring(text if not isinstance(text, str) else F.col(text), 1, n)

    msgs = spark.createDataFrame([(1, "x" * 50), (2, "x" * 5000)], "msg_id int, message string")
    got = {r.msg_id: r.error for r in PL.rate_messages(msgs, make_rating_model, model="other", tokenizer=Characters()).collect()}
    assert got[1] is None and "too long" in got[2]
