"""Resumable calls: nothing answered is asked again, by a second attempt, a second run or another pipeline."""

import glob
import os
import sys
import tempfile
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textlake.operators.answer_log import AnswerLog, SliceStore, answer_slices
from textlake.plans import pipelines as PL
from textlake.plans.models import make_commit_model, make_create_model, make_marking_model, make_rating_model
from textlake.sources.changes import changes_from_documents
from textlake.sources.tables import read_documents, read_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests' modules
AS_OF = "2024-01-01 00:00:00"


def fresh_folder():
    return tempfile.mkdtemp(prefix="textlake-log-")


def noted(make_fn, folder):
    """``make_fn`` with a file left for every prompt sent."""
    def make():
        fn = make_fn()

        def call(prompts):
            for p in prompts:
                with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
                    f.write(p)
            return fn(prompts)

        return call

    return make


def sent(folder):
    return Counter(open(f).read() for f in glob.glob(f"{folder}/*"))


def echo():
    return lambda prompts: [f"re {p}" for p in prompts]


def test_an_attempt_that_dies_repeats_one_slice_at_most():
    store, keys = SliceStore(fresh_folder(), 5), [f"k{i:03}" for i in range(40)]
    asked = Counter()

    def fn(prompts):
        asked.update(prompts)
        return [p.upper() for p in prompts]

    rows = answer_slices(store, fn, keys, keys, 8, 4, 3, 0)
    for _ in range(21):  # dies in the third slice
        next(rows)
    rows.close()
    assert len(asked) == 24
    assert [k for k, _e in answer_slices(store, fn, keys, keys, 8, 4, 3, 0)] == keys
    assert asked == Counter(keys)
    assert store.find(store.name(keys[8:16])) == {k: k.upper() for k in keys[8:16]}


def test_a_failed_prompt_is_asked_again_its_neighbours_are_not():
    store, asked, bad = SliceStore(fresh_folder(), 5), Counter(), {"k3"}

    def fn(prompts):
        if bad & set(prompts):
            raise ValueError("no")
        asked.update(prompts)
        return list(prompts)

    keys = [f"k{i}" for i in range(6)]
    run = lambda: dict(answer_slices(store, fn, keys, keys, 6, 3, 2, 0))
    assert {k for k, e in run().items() if e} == {"k3"}
    bad.clear()
    assert not any(run().values()) and asked == Counter(keys)


def test_a_killed_job_goes_on_where_it_was(spark):
    folder, calls, flag = fresh_folder(), fresh_folder(), f"{fresh_folder()}/dead"

    def dying():
        inner = noted(echo, calls)()

        def fn(prompts):
            if len(os.listdir(calls)) >= 24 and not os.path.exists(flag):
                open(flag, "w").close()
                os._exit(9)  # the worker is gone, as with a lost executor
            return inner(prompts)

        return fn

    log = AnswerLog(spark, folder, AS_OF)
    prompts = spark.range(60).selectExpr("id", "concat('p', id % 50) prompt").unionByName(
        spark.sql("select 60L id, cast(null as string) prompt"))
    ask = lambda: log.answer(prompts, dying, key_cols=["id"], slice_rows=4, batch_size=4, num_partitions=1)
    with pytest.raises(Exception, match="(?i)python worker|crashed|EOF"):
        ask()
    assert sum(sent(calls).values()) == 24 and log.table().count() == 24
    got = {r.id: (r.response, r.error) for r in ask().collect()}
    assert got == {**{i: (f"re p{i % 50}", None) for i in range(60)}, 60: (None, None)}
    assert sent(calls) == Counter(f"p{i}" for i in range(50))  # equal prompts share a call, none is repeated
    log.compact()
    assert log.table().count() == 50 and ask().where("response is not null").count() == 60
    assert sum(sent(calls).values()) == 50
    # entries end: a day and a second later everything is asked anew; another model has entries of its own
    late = AnswerLog(spark, folder, "2024-01-02 00:00:01")
    late.answer(prompts, dying, key_cols=["id"])
    assert sum(sent(calls).values()) == 100
    late.answer(prompts, dying, key_cols=["id"], model="other")
    assert sum(sent(calls).values()) == 150


def test_errors_are_reported_and_not_kept(spark):
    log = AnswerLog(spark, fresh_folder(), AS_OF)
    prompts = spark.createDataFrame([(1, "good"), (2, "bad"), (2, "bad"), (3, "")], "id int, prompt string")

    def failing():
        def fn(texts):
            if "bad" in texts:
                raise ValueError("refused")
            return [t + "!" for t in texts]

        return fn

    rows = sorted((r.id, r.response, r.error) for r in log.answer(prompts, failing, key_cols=["id"], attempts=1).collect())
    assert [r[:2] for r in rows] == [(1, "good!"), (2, None), (2, None), (3, "!")]
    assert [bool(r[2]) for r in rows] == [False, True, True, False] and "refused" in rows[1][2]
    assert log.table().count() == 2
    assert log.answer(prompts.limit(0), failing, key_cols=["id"]).count() == 0


def test_second_runs_of_the_pipelines_make_no_call(spark):
    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    msgs = docs.selectExpr("doc_id msg_id", "text message")
    reqs = read_table(spark, sf, "benchmark").selectExpr("item_id req_id", "text request")
    ch = changes_from_documents(docs)
    files = read_documents(spark, sf).where(F.col("text") != "")
    runs = {
        "rate": lambda c, **kw: PL.rate_messages(msgs, noted(make_rating_model, c), **kw),
        "commit": lambda c, **kw: PL.summarize_changes(ch, ch, noted(make_commit_model, c), noted(make_rating_model, c), **kw),
        "transform": lambda c, **kw: PL.transform_documents(files, "Add a last line.", noted(make_marking_model, c), **kw),
        "create": lambda c, **kw: PL.create_documents(reqs, noted(make_create_model, c), **kw),
    }
    for name, work in runs.items():
        log, first, second, plain = AnswerLog(spark, fresh_folder(), AS_OF), *(fresh_folder() for _ in range(3))
        want = sorted(map(str, work(plain).collect()))
        assert sorted(map(str, work(first, log=log).collect())) == want, name
        assert sent(first) and max(sent(first).values()) == 1, name
        assert sorted(map(str, work(second, log=log).collect())) == want, name
        assert not sent(second), name
