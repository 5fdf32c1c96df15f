"""Line rule and token functions against Python's own behaviour."""

import random

import pytest
from pyspark.sql import functions as F

from textlake.functions.lines import line_count, split_lines
from textlake.functions.tokens import clip_tokens, token_count
from textlake.operators.fragments import combine_fragments, split_fragments, with_end_line

SEPS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
LINE_CASES = ["a\nb\n", "a\r\nb\rc", "\n", "\n\n", "x\r\n", "", "   ", "a\n\nb", "a\nb\n\n", "\r\n\r\n", "\r\r\n",
              "tail\x85", "one"] + [f"a{s}b{s}" for s in SEPS] + [f"a{s}{s}b" for s in SEPS]


def test_split_lines_cases(spark):
    df = spark.createDataFrame(list(enumerate(LINE_CASES)), "id int, text string")
    got = {r.id: list(r.lines) for r in df.select("id", split_lines("text").alias("lines")).collect()}
    for i, t in enumerate(LINE_CASES):
        assert got[i] == t.splitlines(), repr(t)


def test_split_lines_random(spark):
    rnd = random.Random(3)
    alphabet = ["a", "b", " ", "\t"] + SEPS
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (list(r.lines), r.n) for r in
           df.select("id", split_lines("text").alias("lines"), line_count("text").alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t.splitlines(), len(t.splitlines())), repr(t)


def test_fragments_cover_every_line_once(spark):
    """Fragments of a text, put together again, are its lines: cut at multiples of n, none empty, none lost."""
    rnd = random.Random(5)
    texts = LINE_CASES + ["\n".join(rnd.choice(["x", "", "y z"]) for _ in range(rnd.randint(0, 40)))
                          for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for n in (1, 3, 10):
        got = {}
        for r in with_end_line(split_fragments(df, n)).collect():
            assert r.start_line % n == 0 and r.contents != "" and r.end_line - r.start_line < n
            got.setdefault(r.doc_id, {})[r.start_line] = r.contents.split("\n")
        for i, t in enumerate(texts):
            lines = [""] * len(t.splitlines())
            for start, part in got.get(i, {}).items():
                lines[start:start + len(part)] = part
            assert lines == t.splitlines(), (n, repr(t))


def test_blank_pair_fragment_kept(spark):
    df = spark.createDataFrame([(1, "a\n\n\nb")], "doc_id int, text string")
    rows = sorted((r.start_line, r.contents) for r in split_fragments(df, 2).collect())
    assert rows == [(0, "a\n"), (2, "\nb")]
    df2 = spark.createDataFrame([(1, "\n\n")], "doc_id int, text string")
    assert [r.contents for r in split_fragments(df2, 2).collect()] == ["\n"]


def test_combine_fragments_round_trip(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x")], "doc_id int, text string")
    back = {r.doc_id: r.text for r in combine_fragments(split_fragments(df, 2), ["doc_id"], "\n").collect()}
    assert back == {1: "a\nb\nc\nd\ne", 2: "x"}
    raw = {r.doc_id: r.text for r in combine_fragments(split_fragments(df, 2), ["doc_id"], "").collect()}
    assert raw[1] == "a\nbc\nde"


@pytest.mark.parametrize("n", [0, 1, 3, 100])
def test_clip(spark, n):
    texts = ["", "one", "a b  c\td\ne", "  lead and trail  ", "x " * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", token_count("text").alias("k"), clip_tokens("text", n, "head").alias("h"),
                     clip_tokens("text", n, "tail").alias("t")).collect()
    for r in rows:
        toks = texts[r.id].split()
        assert r.k == len(toks)
        if len(toks) <= n:
            assert r.h == texts[r.id] and r.t == texts[r.id]
        else:
            assert r.h == " ".join(toks[:n])
            assert r.t == (" ".join(toks[len(toks) - n:]) if n else "")


def test_clip_rejects_bad_keep(spark):
    with pytest.raises(ValueError):
        clip_tokens(F.col("x"), 3, "left")
