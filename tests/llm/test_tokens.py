"""The piecewise encoder against the library's own whole-text encoding, for every public file and odd white space."""

import json
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textlake.llm import tokens
from textlake.llm.common import table
from textlake.llm.records import default_tokenizer

ODD = [" ", "  ", "   ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　", "​", "﻿",
       "᠎", "a", "B", "é", "é", "́", "Σ", "ΑΣ", "İ", "1", "23", ".", "!!", "'s", "'",
       "日", "\U0001f642", "<|endoftext|>", "<|startoftext|>", "foo", "\x00", "ſ", "Ǆ", "_"]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def ids_of(raw):
    return [int.from_bytes(raw[k:k + 4], "little") for k in range(0, len(raw), 4)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_librarys_ids(spark, name):
    path, rng = default_tokenizer(name), random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    texts += ["", " ", "x" * 20_000, " ".join(f"w{k}" for k in range(30_000))]
    texts += [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    encoder = tokens.Encoder(path)
    want = library(path, texts)
    assert list(map(ids_of, encoder.encode(texts))) == want
    assert list(map(ids_of, encoder.encode(pa.array(texts)))) == want  # now all pieces are known
    assert encoder.encode([None, "a", None]) == [b"", encoder.encode(["a"])[0], b""]
    assert encoder.encode([]) == []


def test_table_starts_afresh_without_loss(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CACHE", 50)
    monkeypatch.setattr(tokens, "PIECES_KEPT", 20)
    path = default_tokenizer("byte_bpe_50k.json")
    encoder = tokens.Encoder(path)
    for k in range(8):
        texts = [f"common words and new{k}x{j} end\n" for j in range(40)]
        assert list(map(ids_of, encoder.encode(texts))) == library(path, texts)


def test_other_files_are_encoded_whole(tmp_path):
    path = default_tokenizer("byte_bpe_50k.json")
    assert tokens.piece_rule(path) == "blank" and tokens.piece_rule(default_tokenizer("word_bpe_49k.json")) == "word"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = str(tmp_path / "other.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = ["two words", "", " lead", "a  b\n c"]
    encoder = tokens.Encoder(other)
    assert encoder.rule is None
    assert list(map(ids_of, encoder.encode([*texts, None])))[:4] == library(other, texts)
