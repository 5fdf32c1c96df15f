"""Token ids of whole texts with a public tokenizer file, for use inside Arrow tasks.

Some tokenizer files cut a text at blanks before any merge, so the ids of a text are the ids of its blank-separated
pieces, joined. Which rule holds is read from the file (``piece_rule``):

* ``blank``: a blank belongs to the piece after it, and runs of white space are tokens. Pieces are cut before each blank.
  Where a piece ends with white space and the next one has nothing or white space after its blank, the run goes on
  across the cut: such a text is encoded whole.
* ``word``: white space is dropped and case is lowered, so line feeds count as blanks, pieces are what stands between,
  and ASCII capitals need no entries of their own.
* ``None``: any other file. Every text is encoded whole.

A batch's texts are split and numbered by Arrow; only its distinct pieces are looked up in the worker's table, and only
those not seen before are encoded, by the library. The ids of the texts are then gathered in numpy. Results are the
library's own in all cases.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: remembered pieces per worker before the table starts afresh, and how many of the first (the frequent) ones stay
PIECE_CACHE, PIECES_KEPT = 600_000, 200_000
#: characters of text that are worked on together
CHUNK = 4_000_000
_SPACE = r"[\s\u0085᠎​﻿]"
RUN_ACROSS = re.compile(rf"{_SPACE} (?:{_SPACE}|\Z)")
#: the white space characters of any of the rules, and the empty string
SPACES = frozenset([*(chr(c) for c in range(0x3001) if re.match(_SPACE, chr(c))), "\ufeff", ""])
RARE_EDGE = re.compile(rf"\A(?![ \n]){_SPACE}|(?![ \n]){_SPACE}\Z")
#: what a run across a cut holds where the only white space is blanks and line feeds
_HINTS = ("   ", "\n ", "  \n")

#: put between pieces of the word rule; a zero byte between blanks is a token of its own
MARK = " \0 "

# Fixed value: the split pattern of the public word-level tokenizer file; it never matches white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def piece_rule(path: str) -> str | None:
    """How the tokenizer file lets a text be cut; see the module text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
    if (model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or
            spec.get("post_processor") or spec.get("truncation") or spec.get("padding")):
        return None
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(_SPACE, t["content"])
           for t in spec.get("added_tokens", [])):
        return None

    def is_bytes(p: dict, own_split: bool) -> bool:
        return p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and p.get("use_regex", True) == own_split

    if norm is None and is_bytes(pre, True):
        return "blank"
    steps = (norm or {}).get("normalizers", [])
    parts = pre.get("pretokenizers", [])
    known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    if steps == known and len(parts) == 2 and is_bytes(parts[1], False) and parts[0] == {
            "type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}:
        return "word"
    return None


class Pieces(dict):
    """Numbers pieces as they come; ``new`` lists those not seen before."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Whole texts to ids. Use ``encoder(path)`` in tasks: one table per worker process serves all its tasks."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.rule = Tokenizer.from_file(path), piece_rule(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        #: ids that start with a blank (blank rule) or end a word (word rule)
        self.bounds, self.mark = np.zeros(1 + max(self.tok.get_vocab().values()), bool), None
        if self.rule == "blank":
            self.bounds[[n for t, n in self.tok.get_vocab().items() if t.startswith("\u0120")]] = True
        elif self.rule == "word":
            self.bounds[[n for t, n in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
            mark = self.tok.encode(MARK, add_special_tokens=False).ids
            self.rule, self.mark = ("word", mark[0]) if len(mark) == 1 else (None, None)
        self._reset()

    def _reset(self) -> None:
        old = getattr(self, "pieces", {})
        self.pieces = Pieces()
        self.pieces.update(islice(old.items(), PIECES_KEPT))
        kept = len(self.pieces)
        if not kept:
            self.ids, self.start, self.size, self.odd = (np.zeros(n, t) for n, t in (
                (1 << 16, np.uint32), (1 << 14, np.int32), (1 << 14, np.int32), (1 << 14, bool)))
        #: first free place of ``ids``
        self.end = int((self.start[:kept] + self.size[:kept]).max(initial=0))

    def _room(self, n_pieces: int, n_ids: int) -> None:
        def wider(a: np.ndarray, n: int) -> np.ndarray:
            if n <= len(a):
                return a
            out = np.zeros(max(n, 2 * len(a)), a.dtype)
            out[:len(a)] = a
            return out

        self.ids = wider(self.ids, n_ids)
        self.start, self.size, self.odd = (wider(a, n_pieces) for a in (self.start, self.size, self.odd))

    def _store(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> None:
        """Appends ``ids`` and notes where the pieces' ids lie in them: ``sizes`` ids after the first ``before``."""
        self._room(len(self.pieces), self.end + len(ids))
        self.ids[self.end:self.end + len(ids)] = ids
        self.start[numbers], self.size[numbers] = self.end + before, sizes
        self.end += len(ids)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encodes the new pieces and appends their ids to the table. Pieces that a blank cuts off from what stands before
        them, and that have no white space at their edges, stand in a row a few hundred at a time without any effect on
        each other."""
        new, self.pieces.new = self.pieces.new, []
        base = len(self.pieces) - len(new)
        blank = self.rule == "blank"
        if blank:
            apart = [k for k, p in enumerate(new) if p[:1] != " " or p[1:2] in SPACES or p[-1] in SPACES]
            self._room(len(self.pieces), self.end)
            # with rarer white space at an edge, a run might go on across a cut
            self.odd[base:base + len(new)] = False
            self.odd[[base + k for k in apart if RARE_EDGE.search(new[k][new[k][:1] == " ":])]] = True
        else:
            apart = [k for k, p in enumerate(new) if p[:1] in SPACES or p[-1] in SPACES or "\0" in p]
        joined = "\n".join(new)
        if any(t in joined for t in self.special):
            apart = sorted({*apart, *(k for k, p in enumerate(new) if any(t in p for t in self.special))})
        if apart:
            found = [np.array(e.ids, np.uint32) for e in
                     self.tok.encode_batch_fast([new[k] for k in apart], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._store(base + np.array(apart), np.concatenate(found), sizes, np.cumsum(sizes) - sizes)
        rest = np.setdiff1d(np.arange(len(new)), np.array(apart, np.int64), assume_unique=True)
        if blank:
            left = self._in_rows(new, base, rest, "", False)
        else:  # a piece of letters alone is one word nearly always: its last token says so
            simple = np.fromiter((new[k].isalpha() for k in rest.tolist()), bool, len(rest))
            left = self._in_rows(new, base, rest[simple], " ", False)
            left = self._in_rows(new, base, np.concatenate([left, rest[~simple]]), MARK, True)
        if len(left):
            raise ValueError("the tokenizer file does not keep pieces apart")

    def _in_rows(self, new: list[str], base: int, which: np.ndarray, gap: str, between: bool) -> np.ndarray:
        """Encodes pieces a few hundred in a row and cuts their ids apart: at tokens that start with a blank (no gap), end
        a word, or are the mark ``between`` pieces. Returns the pieces of rows that did not fall into as many parts."""
        left = [np.zeros(0, np.int64)]
        rows = [which[lo:lo + 300] for lo in range(0, len(which), 300)]
        texts = [gap.join([new[k] for k in r.tolist()]) for r in rows]
        for r, e in zip(rows, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            if between:
                cuts = np.flatnonzero(ids == self.mark)
                starts, ends = np.concatenate([[0], cuts + 1]), np.append(cuts, len(ids))
            elif gap:
                ends = np.flatnonzero(self.bounds[ids]) + 1
                starts = np.concatenate([[0], ends[:-1]])
            else:
                starts = np.flatnonzero(self.bounds[ids])
                ends = np.append(starts[1:], len(ids))
            if len(starts) == len(r) == len(ends) and ends[-1] == len(ids):
                self._store(base + r, ids, ends - starts, starts)
            else:
                left.append(r)
        return np.concatenate(left)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit bytes, one entry per text (null: no ids)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), CHUNK, side="right")))
            out += self._encode(texts.slice(lo, hi - lo))
            lo = hi
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        if self.rule is None:
            some = texts.to_pylist()
            found = iter(self.whole([t for t in some if t]))
            return [next(found) if t else b"" for t in some]
        if len(self.pieces) > PIECE_CACHE:
            self._reset()
        texts = pc.fill_null(texts, "")
        if self.rule == "word":  # the file lower-cases: ASCII letters may as well be lower-cased before the look-up
            texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        words = pc.split_pattern(texts, " ")
        at = words.offsets.to_numpy().astype(np.int64)
        flat = words.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at = at - at[0]
        code, names = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        if self.rule == "blank":
            # the first piece of a text has no blank before it
            firsts, slot = np.unique(code[at[:-1]], return_inverse=True)
            code = code.copy()
            code[at[:-1]] = len(names) + slot
            names = [" " + w for w in names] + [names[k] for k in firsts.tolist()]
        number = np.fromiter(map(self.pieces.__getitem__, names), np.int64, len(names))
        if self.pieces.new:
            self._learn()
        size = self.size[number][code]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        place = np.repeat(self.start[number][code] - ends[:-1].astype(np.int32), size)
        place += np.arange(ends[-1], dtype=np.int32)
        ids = self.ids[place].astype("<u4", copy=False).tobytes()
        cuts = (4 * ends[at]).tolist()
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if self.rule == "blank":
            doubt = pc.ends_with(texts, "  ").to_numpy(zero_copy_only=False).copy()
            for hint in _HINTS:
                doubt |= pc.match_substring(texts, hint).to_numpy(zero_copy_only=False)
            if self.odd[number].any():
                doubt |= np.logical_or.reduceat(self.odd[number][code], at[:-1])
            again = [k for k in np.flatnonzero(doubt).tolist() if RUN_ACROSS.search(texts[k].as_py())]
            for k, ids in zip(again, self.whole([texts[k].as_py() for k in again]), strict=True):
                out[k] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; another file replaces it."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
