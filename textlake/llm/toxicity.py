"""Toxicity scores from a bidirectional gated recurrent network over character and word inputs, in numpy.

* A text is cut into words (ASCII white space, ASCII lower case); words longer than 24 bytes become several pieces,
  so a text without blanks is still read in full. Bytes are the characters.
* Character side: a bidirectional GRU reads a word's characters; its two last states and a hashed word embedding are
  the word's input vector. It depends on the word alone, so a task computes it once per distinct word.
* Word side: a bidirectional GRU reads windows of ``WINDOW`` words, one every ``STRIDE`` words and one at the text's
  end; neighbours overlap by half, so every word lies in at least one window. Attention pools a window's states to one logit.
* A document's logit is its highest window's. Training sees the same: the window that scores highest stands for the
  document (multiple-instance learning), short toxic documents first, as their label has few windows to mean.
* A logistic calibration at the true class shares maps the highest logit and the logarithm of the number of windows to
  the score: a long document has more chances of a high window. More windows never raise a score.

Training takes a bounded sample of labelled rows: at most ``max_toxic`` and ``max_clean`` documents of any length in
the order of a hash of their id. It learns from all windows of a document that has at most ``max_windows``, and from so
many windows spread evenly over a longer one (cut in parallel tasks). One task trains on the sample in numpy; it holds
the sample as word numbers and one copy of each distinct word, and returns the network's parameters, all that the driver
sees. Its result depends on the sample alone, so a lost executor costs a repeat. The calibration scores every window of
the sampled documents, in tasks. Scoring covers every window of every text, in Arrow batches.

Nulls and empty texts score 0. Rows whose label is null or whose id is null are not learned from; an id labelled
twice counts as toxic if one label says so. Without any toxic or any clean label every score is the share of toxic
labels (0 without labels). Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.llm.common import give_back, prepare, write_table

WINDOW, STRIDE, PIECE = 48, 24, 24
CHAR_DIM, CHAR_H, WORD_DIM, WORD_H, BUCKETS = 8, 8, 8, 8, 1 << 14
#: distinct words whose input projections a worker remembers before it starts afresh
WORD_CACHE = 150_000


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def squash(x: np.ndarray) -> np.ndarray:
    """``x / (1 + |x|)`` in place: the network's activation, several times cheaper than tanh. Slope ``(1 - |y|)^2``."""
    d = np.abs(x)
    d += 1.0
    x /= d
    return x


def gate(x: np.ndarray) -> np.ndarray:
    """The activation moved to (0, 1), in place."""
    x = squash(x)
    x *= 0.5
    x += 0.5
    return x


Triple = tuple[np.ndarray, np.ndarray, np.ndarray]


def gru(u: Triple, w: np.ndarray, mask: np.ndarray | None = None, tape: list | None = None,
        states: bool = True) -> np.ndarray:
    """GRU over projected inputs, one (T, B, H) array each for update gate, reset gate and candidate.

    ``w`` is (3, H, H). Returns all states (T, B, H), or the last one only. Each gate has arrays of its own, so every
    operation runs over contiguous memory.
    """
    uz, ur, uc = u
    steps, n, hid = uz.shape
    h, out = np.zeros((n, hid), uz.dtype), np.empty((steps, n, hid), uz.dtype) if states else None
    for t in range(steps):
        z = h @ w[0]
        z += uz[t]
        z = gate(z)
        r = h @ w[1]
        r += ur[t]
        r = gate(r)
        gn = h @ w[2]
        c = r * gn
        c += uc[t]
        c = squash(c)
        new = h - c
        new *= z
        new += c
        if mask is not None:
            np.copyto(new, h, where=~mask[t][:, None])
        if tape is not None:
            tape.append((h, z, r, c, gn))
        h = new
        if states:
            out[t] = h
    return out if states else h


def gru_back(d: np.ndarray, w: np.ndarray, mask: np.ndarray, tape: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of ``gru`` for state gradients ``d`` (T, B, H): of the three inputs and of ``w``."""
    du, dw, carry = [np.zeros_like(d) for _ in range(3)], np.zeros_like(w), np.zeros_like(d[0])
    slope = lambda g: 0.5 * (1 - np.abs(2 * g - 1)) ** 2
    for t in range(len(d) - 1, -1, -1):
        h, z, r, c, gn = tape[t]
        dh = d[t] + carry
        m = mask[t][:, None]
        dm = dh * m
        dc = dm * (1 - z) * (1 - np.abs(c)) ** 2
        dz = dm * (h - c) * slope(z)
        dr = dc * gn * slope(r)
        du[0][t], du[1][t], du[2][t] = dz, dr, dc
        dn = dc * r
        for k, g in enumerate((dz, dr, dn)):
            dw[k] += h.T @ g
        carry = dh * ~m + dm * z + dz @ w[0].T + dr @ w[1].T + dn @ w[2].T
    return du, dw


def text_words(text: bytes | None) -> list[bytes]:
    words = text.lower().split() if text else []
    if words and max(map(len, words)) > PIECE:
        words = [w[k:k + PIECE] for w in words for k in range(0, len(w), PIECE)]
    return words


def window_starts(n: int) -> list[int]:
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def window_count(n: int) -> int:
    return 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STRIDE)


def spread_parts(text: bytes | None, most: int) -> list[bytes]:
    """The whole text where it has at most ``most`` windows, else so many of them, evenly spread."""
    words = text_words(text)
    starts = window_starts(len(words))
    if len(starts) <= most:
        return [b" ".join(words)]
    at = np.linspace(0, len(starts) - 1, most).round().astype(int).tolist()
    return [b" ".join(words[starts[k]:starts[k] + WINDOW]) for k in at]


class Net:
    """Parameters and the two halves of the network. ``float32`` throughout."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def init(*shape: int, scale: float | None = None) -> np.ndarray:
            return rng.normal(0, scale or 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        x = WORD_DIM + 2 * CHAR_H
        self.p = {"ce": init(256, CHAR_DIM, scale=0.5), "we": init(BUCKETS, WORD_DIM, scale=0.05),
                  "a": init(2 * WORD_H, 2 * WORD_H), "v": init(2 * WORD_H, 1), "o": init(2 * WORD_H, 1),
                  "b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"cx{side}": init(CHAR_DIM, 3 * CHAR_H), f"cb{side}": np.zeros(3 * CHAR_H, np.float32),
                       f"ch{side}": init(3, CHAR_H, CHAR_H, scale=CHAR_H**-0.5),
                       f"wx{side}": init(x, 3 * WORD_H), f"wb{side}": np.zeros(3 * WORD_H, np.float32),
                       f"wh{side}": init(3, WORD_H, WORD_H, scale=WORD_H**-0.5)}
        self.slope, self.bend, self.shift = 1.0, 0.0, 0.0

    # words -> vectors ----------------------------------------------------------------------------------------
    def chars(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max(initial=1))
        c = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
        return c, np.arange(width)[:, None] < size[None, :]

    def word_vectors(self, words: list[bytes], tape: dict | None = None) -> np.ndarray:
        c, mask = self.chars(words)
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS
        both = []
        for side in "fb":
            # the backward reader starts at a word's last character: masked steps come first and change nothing
            cs, ms = (c.T, mask) if side == "f" else (c.T[::-1], mask[::-1])
            gates = np.split(self.p["ce"] @ self.p[f"cx{side}"] + self.p[f"cb{side}"], 3, axis=1)
            notes: list | None = [] if tape is not None else None
            both.append(gru(tuple(np.ascontiguousarray(g)[cs] for g in gates), self.p[f"ch{side}"],
                            None if tape is None and mask.all() else ms, notes, states=False))
            if tape is not None:
                tape[side] = (cs, ms, notes)
        if tape is not None:
            tape["bucket"] = bucket
        return np.concatenate([self.p["we"][bucket], *both], axis=1)

    def project(self, words: list[bytes]) -> np.ndarray:
        """Inputs of the word-level GRUs, (6, n, H): computed once per distinct word. Words of like length together."""
        out = np.empty((6, len(words), WORD_H), np.float32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(size[order])) + 1).tolist(), len(words)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for lo in range(a, b, 4096):
                at = order[lo:min(lo + 4096, b)]
                out[:, at] = self.inputs(self.word_vectors([words[k] for k in at.tolist()]))
        return out

    def inputs(self, vec: np.ndarray) -> np.ndarray:
        """Word vectors to the (6, n, H) inputs of both word-level readers."""
        u = np.concatenate([vec @ self.p[f"wx{s}"] + self.p[f"wb{s}"] for s in "fb"], axis=1)
        return u.reshape(len(vec), 6, WORD_H).transpose(1, 0, 2)

    # windows -> logits ---------------------------------------------------------------------------------------
    def window_logits(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray | None,
                      tape: dict | None = None) -> np.ndarray:
        """``table`` (6, n, H) inputs per word, ``at`` (T, B) words of windows, ``mask`` (T, B), None for full ones."""
        f_notes, b_notes = ([], []) if tape is not None else (None, None)
        back = at[::-1]
        fw = gru(tuple(np.take(x, at, axis=0) for x in table[:3]), self.p["whf"], mask, f_notes)
        bw = gru(tuple(np.take(x, back, axis=0) for x in table[3:]), self.p["whb"],
                 None if mask is None else mask[::-1], b_notes)[::-1]
        s = np.concatenate([fw, bw], axis=2)
        k = squash((s.reshape(-1, 2 * WORD_H) @ self.p["a"]).reshape(s.shape))
        e = (k @ self.p["v"])[:, :, 0]
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        att = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", att, s)
        if tape is not None:
            tape |= {"f": f_notes, "b": b_notes, "s": s, "k": k, "att": att, "pooled": pooled}
        return (pooled @ self.p["o"])[:, 0] + self.p["b"][0]

    def score(self, best: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _sig(self.slope * best.astype(np.float64) + self.bend * np.log(count) + self.shift)


class Numbers(dict):
    """Numbers words as they come; ``new`` lists those not seen before."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def window_scores(net: Net, table: np.ndarray, rows: list[np.ndarray],
                  starts_of: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(logit, document number) of every window of every non-empty document; ``rows`` are its words' table rows.

    ``starts_of``: where the documents' windows start, if not where their lengths say.
    """
    full, whose, short = [], [], []
    for d, r in enumerate(rows):
        if len(r) >= WINDOW:
            starts = np.array(starts_of[d] if starts_of is not None else window_starts(len(r)))
            full.append(r[starts[:, None] + np.arange(WINDOW)])
            whose.append(np.full(len(starts), d))
        elif len(r):
            short.append((d, r))
    logits, owners = [], []
    if full:
        all_rows = np.concatenate(full)
        for lo in range(0, len(all_rows), 2048):
            logits.append(net.window_logits(table, np.ascontiguousarray(all_rows[lo:lo + 2048].T), None))
        owners += whose
    short.sort(key=lambda x: len(x[1]))
    for lo in range(0, len(short), 512):
        part = short[lo:lo + 512]
        width = len(part[-1][1])
        at, mask = np.zeros((width, len(part)), np.int32), np.zeros((width, len(part)), bool)
        for k, (_, r) in enumerate(part):
            at[:len(r), k], mask[:len(r), k] = r, True
        logits.append(net.window_logits(table, at, mask))
        owners.append(np.array([d for d, _ in part]))
    if not logits:
        return np.zeros(0, np.float32), np.zeros(0, np.int64)
    return np.concatenate(logits), np.concatenate(owners)


class Scorer:
    """Highest window logit of texts, with a per-word table of projected inputs."""

    def __init__(self, net: Net):
        self.net, self.row, self.table = net, Numbers(), np.empty((6, 4096, WORD_H), np.float32)

    def rows_of(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Table rows of the documents' words; words not seen before are projected first."""
        if len(self.row) > WORD_CACHE:
            self.row = Numbers()
        rows = [np.fromiter(map(self.row.__getitem__, d), np.int32, len(d)) for d in docs]
        if self.row.new:
            lo = len(self.row) - len(self.row.new)
            if len(self.row) > self.table.shape[1]:
                wide = np.empty((6, 5 * len(self.row) // 4, WORD_H), np.float32)
                wide[:, :lo] = self.table[:, :lo]
                self.table = wide
            self.table[:, lo:len(self.row)] = self.net.project(self.row.new)
            self.row.new = []
        return rows

    def best(self, docs: list[list[bytes]]) -> np.ndarray:
        """Highest logit per document; -inf without a word. Documents go in slices of bounded total length."""
        out, lo = np.full(len(docs), -np.inf), 0
        while lo < len(docs):
            hi, total = lo + 1, len(docs[lo])
            while hi < len(docs) and total + len(docs[hi]) <= 150_000:
                total += len(docs[hi])
                hi += 1
            rows = self.rows_of(docs[lo:hi])
            logit, whose = window_scores(self.net, self.table, rows)
            np.maximum.at(out, whose + lo, logit)
            lo = hi
        return out


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        cut = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * cut
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t))
                          / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def _sum_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by their number ``at``."""
    order = np.argsort(at, kind="stable")
    which, first = np.unique(at[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[which] = np.add.reduceat(rows[order], first, axis=0)
    return out


def gradients(net: Net, vocabulary: list[bytes], windows: list[np.ndarray], y: np.ndarray, weight: np.ndarray
              ) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss of windows (word numbers), through both levels of the network."""
    p = net.p
    used, row = np.unique(np.concatenate(windows), return_inverse=True)
    words, sizes = [vocabulary[k] for k in used.tolist()], [len(x) for x in windows]
    mask = np.arange(max(sizes))[:, None] < np.array(sizes)
    at = np.zeros((len(windows), max(sizes)), np.int64)
    at[mask.T] = row
    at = np.ascontiguousarray(at.T)
    low: dict = {}
    vec = net.word_vectors(words, low)
    t: dict = {}
    logit = net.window_logits(net.inputs(vec), at, mask, t)
    d = ((_sig(logit) - y) * weight).astype(np.float32)
    g = {"o": t["pooled"].T @ d[:, None], "b": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p["o"][:, 0]
    ds = t["att"][:, :, None] * dp[None]
    da = np.einsum("bh,tbh->tb", dp, t["s"])
    de = t["att"] * (da - (t["att"] * da).sum(axis=0))
    flat = t["k"].reshape(-1, 2 * WORD_H)
    g["v"] = flat.T @ de.reshape(-1, 1)
    dk = de[:, :, None] * p["v"][:, 0] * (1 - np.abs(t["k"])) ** 2
    g["a"] = t["s"].reshape(flat.shape).T @ dk.reshape(flat.shape)
    ds = ds + dk @ p["a"].T
    duf, g["whf"] = gru_back(ds[:, :, :WORD_H], p["whf"], mask, t["f"])
    dub, g["whb"] = gru_back(ds[::-1, :, WORD_H:], p["whb"], mask[::-1], t["b"])
    du = np.concatenate([*duf, *(x[::-1] for x in dub)], axis=2)[mask]
    dw = _sum_rows(at[mask], du, len(words))
    dvec = np.zeros_like(vec)
    for k, s in enumerate("fb"):
        part = dw[:, k * 3 * WORD_H:(k + 1) * 3 * WORD_H]
        g[f"wx{s}"], g[f"wb{s}"] = vec.T @ part, part.sum(axis=0)
        dvec += part @ p[f"wx{s}"].T
    g["we"] = np.zeros_like(p["we"])
    np.add.at(g["we"], low["bucket"], dvec[:, :WORD_DIM])
    g["ce"] = np.zeros_like(p["ce"])
    for k, s in enumerate("fb"):
        cs, ms, notes = low[s]
        dlast = np.zeros((len(cs), len(words), CHAR_H), np.float32)
        dlast[-1] = dvec[:, WORD_DIM + k * CHAR_H:WORD_DIM + (k + 1) * CHAR_H]
        duc, g[f"ch{s}"] = gru_back(dlast, p[f"ch{s}"], ms, notes)
        table = _sum_rows(cs[ms], np.concatenate(duc, axis=2)[ms], 256)
        g[f"cx{s}"], g[f"cb{s}"] = p["ce"].T @ table, table.sum(axis=0)
        g["ce"] += table @ p[f"cx{s}"].T
    return g


def calibrate(best: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic fit of labels on highest logits and log window counts, with a small ridge on both slopes.

    Newton steps. The slope of the count is never positive: if it were, the fit is on the logits alone.
    """
    x = np.stack([best, np.log(count), np.ones(len(best))], axis=1)
    ridge, middle = np.array([0.1, 1.0, 1e-6]), np.array([1.0, 0.0, 0.0])
    for use in (np.array([0, 1, 2]), np.array([0, 2])):
        b = middle.copy()
        for _ in range(30):
            q = _sig(x @ b)
            grad = x.T @ ((q - y) * weight) + ridge * (b - middle)
            hess = (x * (np.maximum(q * (1 - q), 1e-6) * weight)[:, None]).T @ x + np.diag(ridge)
            b[use] -= np.clip(np.linalg.solve(hess[np.ix_(use, use)], grad[use]), -1, 1)
        if b[1] <= 0:
            break
    return float(max(b[0], 0.05)), float(b[1]), float(b[2])


def fit(sample: Iterable[tuple[int, list[bytes]]], epochs: int = 7, batch: int = 64, rate: float = 0.01,
        seed: int = 7) -> Net:
    """Train on ``(0/1 label, parts)`` of documents (see ``spread_parts``), read once. Not calibrated."""
    rng, net = np.random.default_rng(seed), Net(seed)
    numbers, rows, spread, marks = Numbers(), [], [], []
    for label, parts in sample:
        row = np.fromiter((numbers[w] for part in parts for w in text_words(part)), np.int32)
        if len(row):
            rows.append(row)
            spread.append(len(parts) > 1)  # parts of a long document are one window each
            marks.append(label)
    y, vocabulary = np.array(marks, np.float64), list(numbers)
    del numbers
    # small samples get smaller batches and more epochs, so that the number of steps is about the same
    batch = min(batch, max(16, len(rows) // 12))
    epochs = max(epochs, min(40, -(-450 * batch // max(len(rows), 1))))
    adam = Adam(net.p, rate)
    starts = [list(range(0, len(r), WINDOW)) if s else window_starts(len(r)) for r, s in zip(rows, spread, strict=True)]
    few = np.array([len(s) for s in starts])
    for epoch in range(epochs):
        adam.rate = rate * (1.0 if epoch < epochs - 2 else 0.3 if epoch < epochs - 1 else 0.1)
        top, second = rng.integers(0, few), rng.integers(0, few)
        if epoch:
            logit, whose = window_scores(net, net.project(vocabulary), rows, starts)
            # windows of one document come in the order of their starts
            order = np.argsort(whose, kind="stable")
            edges = np.searchsorted(whose[order], np.arange(len(rows) + 1)).tolist()
            top = np.array([int(np.argmax(logit[order[a:b]])) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            peak = np.array([logit[order[a + k]] for a, k in zip(edges[:-1], top.tolist(), strict=True)])
        # toxic documents with many windows join once the network can tell which window is meant
        limit = 2 if epoch == 0 else 6 if epoch == 1 else 1 << 30
        fits = (y == 0) | (few <= limit)
        if epoch > 2:  # documents that are clearly right by now are visited now and then only
            sure = np.where(y == 1, peak > 4, peak < -4)
            fits &= ~sure | (rng.random(len(rows)) < 0.15)
        use = rng.permutation(np.flatnonzero(fits))
        share = max(1.0, (y[use] == 0).sum() / max((y[use] == 1).sum(), 1) / 2)
        for lo in range(0, len(use), batch):
            cut = [(rows[i][starts[i][k]:starts[i][k] + WINDOW], y[i]) for i in use[lo:lo + batch]
                   for k in ({int(top[i])} if y[i] else {int(top[i]), int(second[i])})]
            yy = np.array([c[1] for c in cut])
            weight = np.where(yy == 1, share, 1.0) / len(cut)
            adam.step(gradients(net, vocabulary, [c[0] for c in cut], yy, weight))
    return net


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [spread_parts(t, most) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.binary()))],
                                         ["doc_id", "y", "parts"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the trained network, from the rows of ``_cut`` in their order."""
    net = fit((label, parts) for batch in batches
              for label, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])


def _peaks(batches: Iterator[pa.RecordBatch], net: Net) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(net)
    for batch in batches:
        docs = [text_words(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(scorer.best(docs)),
             pa.array([window_count(len(d)) for d in docs], pa.int64())], ["doc_id", "y", "best", "count"])
    del scorer
    give_back()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_toxic: int = 3000, max_clean: int = 4500,
          max_windows: int = 32, learn_from=None) -> Net | float:
    """Fit on a bounded sample of ``docs (doc_id, text)`` with ``labels (doc_id, label)``; see the module text.

    ``learn_from``: a condition on ``doc_id`` for rows that may be learned from. Returns the constant share of toxic
    labels where one class is missing.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col(label)).cast("int").alias("y"))
    known = known if learn_from is None else known.where(learn_from)
    # ids first (no text leaves its task), then the few chosen texts
    full = docs.where(~_blank(F.col("text")))
    count = {int(r["y"] > 0): r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, toxic = sum(count.values()), F.col("y") > 0
    place = F.row_number().over(Window.partitionBy(toxic).orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = [(r["doc_id"], int(r["y"] > 0)) for r in full.select("doc_id").join(known, "doc_id").distinct()
           .withColumn("place", place).where(F.col("place") <= max(max_toxic, max_clean))
           .where(F.col("place") <= F.when(toxic, max_toxic).otherwise(max_clean)).collect()]
    if not total or len({y for _, y in ids}) < 2:
        return count.get(1, 0) / total if total else 0.0
    spark = docs.sparkSession
    # at most max_toxic + max_clean rows of two numbers
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, y int"))
    sample = write_table(full.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select(
        "doc_id", "y", F.col("text").cast("binary").alias("text")), "toxicity_sample")
    parts = write_table(sample.mapInArrow(lambda it: _cut(it, max_windows), "doc_id long, y int, parts array<binary>"),
                        "toxicity_parts")
    net = pickle.loads(bytes(parts.repartition(1).sortWithinPartitions(
        F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").mapInArrow(_learn, "net binary").first()["net"]))
    peaks = sample.repartition(max(1, min(len(ids) // 100, 32)), "doc_id").mapInArrow(
        lambda it: _peaks(it, net), "doc_id long, y int, best double, count long").collect()
    peaks.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    y, share = np.array([r["y"] for r in peaks], np.float64), count.get(1, 0) / total
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    net.slope, net.bend, net.shift = calibrate(np.array([r["best"] for r in peaks]),
                                               np.array([r["count"] for r in peaks], np.float64), y, weight)
    return net


def _score(batches: Iterator[pa.RecordBatch], net: Net, column: str) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(net)
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).to_pylist()
        words = [text_words(t) for t in texts]
        best = scorer.best(words)
        count = np.array([window_count(len(w)) for w in words], np.float64)
        score = np.where(np.isfinite(best), net.score(np.where(np.isfinite(best), best, 0.0), count), 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])
    del scorer
    give_back()


def _blank(text) -> Column:
    """No word in the text; the search ends at the first character of one."""
    return ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def score_rows(docs: DataFrame, net: Net | float, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with all its columns and a ``score`` (a column of that name is replaced)."""
    prepare(docs.sparkSession)
    docs = docs.drop("score")
    if isinstance(net, float | int):
        return docs.withColumn("score", F.when(_blank(F.col(text)), 0.0).otherwise(F.lit(float(net))))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lambda it: _score(it, net, text), schema)


def score_documents(docs: DataFrame, net: Net | float) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs (doc_id, text)``."""
    return score_rows(docs.select("doc_id", "text"), net).select("doc_id", "score")
