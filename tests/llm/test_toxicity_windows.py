"""Scores of whole texts against a plain loop over all windows, one scalar network step at a time."""

import numpy as np

from textlake.llm import toxicity


def soft(x):
    return x / (1 + np.abs(x))


def cell(h, u, w):
    z, r = (0.5 + 0.5 * soft(h @ w[k] + u[k]) for k in (0, 1))
    c = soft(r * (h @ w[2]) + u[2])
    return c + z * (h - c)


def word_vector(net, word):
    p, parts = net.p, [net.p["we"][toxicity.zlib.crc32(word) % toxicity.BUCKETS]]
    for side, chars in (("f", word), ("b", word[::-1])):
        h = np.zeros(toxicity.CHAR_H)
        for c in chars:
            h = cell(h, np.split(p["ce"][c] @ p[f"cx{side}"] + p[f"cb{side}"], 3), p[f"ch{side}"])
        parts.append(h)
    return np.concatenate(parts)


def window_logit(net, words):
    p, vec = net.p, [word_vector(net, w) for w in words]
    states = {}
    for side, order in (("f", range(len(vec))), ("b", range(len(vec) - 1, -1, -1))):
        h = np.zeros(toxicity.WORD_H)
        for t in order:
            h = cell(h, np.split(vec[t] @ p[f"wx{side}"] + p[f"wb{side}"], 3), p[f"wh{side}"])
            states[side, t] = h
    s = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(vec))])
    e = (soft(s @ p["a"]) @ p["v"])[:, 0]
    att = np.exp(e - e.max())
    return float((att / att.sum()) @ s @ p["o"][:, 0] + p["b"][0])


def test_every_window_of_whole_texts_is_scored(spark):
    rng, net = np.random.default_rng(8), toxicity.Net(5)
    net.slope, net.bend, net.shift = 1.3, -0.2, 0.1
    texts = [" ".join(f"w{rng.integers(60)}" for _ in range(n)) for n in (1, 30, 47, 48, 49, 72, 130, 313)]
    texts += ["Capital LETTERS and\ttabs\n\n end", "x" * 130, None, "", "  \n"]
    got = {r.doc_id: r.score for r in toxicity.score_documents(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for k, text in enumerate(texts):
        words = [w[j:j + 24] for w in (text or "").lower().encode().split() for j in range(0, len(w), 24)]
        if not words:
            assert got[k] == 0.0
            continue
        starts = sorted({*range(0, max(len(words) - 48, 0) + 1, 24), max(len(words) - 48, 0)})
        assert all(any(s <= j < s + 48 for s in starts) for j in range(len(words)))
        best = max(window_logit(net, words[s:s + 48]) for s in starts)
        want = 1 / (1 + np.exp(-(1.3 * best - 0.2 * np.log(len(starts)) + 0.1)))
        assert abs(got[k] - want) < 1e-5
