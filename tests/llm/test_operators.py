"""Small-table tests of the training-data operators: brute force, round trips, nulls, empties, ties, repeated rows."""

import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.llm import (bin_packing, embed_dedup, html_main, license_scan, mixing, near_dedup, preference, quality,
                          records, toxicity)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ near-duplicates
def groups_by_brute_force(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and root[a] != root[b] and \
                        100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 1)[0] + str(x) for x in rng.integers(0, 500, 60))
            for _ in range(12)]
    texts = []
    for i, b in enumerate(base):
        texts.append((10 * i, b))
        for k in range(1, 6):
            w = b.split(" ")
            for p in rng.integers(0, 60, k):
                w[p] = f"new{p}x{k}"
            texts.append((10 * i + k, " ".join(w).upper() if k == 2 else " ".join(w)))
    texts += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One  two"), (905, "x" * 5000), (906, base[0])]
    df = frame(spark, texts, "doc_id long, text string").withColumn("bands", F.lit("clash"))
    want = groups_by_brute_force(texts, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 3, 85, 32, 7).collect()}
    assert got == want


def test_near_duplicates_empty_and_null_ids(spark):
    empty = near_dedup.near_duplicates(frame(spark, [], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0
    rows = near_dedup.near_duplicates(frame(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f")],
                                            "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (7, 7, True),
                                                                                     (7, 7, True)]


def test_prefix_filter_loses_no_link(spark):
    """A bucket whose centres are outliers: the exact step must still find the links of the others."""
    rng = np.random.default_rng(2)
    core = list(range(100))
    sets = {i: np.array(sorted({*rng.choice(core, 96, replace=False).tolist(), 1000 + i}), np.int64) for i in range(8)}
    sets |= {8 + i: np.array(sorted({*rng.choice(core, 60, replace=False).tolist(), *range(2000 + 50 * i, 2040 + 50 * i)}),
                             np.int64) for i in range(4)}
    df = frame(spark, [(i, s.tolist()) for i, s in sets.items()], "id long, s array<long>")
    pairs = near_dedup._prefix_pairs(df.select("id", F.col("id").alias("g")), df, 80)
    got = {(r.a, r.b) for r in near_dedup._confirm(pairs, df, 80).collect()}
    want = {(a, b) for a in sets for b in sets if a < b
            and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert got == want and want


# ------------------------------------------------------------------ embeddings
def test_embedding_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        v = rng.normal(size=16)
        for j in range(3):
            rows.append((3 * k + j, (v + 0.06 * j * rng.normal(size=16)).astype(np.float32).tolist(), k % 2))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], None), (502, None, 0), (503, [0.0] * 16, 0),
             (504, [float("nan")] * 16, 0), (505, [], 0)]
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embedding_duplicates(df, 0.98, block=16).collect()}
    ok = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, y in rows
          if v and y is not None and np.isfinite(v).all() and np.any(v)}
    label = {i: y for i, _, y in rows}
    links = {i: {j for j in ok if j != i and label[j] == label[i] and ok[i] @ ok[j] >= 0.98} for i in ok}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert got[i] == (len(links.get(i, ())), min(seen)), i


def test_quantisation_bound_holds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = embed_dedup.unit(rng.normal(size=24)), embed_dedup.unit(rng.normal(size=24) * 10.0 ** rng.integers(-9, 9))
        (qx, sx, ex, nx), (qy, sy, ey, _) = embed_dedup.quantise(x), embed_dedup.quantise(y)
        assert abs(x @ y - sx * sy * (qx.astype(int) @ qy.astype(int))) <= nx * ey + ex + 1e-12


# ------------------------------------------------------------------ records
def test_records_round_trip_and_damage(spark):
    from tokenizers import Tokenizer

    rows = [(3, "Hello world,  two blanks\n\nand lines "), (1, None), (2, ""), (3, "tab\there\x1c and nbsp x"),
            (None, "no id"), (9, "word " * 3000)]
    df = frame(spark, rows, "doc_id long, text string")
    path = records.default_tokenizer()
    tok = Tokenizer.from_file(path)
    manifest = records.write_records(df, path)
    got = records.read_records(manifest).collect()
    want = Counter((i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, 1, 2, 3, 3, 9]
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert Counter((r.doc_id, bytes(r.ids)) for r in records.read_shuffled(manifest, 3).collect()) == want
    assert records.round_trip(spark, df.limit(0)).count() == 0
    raw = records.frame(records.serialise(5, np.array([1, 2, 70000], "<u4")))
    import io
    assert records.parse(records.read_frame(io.BytesIO(raw)))[1].tolist() == [1, 2, 70000]
    for at in (0, 9, 20, len(raw) - 1):
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1:]))


# ------------------------------------------------------------------ packing
def test_packing_places_every_piece(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(0, 300, 300))]
    rows += [(1000, "word " * 1300), (1001, None), (1001, None), (None, "x")]
    path = records.default_tokenizer("word_bpe_49k.json")
    out = bin_packing.pack_documents(frame(spark, rows, "doc_id long, text string"), path, capacity=512, group=100,
                                     with_ids=True)
    got = out.collect()
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[a:a + 512], "<u4").tobytes()
            want[(i, k, a, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512
    least = -(-sum(r.length for r in got) // 512)
    assert len(bins) <= least + 2
    seqs = bin_packing.build_sequences(out).collect()
    assert sum(r.n_tokens for r in seqs) == sum(r.length for r in got)
    assert bin_packing.pack_documents(frame(spark, [], "doc_id long, text string"), path).count() == 0


def test_crossover_keeps_items_once():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 100, 200).tolist()
    a, b = (bin_packing.best_fit(rng.permutation(200).tolist(), size, 128) for _ in range(2))
    child = bin_packing.crossover(a, b, size, 128, rng)
    assert sorted(i for x in child for i in x) == list(range(200))
    assert all(sum(size[i] for i in x) <= 128 for x in child)


# ------------------------------------------------------------------ mixing
def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("w" * int(n)), ["a", "b", "c", None][i % 4]) for i, n in enumerate(rng.integers(0, 40, 800))]
    rows += [(1, None, "a"), (1, None, "a")]
    df = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(df, carry=["doc_id", "source"], block=64).collect()
    again = mixing.mix(df.repartition(3), carry=["doc_id", "source"], block=64).collect()
    key = lambda r: (r.doc_id, r.source or "~", r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.copies <= 2
        t = by.setdefault(r.source, [0, 0, r.target])
        t[0] += r.size
        t[1] += r.copies * r.size
    total = sum(t[0] for t in by.values())
    assert abs(sum(t[2] for t in by.values()) - 1.5 * total) < 1e-6
    for size, taken, target in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 5
    assert by["a"][2] == pytest.approx(2 * by["a"][0])
    assert mixing.mix(frame(spark, [], "doc_id long, text string, source string")).count() == 0
    assert mixing.mix(frame(spark, [(1, "", "a")], "doc_id long, text string, source string")).first().copies == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    p, x = rng.random(200), np.stack([np.ones(200), rng.integers(1, 99, 200)], axis=1).astype(float)
    q = mixing.flight(p, x, rng)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    np.testing.assert_allclose(q @ x, p @ x, rtol=1e-6)


def test_mixing_long_document_beside_a_hot_source(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join("w" * int(n)), "hot") for i, n in enumerate(rng.integers(1, 40, 6000))]
    rows += [(10_000 + i, " ".join("w" * int(n)), s) for s in ("b", "c") for i, n in
             enumerate(rng.integers(100, 300, 500))]
    rows += [(20_000, "w " * 100_000, "b")]
    df = frame(spark, rows, "doc_id long, text string, source string")
    for weights in ((3, 1, 2), (1, 1, 1)):
        by = {}
        for r in mixing.mix(df, carry=["doc_id", "source"], weights=weights, block=64).collect():
            assert 0 <= r.copies <= 2
            t = by.setdefault(r.source, [0, r.target])
            t[0] += r.copies * r.size
        assert all(abs(taken - target) <= 20 for taken, target in by.values()), by


def test_settled_documents_keep_their_rate():
    size = np.array([500.0, 300.0])
    got = np.array([mixing.settle(size, 3000.0, 2100.0, 2.0, np.random.default_rng(k)) for k in range(4000)])
    np.testing.assert_allclose(got.mean(axis=0), 0.7, atol=0.04)
    assert mixing.settle(np.array([900.0]), 1000.0, 500.0, 2.0, np.random.default_rng(0)) in ([0], [1])
    assert mixing.settle(np.array([100.0]), 1000.0, 2000.0, 2.0, np.random.default_rng(0)) == [2]


# ------------------------------------------------------------------ quality
def test_quality_features_match_plain_python(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", "  \n ", "a b c a b c", "a a a a", "x # $ %\nline\nline\n \n\nline", "é ü ö ü", "one two"]
    texts += [" ".join(rng.choice(list("abcde"), n)) for n in (3, 30, 400)]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    df = df.withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        wins = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        c = Counter(wins)
        rep = {k + j for k, x in enumerate(wins) if c[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(rep))
        assert tuple(got[i][c] for c in quality.FEATURES) == want, t
        assert got[i].base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
    assert quality.judge(df.limit(0)).count() == 0


def test_host_verdicts_shrink_small_hosts(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 10 + [("good", True)] * 30 + [("good", False)] * 970 + [("tiny", True)]
    got = {r.host: r for r in quality.host_verdicts(frame(spark, rows, "host string, failed boolean")).collect()}
    assert not got["bad"].host_kept and got["good"].host_kept
    assert got["tiny"].rate < 1 and 0.03 <= got["good"].rate < 0.05


# ------------------------------------------------------------------ HTML
PAGE = ('<html><head><title>T</title><script>var a="</p>";</script></head><body><header><a href="/">Home</a></header>'
        '<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies.</div>'
        '<article><h1>Big &amp; small</h1><p>First  para<b>graph</b>.<br>Line<p>Second one &lt;here&gt;.'
        '<form><p>Your mail</p></form></article><div id="comments"><p>Nice text, thank you very much for it.</p></div>'
        '<aside><p>Read this other long article about something else.</p></aside><footer>&copy; us</footer>')


def test_main_text(spark):
    df = frame(spark, [(1, "u", PAGE), (2, None, None), (3, "e", ""), (3, "e", ""), (4, "t", "<p>Only text here."),
                       (5, "b", "<<<>>><p")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_main.extract_main_text(df).collect())
    want = "Big & small\n\nFirst paragraph. Line\n\nSecond one <here>."
    assert got[0] == (1, want, len(want))
    assert got[1:4] == [(2, "", 0), (3, "", 0), (3, "", 0)] and got[4][1] == "Only text here."


def test_article_text_is_not_lost_to_unclosed_elements_or_slugs():
    para = "A sentence of the article, long enough to be read as such. " * 8
    text = para.strip()
    embedded = ("button", "select", "svg", "object", "noscript", "video", "audio", "canvas", "map", "template")
    for tag in embedded:
        for page in (f"<body><article><p>{para}</p><div><{tag}>Share</div><p>Last. {para}</p></article>",
                     f"<body><div><{tag}>Share</div><article><p>{para}</p><p>Last. {para}</p></article><{tag}>x</{tag}>",
                     f"<body><article><p>{para}</p><{tag}>a<{tag}>b</{tag}>c</{tag}><p>Last. {para}</p></article>"):
            got = html_main.main_text(page)
            assert text in got and f"Last. {text}" in got, page[:60]
        assert "Share" not in html_main.main_text(f"<article><p>{para}</p><{tag}>Share</{tag}></article>")
    for tag in ("button", "svg", "video"):
        assert text in html_main.main_text(f"<body><{tag}>Menu<article><p>{para}</p></article><{tag}>x</{tag}>")
    for names in ('id="related-work"', 'id="social-impact"', 'id="notice"', 'class="social-impact"'):
        assert text in html_main.main_text(f"<article><p>{para}</p><section {names}><p>Here. {para}</p></section></article>"
                                           ).split("Here. ")[-1], names
        assert "Here. " in html_main.main_text(
            f"<article><p>{para}</p><section {names}><p>Here. {para}</p></section></article>"), names
    for names in ('class="related"', 'class="share-buttons"', 'id="comments"'):
        assert "Tweet" not in html_main.main_text(f"<article><p>{para}</p><div {names}>Tweet this</div></article>"), names
    assert html_main.main_text(f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be. {para}</p></article>"
                               ).startswith("Let x=1 be. ")


def test_min_cut_matches_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(30):
        n = 6
        g, s, t = html_main.Graph(n + 2), n, n + 1
        cap = np.zeros((n + 2, n + 2))
        for i in range(n):
            for a, b in ((s, i), (i, t)):
                cap[a, b] = rng.random()
                g.edge(a, b, cap[a, b])
            if i:
                cap[i - 1, i] = cap[i, i - 1] = rng.random()
                g.edge(i - 1, i, cap[i, i - 1], cap[i, i - 1])
        side = g.source_side(s, t)
        cost = lambda inside: sum(cap[a, b] for a in range(n + 2) for b in range(n + 2)
                                  if inside[a] and not inside[b])
        best = min(cost([bool(c >> k & 1) for k in range(n)] + [True, False]) for c in range(2 ** n))
        assert abs(cost(side) - best) < 1e-9


# ------------------------------------------------------------------ licences, preferences
def test_license_scan(spark):
    mit = dict(license_scan.KNOWN[::-1])["MIT"]
    full = next(t for i, t in license_scan.KNOWN if i == "MIT" and t.startswith("Permission"))
    df = frame(spark, [(1, "Copyright (c) 2020 Someone\n\n" + full.upper().replace(" LICENSE", " LICENCE")), (2, None), (3, ""),
                       (4, "Prose.\nreleased under the MIT licence\nMore."), (4, "no"), (5, mit + " And more words.")],
               "doc_id long, text string").withColumn("digest", F.lit("clash"))
    rows = license_scan.scan_licenses(df).collect()
    got = sorted((r.doc_id, r.license_id or "", [(x.line, x.license_id) for x in r.notices]) for r in rows)
    assert got == [(1, "MIT", got[0][2]), (2, "", []), (3, "", []), (4, "", []), (4, "", [(2, "MIT")]), (5, "", [])]
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_files_in_standard_form(spark):
    full = {i: t for i, t in license_scan.KNOWN if t.startswith("Permission")}
    titles = {"MIT": ["", "MIT License\n\n", "The MIT License (MIT)\r\n\r\n", "  The MIT Licence\n"],
              "ISC": ["", "ISC License\n\n", "The ISC License\n\n"]}
    notices = ["", "Copyright (c) 2020 Some One\n\n", "Copyright 2019-2021, A\nAll rights reserved.\n\n", "© A Company\n",
               "(c) 2020 B\n", "Copyright (c) <year> <holder>\n", "Copyright <year> <holder>\n"]
    rows = []
    for lic, text in full.items():
        wrapped = [textwrap.fill(text, n) for n in (30, 55, 72, 79)]
        # a line break before every "copyright"
        wrapped.append(re.sub("(?i) (copyright)", r"\n\1", text))
        for title in titles[lic]:
            rows += [(lic, title + n + w) for n in notices for w in wrapped] + [(lic, notices[1] + title + wrapped[0])]
    rows += [(None, full["MIT"].replace("The above copyright notice", "The above")), (None, "MIT License"),
             (None, "MIT License\n"), (None, "(c) You must keep this.\n" + full["MIT"]),
             (None, "Copyright law applies.\n" + full["ISC"])]
    df = frame(spark, [(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.scan_licenses(df).collect()}
    assert got == {i: lic for i, (lic, _) in enumerate(rows)}
    known = frame(spark, [("X", "MIT License")], "license_id string, text string")
    lines = license_scan.scan_licenses(frame(spark, [(1, "a\nMIT License\nb")], "doc_id long, text string"), known)
    assert [x.line for x in lines.first().notices] == [2]


def test_preferences(spark):
    rows = [(1, s, 0, "user", "Hi") for s in ("chosen", "rejected")]
    rows += [(1, "chosen", 1, "assistant", "Good"), (1, "rejected", 1, "assistant", "Bad one"),
             (2, "chosen", 0, None, None), (2, "rejected", 0, "user", ""), (3, "chosen", 0, "user", "only"),
             (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x")]
    df = frame(spark, rows, "pair_id long, side string, turn long, role string, text string")
    got = {r.pair_id: r for r in preference.format_preferences(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].prompt == "<|user|>\nHi<|end|>\n" and got[1].chosen == "<|assistant|>\nGood<|end|>\n"
    (a,), (b,) = got[1].chosen_mask, got[1].rejected_mask
    assert got[1].chosen[a.start:a.start + a.length] == "Good"
    assert got[1].rejected[b.start:b.start + b.length] == "Bad one"
    assert not got[2].differs and got[2].chosen == got[2].rejected == "" and got[2].n_prefix == 1
    assert got[3].n_prefix == 0 and got[3].prompt == "" and got[3].rejected == "" and got[3].differs
    assert preference.format_preferences(df.limit(0)).count() == 0


# ------------------------------------------------------------------ toxicity
def test_gradients_match_finite_differences():
    net = toxicity.Net(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocabulary = [b"one", b"two", b"threeandmore", b"x"]
    windows, y, weight = [np.array([0, 1, 2]), np.array([3, 0])], np.array([1.0, 0.0]), np.array([0.7, 0.3])

    def loss():
        table = net.inputs(net.word_vectors(vocabulary))
        at, mask = np.array([[0, 3], [1, 0], [2, 0]]), np.array([[1, 1], [1, 1], [1, 0]], bool)
        z = net.window_logits(table, at, mask)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    got = toxicity.gradients(net, vocabulary, windows, y, weight)
    rng = np.random.default_rng(0)
    for k, g in got.items():
        i = tuple(rng.integers(0, n) for n in g.shape) if k != "ce" else (ord("o"), 1)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-4
        up = loss()
        net.p[k][i] = old - 1e-4
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-4 - g[i]) < 2e-3, k


def test_toxicity_learns_a_stem(spark):
    rng = np.random.default_rng(1)
    plain = lambda n: [f"{rng.choice(['ba', 'de', 'lo'])}{rng.choice(['na', 'ti', 'ru'])}{rng.integers(9)}"
                       for _ in range(n)]
    docs, labels = [], []
    for i in range(400):
        w = plain(int(rng.integers(5, 70)))
        if i % 2:
            w[int(rng.integers(len(w)))] = f"zork{rng.integers(1000)}"
        docs.append((i, " ".join(w)))
        labels.append((i, i % 2))
    docs += [(1000, None), (1001, ""), (1001, " ")]
    d, y = frame(spark, docs, "doc_id long, text string"), frame(spark, labels + [(None, 1), (2, None)], "doc_id long, toxic int")
    held = F.col("doc_id") % 5 == 0
    net = toxicity.train(d, y, learn_from=~held)
    got = {r.doc_id: r.score for r in toxicity.score_documents(d, net).collect()}
    right = [(got[i] >= 0.5) == bool(i % 2) for i in range(0, 400, 5)]
    assert np.mean(right) > 0.9
    assert got[1000] == got[1001] == 0.0
    assert toxicity.train(d, y.where("toxic = 1")) == 1.0
    assert toxicity.score_documents(d.limit(0), net).count() == 0


def test_toxicity_learns_from_long_documents(spark):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(240):
        w = [f"{rng.choice(['ba', 'de', 'lo'])}{rng.choice(['na', 'ti', 'ru'])}{rng.integers(9)}"
             for _ in range(1200 if i % 2 or i % 3 == 0 else 40)]
        if i % 2:  # toxic documents are all above 4,000 characters, in many of their windows
            for k in range(5, len(w), 30):
                w[k] = f"zork{rng.integers(1000)}"
        docs.append((i, " ".join(w)))
        labels.append((i, i % 2))
    d, y = frame(spark, docs, "doc_id long, text string"), frame(spark, labels, "doc_id long, toxic int")
    net = toxicity.train(d, y, learn_from=F.col("doc_id") % 5 != 0)
    assert isinstance(net, toxicity.Net) and net.bend <= 0
    got = {r.doc_id: r.score for r in toxicity.score_documents(d, net).collect()}
    for long in (True, False):
        right = [(got[i] >= 0.5) == bool(i % 2) for i in range(0, 240, 5) if (len(docs[i][1]) > 4000) == long]
        assert np.mean(right) > 0.9


def test_windows_of_toxicity():
    for n in (1, 47, 48, 49, 71, 72, 73, 96, 97, 1000):
        starts = toxicity.window_starts(n)
        assert toxicity.window_count(n) == len(starts)
        assert all(b - a <= toxicity.WINDOW // 2 for a, b in zip(starts, starts[1:]))
    text = b" ".join(b"w%d" % k for k in range(5000))
    parts = toxicity.spread_parts(text, 8)
    assert len(parts) == 8 and all(len(p.split()) == toxicity.WINDOW for p in parts)
    assert parts[0].startswith(b"w0 ") and parts[-1].endswith(b"w4999")
    best, count = np.zeros(400), np.repeat([1.0, 100.0], 200)
    y = np.r_[np.ones(150), np.zeros(50), np.zeros(150), np.ones(50)]
    slope, bend, shift = toxicity.calibrate(best, count, y, np.ones(400))
    assert bend < -0.2 and slope > 0
    assert toxicity.calibrate(best, count, 1 - y, np.ones(400))[1] == 0.0
