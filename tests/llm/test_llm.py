"""The operators against brute force on small tables, and their edge cases."""

import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

from colophon.llm import classifier, decontamination, html, jaccard, licenses, likelihood, packing, queries, rules, sharding, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row long, shard string, words array<string>, n long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
EDGE = [None, "", " \n ", "MIT License and the GNU General Public\nLicense", "one two", "a b c d " * 40, "Ünï Ço de ñ | # $ 漢字 text", LONG, "a b c d " * 40, "Apache  LICENSE\napache license"]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i if i != 6 else None, t, i, "x", ["y"], 5) for i, t in enumerate(EDGE)], DOCS)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def same(got, want):
    assert got == sorted(want, key=str)


def ids():
    return [i if i != 6 else None for i in range(len(EDGE))]


def test_licenses(edge):
    got = rows(licenses.scan(edge), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(got, [(i, *brute.license_base(t)) for i, t in zip(ids(), EDGE, strict=True)])


def test_license_with_small_changes(spark):
    text = "x y Licensed under the Apache License version 2 0 the license you really may not use this file except in compliance with the license z"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "apache" and 0 < row.score <= 1


def _near_licenses():
    """Passages whole, cut, stretched, thinned out, repeated, and among each other."""
    rng, out = np.random.default_rng(5), ["released under the mit media lab banner", "we released under the mit roof", "Released under the MIT License.", "licensed under the apache license of 2004 version 2 0"]
    for passage in licenses.PASSAGES:
        w = passage.split()
        for _ in range(4):
            kept = [x for x in w if rng.random() < rng.choice([0.8, 0.95, 1.0])]
            at = int(rng.integers(0, len(kept) + 1))
            kept[at:at] = ["really"] * int(rng.integers(0, 6))
            cut = int(rng.integers(0, len(kept)))
            out.append(" ".join(["so", *kept[int(rng.integers(0, 3)) * cut // 3 :], *(kept if rng.random() < 0.3 else []), "it", "ends"]))
    return out + [" ".join(rng.permutation(out)[:3]) for _ in range(20)]


def test_license_labels_and_score(spark):
    texts = [*EDGE, *_near_licenses(), *licenses.PASSAGES]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        labels, score = brute.license_verdict(texts[r.doc_id], licenses.PHRASES, licenses.PASSAGES)
        assert (r.labels, r.score) == (labels, pytest.approx(score)), texts[r.doc_id]
    by_text = {texts[r.doc_id]: r for r in got}
    assert not by_text["released under the mit media lab banner"].labels and not by_text["we released under the mit roof"].labels
    assert all(by_text[t].labels and by_text[t].score == 1 for t in licenses.PASSAGES)


def test_sharding(edge):
    got = sharding.assign(edge, 4).collect()
    same(sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str), [(i, *brute.size_and_crc(t)) for i, t in zip(ids(), EDGE, strict=True)])
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} == {2, 3}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_bijection(n):
    assert sorted(sharding.feistel(np.arange(n), n, 3)) == list(range(n))


def test_classifier_layout_covers_whole_texts():
    net = classifier.Network()
    net.w["out"] = np.random.default_rng(0).normal(0, 1, classifier.HIDDEN).astype(np.float32)
    texts = ["", "ab", "x" * 5000, "é" * 700, "y" * 512, "z"]
    whole = net.forward(*classifier.lay_out(*classifier.text_buffers(pa.array(texts))))[0]
    single = [net.forward(*classifier.lay_out(*classifier.text_buffers(pa.array([t]))))[0][0] for t in texts]
    assert np.allclose(whole, single) and len(set(np.round(single, 4))) > 3


def test_classifier_gradient():
    net = classifier.Network()
    net.w["out"] = np.random.default_rng(0).normal(0, 1, classifier.HIDDEN).astype(np.float32)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    laid, begins = classifier.lay_out(*classifier.text_buffers(pa.array(["hello world" * 90, "abc"])))
    y = np.array([1.0, 0.0])
    g, _ = net.gradient(laid, begins, y)
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip(net.forward(laid, begins)[0], y, strict=True)])
    for k in ("out", "dense", "lean", "shift"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.w[k][at] += 1e-3
        up = loss()
        net.w[k][at] -= 2e-3
        down = loss()
        net.w[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-4


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_jaccard(edge):
    texts = dict(zip([*range(6), 99, *range(7, len(EDGE))], EDGE, strict=True))
    want = brute.components(texts, 3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(edge).collect()}
    assert {i: got[None if i == 99 else i] for i in texts} == {i: (v[0], None) if i == 99 else v for i, v in want.items()}


def variants(n, length, seed, edits):
    r = np.random.default_rng(seed)
    base = [f"t{x}" for x in r.integers(0, 5000, length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(int(r.integers(0, edits))):
            words[int(r.integers(0, length))] = f"e{r.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_groups(spark, k, percent):
    texts = dict(enumerate(variants(70, 120, 1, 9) + variants(30, 40, 2, 4) + variants(20, 7, 3, 2) + variants(12, 900, 4, 60)))
    got = jaccard.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(texts, k, percent)
    assert {r.doc_id: r.n_links for r in got} == brute.n_links(texts, k, percent)


@pytest.mark.parametrize("limits", [{"CHUNK": 16, "PACK": 1500}, {"TILE": 12, "PACK": 700, "HOT": 3, "GATHER": 900, "SMALL": 2, "CHUNK": 5}, {"BUNDLE": 2000, "HOT": 1, "BROADCAST_IDS": 0}])
def test_jaccard_chunks_and_bundles(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    texts = dict(enumerate(variants(90, 120, 5, 7) + variants(40, 30, 6, 3)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for k, percent in ((3, 90), (2, 95)):
        kept = {r.doc_id for r in jaccard.deduplicate(docs, k, percent).collect()}
        assert kept == {v[1] for v in brute.components(texts, k, percent).values()}
    got = jaccard.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(texts, 3, 90)
    assert {r.doc_id: r.n_links for r in got} == brute.n_links(texts, 3, 90)


def test_overlaps(monkeypatch):
    monkeypatch.setattr(jaccard, "WIDE", 7)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 40))).astype(np.uint64) for _ in range(12)]
    got = jaccard.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(12) if i != j)


def test_urls(spark):
    given = [None, "", "x", "http://A.com/en/1", "http://example.com/en/7?q", "https://a.b.net/de/9", "https://s.example.net/de/88#x", "http://o.org/es/", "http://m.casino-win.example.com/fr/1", "://com/en/", "http://xcom/en/", "http://com"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(given)], "page_id long, url string, host string, rule string")
    want = []
    for i, u in enumerate(given):
        host, path = brute.url_parts(u)
        rule, verdict = brute.url_rule(host, path, urls.RULES)
        want.append((i, host, path, rule, verdict or ("block" if "casino" in host else "allow")))
    same(rows(urls.judge(pages), "page_id", "host", "path", "rule", "verdict"), want)


def test_rules(edge):
    got = rows(rules.evaluate(edge), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(got, [(i, *brute.quality(t)) for i, t in zip(ids(), EDGE, strict=True)])
    assert rules.apply(edge).columns == edge.columns


HTML = """<html><body class=x><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div><form><p>Mail</p></form>
<article><header>By</header><h1>T&amp;C</h1><p>First <b>para</b>graph<br>goes&nbsp;on.<p>Second &lt;one&gt;<script>var a="</p>";</script>
<div class="ad">Buy</div><ul><li>x<li>y</ul><aside>More</aside><section class="comments"><p>Nice!</p></section></article><div id="sidebar">S</div><footer>f</footer>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "http://a/1", HTML, 0), (2, "http://a/2", None, 0), (3, None, "", 0), (4, "http://a/4", "plain &amp; <p>simple", 0)], "page_id long, url string, html string, path long")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    text = "T&C\n\nFirst paragraph goes on.\n\nSecond <one>\n\nx\n\ny"
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), 4: ("plain &\n\nsimple", 15)}


def test_decontamination(spark, edge):
    items = [(1, "a b c d a b c d a b c d"), (2, "ONE two"), (3, None), (4, ""), (5, " ".join(LONG.split()[500:520])), (6, "never there at all ever")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontamination.digest(decontamination.scan(edge, bench)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    same(got, [(i, *brute.hits(t, items)) for i, t in zip(ids(), EDGE, strict=True)])
    clean = {r.row for r in decontamination.remove(edge, bench).collect()}
    assert clean == {i for i, t in enumerate(EDGE) if not brute.hits(t, items)[1]}


def test_likelihood(edge):
    got = {r.doc_id: r for r in likelihood.score(edge).collect()}
    assert got[0].n_tokens == 0 and got[0].log_likelihood == 0 and got[0].mean_log_likelihood is None
    assert all(r.log_likelihood < 0 for r in got.values() if r.n_tokens)
    assert [got[i].n_tokens for i in (4, 7)] == [2, 60_000]


def test_packing(edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in zip(ids(), EDGE, strict=True)}
    got, places = {}, {}
    for r in packing.pack(edge).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(want[r.doc_id])
        got.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, total in ((got, None), (places, packing.WINDOW)):
        for key, spans in pieces.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at <= total if total else at == len(want[key])
    assert set(got) == set(want)


SPECIAL = "<|endoftext|>"


@pytest.mark.parametrize("text", ["", " a  b\n c", "<|endoftext|> hi   x é è　漢 字", "it's 12  34 éé \u0085 a b", " \t\n ", "a" * 3000, f"a {SPECIAL}b  {SPECIAL}{SPECIAL}\n{SPECIAL}", f"é{SPECIAL} c{SPECIAL[:-1]}", f"{SPECIAL}it's\u0085 {SPECIAL}  x"])
def test_encoder(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = packing.Encoder(packing.default_vocabulary())
    ids, starts, _, _ = encoder.encode(pa.array([text, None, text]))
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert ids[: starts[1]].tolist() == want and ids[starts[2] :].tolist() == want


@pytest.mark.parametrize("operator", [licenses.scan, sharding.assign, jaccard.classes, rules.evaluate, packing.pack, likelihood.score])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(pages).count() == 0 and urls.judge(pages).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {r.doc_id for r in docs.collect()}
        if number == 2:
            assert left == {v[1] for v in brute.components(kept, 5, 80).values()}
        if number == 3:
            assert left == {i for i, t in kept.items() if not brute.hits(t, bench)[1]}
        kept = {i: kept[i] for i in left}
