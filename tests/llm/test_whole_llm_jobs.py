"""Training-data operators on tables where a part of the job would show."""

import os
import pickle
import sys
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from colophon.llm import classifier, decontamination, html, jaccard, likelihood, packing, rules
from colophon.llm.common import SPACE_WORDS, word_hashes


def kept_rows(spark, rows, k=5, percent=80):
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    kept = jaccard.deduplicate(docs, k, percent)
    assert kept.columns == docs.columns
    return [r.row for r in kept.collect()]


def group_heads(rows, k, percent):
    """The groups of rows that links join, as (numbers of the rows, those that may be kept)."""
    groups = {}
    for row, (_, root) in brute.components({r: t for _, t, r in rows}, k, percent).items():
        groups.setdefault(root, []).append(row)
    ids = {r: i for i, _, r in rows}
    for own in groups.values():
        least = min((ids[r] for r in own if ids[r] is not None), default=None)
        yield own, [r for r in own if ids[r] == least]


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (3, 90)])
def test_deduplicate_by_class_not_by_id(spark, k, percent):
    text = lambda x, n=60: " ".join(f"{x}{i}" for i in range(n))
    given = [(1, text("a")), (1, text("b")), (1, text("a")), (2, text("a")), (None, text("c")), (None, text("d")), (None, text("a")), (None, text("c")), (3, text("d") + " end"), (None, text("e")), (5, text("f")), (4, text("f")), (4, text("g")), (7, None), (7, ""), (None, " \n"), (None, None)]
    rows = [(i, t, r) for r, (i, t) in enumerate(given)]
    got = kept_rows(spark, rows, k, percent)
    groups = list(group_heads(rows, k, percent))
    assert len(got) == len(set(got)) == len(groups) == 11
    assert all(len(set(got) & set(own)) == 1 and set(got) & set(best) for own, best in groups)


def test_deduplicate_edge_table(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    texts = [None, "", " \n ", "one two", "a b c d " * 40, "Ünï Ço de ñ | # $ 漢字 text", long, "a b c d " * 40]
    for ids in (range(len(texts)), [None] * len(texts), [3] * len(texts)):
        rows = [(i, t, r) for r, (i, t) in enumerate(zip(ids, texts, strict=True))]
        got = set(kept_rows(spark, rows))
        assert len(got) == 7 and {0, 1, 2, 3, 5, 6} <= got


def zipf_texts():
    r = np.random.default_rng(4)
    return [" ".join(f"w{min(int(x), 40_000)}" for x in r.zipf(1.3, 400)) for _ in range(60)]


def brute_log_probability(w, v, entry, near):
    """Of one leaf, place by place."""
    hidden = np.tanh(sum(w["in"][j][e].astype(float) for j, e in enumerate(near)))
    part = lambda z, i: z[i] - np.log(np.exp(z).sum())
    c = int(v.of[entry])
    a, b = v.first[c], v.first[c + 1]
    return part(hidden @ w["out"] + w["base"], c) + part(w["leaf"][a:b] @ hidden + w["lean"][a:b], entry - a)


def test_likelihood_names_words_and_sums_to_one(spark):
    texts = zipf_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).persist()
    counts = likelihood.word_counts(docs).persist()
    v = likelihood.Vocabulary(counts)
    w = likelihood.train(docs, v)
    n = {r.word: r.n for r in counts.collect()}
    assert len(v.words) > likelihood.CLASSES // 2 and set(v.words) >= {k for k, c in n.items() if c >= 20}
    words = np.array(list(n), np.int64)
    leaf = v.find(words.view(np.uint64))
    share = np.where(v.spare[leaf], np.array([n[int(x)] for x in words]) / v.count[leaf], 1.0)
    for near in ([v.leaves] * 4, [0, 3, int(leaf[7]), v.leaves]):
        p = np.exp([brute_log_probability(w, v, e, near) for e in range(v.leaves)])
        assert abs((p[leaf] * share).sum() - 1) < 1e-4
    # Every sum against a forward pass place by place.
    got = {r.doc_id: r for r in likelihood.score(docs).collect()}
    for i in (0, 17, 59):
        h, _ = word_hashes(pa.array([texts[i]]), SPACE_WORDS)
        own = v.find(h).tolist()
        padded = [v.leaves] * 2 + own + [v.leaves] * 2
        want = 0.0
        for k, e in enumerate(own):
            want += brute_log_probability(w, v, e, padded[k : k + 2] + padded[k + 3 : k + 5])
            want += np.log(n[int(h.view(np.int64)[k])] / v.count[e]) if v.spare[e] else 0
        assert got[i].n_tokens == len(own) == 400 and abs(got[i].log_likelihood - want) < 1e-3 * abs(want)


def test_likelihood_gradient(spark):
    docs = spark.createDataFrame(list(enumerate(zipf_texts()[:20])), "doc_id long, text string")
    v = likelihood.Vocabulary(likelihood.word_counts(docs).persist())
    r = np.random.default_rng(1)
    w = {k: x.astype(np.float64) + r.normal(0, 0.3, x.shape) for k, x in likelihood.initial(v).items()}
    words, starts = word_hashes(pa.array(zipf_texts()[:3]), SPACE_WORDS)
    y, weight = v.find(words), r.integers(1, 5, len(words)).astype(float)
    around = likelihood.contexts(y, starts, v.leaves)
    g = likelihood.gradient(w, around, y, weight, v)
    loss = lambda: -(likelihood.log_probabilities(w, around, y, v) * weight).sum() / weight.sum()
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[k][at] += 1e-4
        up = loss()
        w[k][at] -= 2e-4
        down = loss()
        w[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 0.01 * abs(g[k][at]) + 1e-6


def test_likelihood_rests_on_texts_and_not_on_their_layout(spark, monkeypatch):
    monkeypatch.setattr(likelihood, "COPY", 5000)
    texts = [*zipf_texts(), *zipf_texts()[:9], zipf_texts()[0], None, ""]
    docs = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, many = ({r.doc_id: r for r in likelihood.score(d).collect()} for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(7)))
    assert one.keys() == many.keys() and len(one) == len(texts)
    for i, r in one.items():
        assert r.n_tokens == many[i].n_tokens and abs(r.log_likelihood - many[i].log_likelihood) < 1e-4 * max(1, r.n_tokens)
    assert one[60].log_likelihood == pytest.approx(one[0].log_likelihood, rel=1e-5)


def test_likelihood_learns_from_both_sides(spark):
    """A word that follows from its neighbours gets likelier than its share of all words."""
    r = np.random.default_rng(3)
    pairs = [f"left{i} mid{i} right{i}" for i in range(12)]
    texts = [" ".join(pairs[int(i)] for i in r.integers(0, 12, 3000)) for _ in range(40)]
    mixed = " ".join(r.permutation([w for p in pairs for w in p.split()] * 20))
    got = {x.doc_id: x.mean_log_likelihood for x in likelihood.score(spark.createDataFrame([*enumerate(texts), (40, mixed)], "doc_id long, text string")).collect()}
    assert got[0] > -1.0 and got[40] < -3


def test_likelihood_tells_common_words_from_rare_ones(spark):
    texts = [" ".join(f"h{i % 60}" for i in range(3000)) + " often" * k for k in (9, 1)] + ["x often y", "x seldom y"]
    got = {r.doc_id: r.log_likelihood for r in likelihood.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[2] > got[3] + 1


def said_over(line):
    words = brute.SPACED.findall(line.lower())
    return len(words) >= 6 and max(words.count(w) for w in words) * 2 >= len(words)


def test_rules_take_failing_lines_out(spark):
    good = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    bad = ["Home | News | Sport | Mail", "BUY NOW !!!!!! ok", "All rights reserved by us", "buy buy Buy cheap buy  buy.", "x y a a a b.", "a ### b $$$ c %%% d.", "A heading without an end"]
    plain = ["a a a b c.", "to be or not to be!", ""]
    texts = ["\n".join([good[0], bad[0], good[1], *bad[1:], "", good[2], *plain]), "\n".join(good), good[0] + "\n" + bad[1], None, "spam " * 80]
    texts.append("\n".join([good[0] + " " + good[1], "", bad[3]]))
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = rules.apply(docs)
    assert got.schema == docs.schema or got.columns == docs.columns
    want = {0: "\n".join([good[0], good[1], "", good[2], *plain]), 1: texts[1], 5: good[0] + " " + good[1] + "\n"}
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {i: (t, len(t)) for i, t in want.items()}


def brute_fails(line):
    count = lambda chars: sum(c in chars for c in line)
    over = lambda chars, least, words: count(chars) >= least and count(chars) * words > count(" ")
    return (
        over("|>»", 2, 4) or over("!?", 4, 3) or over("#*$%&|<>", 6, 2) or (len(line) < 200 and any(p in line.lower() for p in rules.BOILERPLATE))
        or (count(" ") < 11 and line.strip(" \t\n\x0b\x0c\r")[-1:] not in rules.ENDS) or said_over(line)
    )


def brute_clean(text):
    """The text that stays, or None."""
    lines = (text or "").split("\n")
    failed = [x for x in lines if brute.SPACED.search(x) and brute_fails(x)]
    total, lost = (sum(len(w) for x in some for w in brute.SPACED.findall(x)) for some in (lines, failed))
    return None if brute.quality(text)[-1] or 2 * (total - lost) < total else "\n".join(x for x in lines if x not in failed)


def test_rules_stage_against_brute_force(spark):
    clash = "1 n_words, 'k' kept, 2 word_chars, 3 _in, 4 _text, 5 _failed, array(6) _lines, 7 _row, 8 base_failed, 9 _clean"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", *clash.split(", "))
    none = docs.limit(3).selectExpr("cast(null as long) doc_id", *[c if c != "text" else "text" for c in docs.columns[1:]])
    docs = docs.union(docs.limit(2)).union(none)
    got = rules.apply(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    want = [(r.doc_id, t, r.n_words, r.kept, r.word_chars, r._in) for r in docs.collect() if (t := brute_clean(r.text)) is not None]
    assert sorted(((r.doc_id, r.text, r.n_words, r.kept, r.word_chars, r._in) for r in got.collect()), key=str) == sorted(want, key=str)
    assert rules.apply(docs.where("false")).count() == 0 and all(r.n_chars == len(r.text) for r in got.collect())


def test_rules_find_words_said_over_and_over(spark):
    r = np.random.default_rng(2)
    lines = ["", " ", "a", *[" ".join(r.choice(["a", "B", "b", "c", "d"], size=int(r.integers(1, 14)), p=[0.4, 0.1, 0.2, 0.2, 0.1])) for _ in range(200)]]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [row.x for row in df.select(rules.says_over(F.col("line")).alias("x")).collect()]
    assert got == [said_over(x) for x in lines] and len(set(got)) == 2


def brute_matches(text, items, window):
    """(start, item, item's start, length) of the longest matches."""
    words, out = brute.alnum(text), []
    for item_id, item in items:
        own = brute.alnum(item)
        for i in range(len(words)):
            for j in range(len(own)):
                if words[i] == own[j] and not (i and j and words[i - 1] == own[j - 1]):
                    n = 0
                    while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                        n += 1
                    if n >= min(window, len(own)):
                        out.append((i, str(item_id), j, n))
    return sorted(out)


@pytest.mark.parametrize("limit", [10**6, 60])
def test_decontamination_places_and_parts(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "MAX_CHARS", limit)
    items = [(1, "a b c d a b c d a b c d"), (2, "one two"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(30))), (6, " ".join(f"w{i}" for i in range(14, 40))), (7, "z " * 5)]
    texts = ["a b c d " * 6, "x " + " ".join(f"w{i}" for i in range(5, 38)) + " y one TWO w1 w2", None, "", "z z z z z z one", "nothing here", "a b c d " * 6]
    docs = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(decontamination.scan(docs, bench, 4).collect(), key=lambda r: 5 if r.doc_id is None else r.doc_id)
    assert len(got) == len(texts)
    for r, text in zip(got, texts, strict=True):
        want = brute_matches(text, items, 4)
        assert [tuple(m) for m in r.matches] == want and r.longest == max((m[3] for m in want), default=0)
        n_words, n_hit, n_items, _ = brute.hits(text, items, 4)
        assert (r.n_words, r.n_hit, len(r["items"])) == (n_words, n_hit, n_items)
    assert {r.doc_id for r in decontamination.remove(docs, bench, 4).collect()} == {2, 3, None}


def test_decontamination_searches_in_blocks(monkeypatch):
    items = [(k, " ".join(f"w{(k + i) % 50}" for i in range(k))) for k in range(30)]
    text = " ".join(f"w{i % 50}" for i in range(120))
    h, starts = decontamination.word_hashes(pa.array([text, "", "w1 x"], pa.string()), decontamination.ALNUM_WORDS)
    found = []
    for block in (10**6, 7):
        monkeypatch.setattr(decontamination, "BLOCK", block)
        n_hit, names, longest, places = decontamination.search(h, starts, decontamination.TestSuffixes(items, 10), places_too=True)
        found.append((list(n_hit), names, list(longest), sorted(places)))
    assert found[0] == found[1] and found[0][3]


def test_decontamination_sends_the_words_only():
    items = [(k, " ".join(f"w{(k * 7 + i * i) % 5000}" for i in range(k % 40))) for k in range(3000)]
    made = decontamination.TestSuffixes(items, 10)
    sent = pickle.dumps(made)
    assert len(sent) < 4 * sum(len(t) for _, t in items) + 100_000
    again = pickle.loads(sent)
    assert [(s, list(p)) for s, p in again.groups] == [(s, list(p)) for s, p in made.groups]
    assert sum(len(p) for _, p in made.groups) == sum(max(n - 9, 1) for n in (k % 40 for k in range(3000)) if n)


def test_decontamination_digest_names_the_longest(spark):
    items = [(2, "a b c d e f g"), (10, "b c d e x"), (3, "q")]
    docs = spark.createDataFrame([(1, "q z b c d e z a b c d e f q"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontamination.digest(decontamination.scan(docs, spark.createDataFrame(items, "item_id long, text string"), 4)).collect()}
    for k, text in ((1, "q z b c d e z a b c d e f q"), (2, "nothing"), (3, None)):
        want = brute_matches(text, items, 4)
        best = min(want, key=lambda m: (-m[3], *m[:3]), default=(None, None, None, 0))
        r = got[k]
        assert (r.n_matches, r.longest_start, r.longest_item, r.longest_item_start, r.longest) == (len(want), *best)


@pytest.mark.parametrize("percent", [70, 50])
def test_jaccard_reaches_every_lower_band(spark, percent):
    texts = {}
    for n in range(8, 60):
        for m in {-(-n * percent // 100), -(-n * percent // 100) + 1}:
            texts[len(texts)] = " ".join(f"{n}v{m}x{i}" for i in range(n))
            texts[len(texts)] = " ".join(f"{n}v{m}x{i}" for i in range(m))
    got = jaccard.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 1, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(texts, 1, percent)
    assert {r.doc_id: r.n_links for r in got} == brute.n_links(texts, 1, percent)


def pages_of(spark, *given):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(given)], "page_id long, url string, html string")


def texts_of(spark, *given):
    return {r.page_id: r.text for r in html.extract(pages_of(spark, *given)).collect()}


@pytest.mark.parametrize(("source", "want"), [
    ("<!doctype html><head><title>T</title><meta charset=utf-8><p>Body text.<p>More.", "Body text.\n\nMore."),
    ("<head><title>T</title><body><p>One</p></body><p>Two", "One\n\nTwo"),
    ("<p title=it's>First</p><p>that's all</p>", "First\n\nthat's all"),
    ('<p title="abc>Kept text</p><p>Next</p>', "Kept text\n\nNext"),
    ("<p title='a>b' data-x=1/>Sign</p>", "Sign"),
    ("<body><div class=lead><p>A short lead.</p></div><div class=story><p>" + "long story " * 60 + "</p></div>", "A short lead.\n\n" + ("long story " * 60).strip()),
    ("<div class='page has-sidebar'><p>Text</p><div class=sidebar>Side</div></div>", "Text"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2</table>", "a\n\nb\n\nc\n\n1\n\n2"),
    ("loose <b>words</b> &amp; <div>a box</div> end", "loose words &\n\na box\n\nend"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<script>x", "deep"),
    ("<div class='layout sidebar-right'><article><h1>Head</h1><p>" + "a story " * 40 + "</article><div class=sidebar>Side text</div></div>", "Head\n\n" + ("a story " * 40).strip()),
    ("<body><form id=aspnet><nav>Menu</nav><p>" + "in a form " * 30 + "</p><div class=comments><p>" + "a comment " * 50 + "</div></form>", ("in a form " * 30).strip()),
    ("<body><div class='post related-content'><p>" + "the story " * 30 + "</p></div><div>x</div>", ("the story " * 30).strip() + "\n\nx"),
    ("<div class=wrap><article><p>" + "first part " * 49 + "</article><div class=story><p>" + "second part " * 17 + "</div></div>", ("first part " * 49).strip() + "\n\n" + ("second part " * 17).strip()),
    ("<body><header>Site</header><article><header><h1>Title</h1><span>by A</span></header><p>" + "body text " * 20 + "</article>", "Title\n\n" + ("body text " * 20).strip()),
    ("<body><article><p>Short.</article><div class=related-content><p>" + "elsewhere " * 60 + "</div><div class=sidebar><p>" + "aside " * 90 + "</div>", "Short."),
    ("<body><div class=sidebar><p>" + "all there is " * 30 + "</div>", ("all there is " * 30).strip()),
])
def test_html_reads_tags_as_browsers_do(spark, source, want):
    assert texts_of(spark, ("http://h/1", source)) == {0: want}


def test_html_host_votes_change_a_page(spark):
    page = lambda story, box: f"<body><div class='c{len(story)} text'><p>{story}</p></div><div class=zone>{box}</div></body>"
    same = [("http://a.org/x", f"<body><main><p>{'story ' * 50}</p></main><div class=zone1><a href=/>links only</a></div></body>")] * 4
    odd = ("http://A.org/y", f"<body><main><p>{'short ' * 20}</p></main><div class=zone1><p>{'unmarked box ' * 8}</p></div></body>")
    got = texts_of(spark, *same, odd)
    alone = texts_of(spark, odd)
    assert got[4] == ("short " * 20).strip() and alone[0] != got[4]
    # A page that has nearly all its text elsewhere keeps its own.
    other = ("http://a.org/z", f"<body><main>Menu</main><div class=old><p>{'the whole article ' * 40}</p></div></body>")
    assert texts_of(spark, *same, other)[4].endswith(("the whole article " * 40).strip())


def test_html_rows(spark):
    given = [("http://h/1", "<p>x")] * 3 + [(None, "<p>y"), (None, None), ("http://h/2", "")]
    pages = pages_of(spark, *given).selectExpr("if(page_id = 1, null, page_id) page_id", "url", "html", "1 host", "2 path", "3 blocks", "4 best")
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(pages).collect()), key=str) == sorted([(0, "http://h/1", "x", 1), (None, "http://h/1", "x", 1), (2, "http://h/1", "x", 1), (3, None, "y", 1), (4, None, "", 0), (5, "http://h/2", "", 0)], key=str)


class Plain(HTMLParser):
    """The article's blocks of the given pages, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.run, self.inside = [], "", False

    def flush(self):
        if text := " ".join(self.run.split()):
            self.out.append(text)
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1"):
            self.flush()
        self.inside = self.inside or tag == "article"
        self.run += " " * (tag == "br")

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1"):
            self.flush()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.run += data if self.inside else ""


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_html_equals_a_plain_extractor(spark, size):
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        assert got[r.page_id] == "\n\n".join(plain.out)


def brute_windows(sizes, docs, idf):
    """Greedy filling by BM25 scores over plain dictionaries; docs: {term: count} of each rest."""
    lengths = [sum(d.values()) for d in docs]
    mean = sum(lengths) / len(lengths)

    def score(query, d):
        return sum(idf[t] * docs[d][t] * 2.2 / (docs[d][t] + 1.2 * (0.25 + 0.75 * lengths[d] / mean)) for t in query if t in docs[d])

    left, out = set(range(len(sizes))), []
    longest = lambda room: min((i for i in left if sizes[i] <= room), key=lambda i: (-sizes[i], i), default=None)
    while left:
        seed = longest(packing.WINDOW)
        window, room = [seed], packing.WINDOW - sizes[seed]
        left.remove(seed)
        near = sorted((d for d in left if sizes[d] <= room and score(docs[seed], d) > 0), key=lambda d: -score(docs[seed], d))
        for d in near:
            if sizes[d] <= room:
                window.append(d)
                left.remove(d)
                room -= sizes[d]
        while (i := longest(room)) is not None:
            window.append(i)
            left.remove(i)
            room -= sizes[i]
        out.append(window)
    return out


def test_packing_fills_windows_with_neighbours():
    r = np.random.default_rng(6)
    idf = r.random(packing.BUCKETS).astype(np.float32) + 0.1
    docs = [{int(t): int(c) for t, c in zip(r.choice(300, int(r.integers(0, 40)), replace=False) * 7, r.integers(1, 400, 40), strict=False)} for _ in range(120)]
    sizes = np.array([int(x) for x in r.integers(1, 700, 120)])
    terms = [np.array(sorted(d), "<u4") for d in docs]
    counts = [np.array([d[t] for t in sorted(d)]) for d in docs]
    assert packing.fill(sizes, terms, counts, idf) == brute_windows(sizes.tolist(), docs, idf)
    assert packing.fill(sizes[:0], [], [], idf) == []


def test_packing_counts_have_no_cap(spark):
    docs = spark.createDataFrame([(1, "word " * 70_000 + "once twice twice"), (2, "x"), (3, None)], "doc_id long, text string")
    for r in packing.tokenise(docs).collect():
        found = packing.counts_of(bytes(r.counts), len(r.terms) // 4)
        assert sorted(found) == {1: [1, 1, 2, 69_999], 2: [1], 3: []}[r.doc_id]


def test_packing_deals_similar_documents_to_one_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    r = np.random.default_rng(8)
    texts = []
    for g in range(60):
        own = [f"topic{g}x{i}" for i in range(30)]
        texts += [" ".join(r.choice(own, 24, replace=False).tolist() + [f"w{x}" for x in r.integers(0, 50, 30)]) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = packing.tokenise(docs)
    df = packing.frequencies(tokens)
    idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)).astype(np.float32)
    rows = {x.doc_id: (x.h0, x.h1) for x in packing.keyed(tokens, idf).collect()}
    shard = {i: at // 40 for at, i in enumerate(sorted(rows, key=lambda i: rows[i]))}
    meet = np.mean([shard[a] == shard[b] for g in range(60) for a in range(8 * g, 8 * g + 8) for b in range(8 * g, a)])
    assert meet > 0.35  # a twelfth, were documents dealt at random
    got = packing.pack(docs).collect()
    assert sorted(x.doc_id for x in got) == sorted(rows)


@pytest.mark.parametrize("depth", [1, 3, 4, 10])
def test_suffix_arrays_and_their_search(depth):
    r = np.random.default_rng(depth)
    lengths = [0, 7, 1, 40, 0, 25, 3]
    h = r.integers(1, 4, sum(lengths)).astype(np.uint64)
    starts = np.append(0, np.cumsum(lengths))
    ends = starts[1:][np.repeat(np.arange(len(lengths)), lengths)]
    array = decontamination.suffix_array(h, ends, depth)
    suffix = lambda p, n: tuple(h[p : min(ends[p], p + n)].tolist())
    found = [suffix(p, depth) for p in array]
    assert sorted(array.tolist()) == list(range(len(h))) and found == sorted(found)
    keys = r.integers(1, 5, (60, depth)).astype(np.uint64)
    low, high = decontamination.ranges(h, ends, array, keys)
    for key, a, b in zip(keys, low, high, strict=True):
        assert sorted(array[a:b].tolist()) == [p for p in range(len(h)) if suffix(p, depth) == tuple(key.tolist())]


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (None, None, 6)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.scan(docs.where("false"), bench).count() == 0 and decontamination.remove(docs.where("false"), bench).count() == 0
    none = bench.where("false")
    assert [(r.n_hit, r.longest) for r in decontamination.scan(docs, none).collect()] == [(0, 0), (0, 0)]
    assert decontamination.remove(docs, none).count() == 2 and [tuple(r) for r in decontamination.remove(docs, bench).collect()] == [(None, None, 6)]
