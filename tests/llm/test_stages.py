"""The pipeline's stages, each on its own input, and the classifier through Spark."""

import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute
from test_whole_llm_jobs import brute_clean

import corpus_pipeline
from colophon.llm import classifier, html, likelihood, packing, sharding, urls

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, _head long, _class int, row int"


def sentence(r, n, words=400):
    out = " ".join(f"w{int(x)}" for x in r.integers(0, words, n))
    return out + "."


def table(spark):
    """Documents with nulls, repeats, a very long text, benchmark passages, and columns whose names the operators use."""
    r = np.random.default_rng(5)
    bench = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if x.text]
    good = ["\n".join(sentence(r, 20, 4000) for _ in range(6)) for _ in range(12)]
    texts = [None, "", " \n", "short.", *good, good[0], good[1] + " end.", sentence(r, 60_000, 10**6), good[2] + "\n" + bench[0] + ".", "spam " * 200, good[3]]
    ids = [i if i % 5 else None for i in range(len(texts))]
    ids[7] = ids[8] = 3
    return [(d, t, "en", "s", len(t or ""), 1, "k", 2, 3, i) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]


def network(stage_docs, spark):
    return classifier.train(stage_docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_stages_on_awkward_rows(spark):
    rows = table(spark)
    docs = spark.createDataFrame(rows, COLUMNS)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r.row: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        after = {r.row: r.text for r in out.collect()}
        assert len(after) == out.count()
        if number == 0:
            assert after == {i: c for i, t in before.items() if (c := brute_clean(t)) is not None}
        elif number == 1:
            net = network(docs, spark)
            p = lambda t: net.forward(*classifier.lay_out(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))[0][0]
            assert after == {i: t for i, t in before.items() if p(t) >= classifier.THRESHOLD}
            # The stages behind are tested on all that the first one keeps.
            out = docs
        elif number == 2:
            groups = {}
            for i, (_, root) in brute.components(before, 5, 80).items():
                groups.setdefault(root, set()).add(i)
            assert len(after) == len(groups) and all(len(g & set(after)) == 1 for g in groups.values())
        else:
            assert after == {i: t for i, t in before.items() if not brute.hits(t, bench)[1]} and len(after) < len(before)
        docs = spark.createDataFrame(out.collect(), COLUMNS)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert len({(r.doc_id, r.ids_crc32) for r in packed if r.start == 0}) == len({(r.doc_id, r.text) for r in docs.collect()})
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= packing.WINDOW


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_score(net, text):
    """The network's probability from its definition, position by position."""
    raw = list((text or "").encode())
    n = max(1, -(-len(raw) // classifier.STRIDE))
    byte = lambda i: raw[i] if i < len(raw) else classifier.PAD
    response = np.array([sum(net.w["taps"][j][byte(classifier.STRIDE * p + j)] for j in range(classifier.WIDTH)) for p in range(n)])
    halves = [response[a : a + classifier.HALF].max(0) for a in range(0, n, classifier.HALF)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:], strict=False)] or halves
    hidden = [np.tanh(np.maximum(c + net.w["shift"], 0) @ net.w["dense"] + net.w["lean"]) for c in chunks]
    return 1 / (1 + np.exp(-(np.mean(hidden, axis=0) @ net.w["out"] + net.w["base"][0])))


def test_classifier_through_spark(spark):
    net = classifier.Network()
    net.w["out"] = np.random.default_rng(1).normal(0, 1, classifier.HIDDEN).astype(np.float32)
    r = np.random.default_rng(2)
    texts = [None, "", "a", "Ünï 漢", "x" * 511, "x" * 512, "x" * 513, sentence(r, 400), sentence(r, 9000), "a", "a"]
    docs = spark.createDataFrame([(i if i != 2 else None, t, 7.0, 1, "q") for i, t in enumerate(texts)], "doc_id long, text string, score double, predicted int, quality string")
    got = sorted(classifier.score(docs, net).collect(), key=lambda x: 2 if x.doc_id is None else x.doc_id)
    for i, (row, text) in enumerate(zip(got, texts, strict=True)):
        assert abs(row.score - brute_score(net, text)) < 1e-5 and row.predicted == (row.score >= classifier.THRESHOLD)
        assert row.held_out == (i != 2 and zlib.crc32(str(i).encode()) % 5 == 0)
    kept = classifier.apply(docs, net, threshold=sorted(x.score for x in got)[5])
    assert kept.schema == docs.schema and 0 < kept.count() < len(texts)
    assert classifier.score(docs.where("false"), net).count() == 0
    none = classifier.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {x.score for x in classifier.score(docs, none).collect()} == {0.5}


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c.", 0, "x", 2), (1, "a b c.", 0, "x", 2), (None, None, 0, "x", 2)], "doc_id long, text string, size int, place string, n_tokens int")
    assert sorted(r.slot for r in sharding.assign(docs, 1).collect()) == [0, 1, 2]
    assert sorted((r.n_tokens, r.log_likelihood < 0) for r in likelihood.score(docs).collect()) == [(0, False), (3, True), (3, True)]
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "<p>x", "h")] * 2, "page_id long, url string, html string, host string")
    assert [r.verdict for r in urls.judge(pages).collect()] == ["block"] * 2 and [r.text for r in html.extract(pages).collect()] == ["x"] * 2


def test_url_cascades_are_exact_over_their_universe(spark):
    r = np.random.default_rng(9)
    keys = [f"h{int(x)}.org/p{int(y)}" for x, y in r.integers(0, 60, (4000, 2))]
    universe = spark.createDataFrame([(k,) for k in set(keys)], "key string")
    listed = sorted(set(keys))[::17]
    cascade = urls.Cascade(universe, listed)
    found = {x.key for x in universe.where(cascade.contains(universe.key)).collect()}
    assert found == set(listed) and len(cascade.levels) > 1
    assert universe.where(urls.Cascade(universe, []).contains(universe.key)).count() == 0


def test_sketches_fold_without_raising_distances():
    from colophon.llm import jaccard

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 900, 1100, 5000)]
    sets += [np.unique(np.append(sets[4][:4800], r.integers(0, 1 << 63, 150).astype(np.uint64)))]
    begins = np.append(0, np.cumsum([len(s) for s in sets]))
    flat, at = jaccard.folded(np.concatenate(sets), begins)
    assert np.diff(at).tolist() == [16, 16, 16, 32, 128, 128]
    folds = pa.chunked_array([pa.array([flat[at[i] : at[i + 1]].tolist() for i in range(6)], pa.list_(pa.int64()))])
    rows = jaccard.stacked(folds)
    for i in range(6):
        for j in range(6):
            assert np.bitwise_count(rows[i] ^ rows[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))


@pytest.mark.parametrize("master", ["yarn", "spark://host:1", "local-cluster[2,1,500]"])
def test_no_temporary_folder_on_clusters(master):
    from types import SimpleNamespace

    from colophon.llm.common import shared_dir

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(away)
