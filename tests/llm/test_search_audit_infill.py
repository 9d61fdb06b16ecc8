"""Neighbour search, filter audit and fill-in-middle against brute force and SQL."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest

from colophon.llm import ann, filter_audit, infill, queries

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) > 0
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float | np.integer) else x
    rows = lambda df: sorted(str([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_fill_in_middle"])
def test_same_as_sql(spark, name):
    same_as_sql(spark, name)


# Fill-in-middle


@pytest.mark.parametrize("size", [0, 1, 2, 511, 512, 513, 1500])
@pytest.mark.parametrize("gap", [1, 3, 900])
def test_lists_give_every_number_back(size, gap):
    r = np.random.default_rng(size + gap)
    ends = np.cumsum(r.integers(1, gap + 1, size)).astype(np.int64)
    code = infill.encode(ends)
    assert [infill.select(code, k) for k in range(size + 1)] == [0, *ends.tolist()]
    assert size < 500 or len(code) < 24 + size * (3 + np.log2(gap)) / 8 + size / 30


def brute_infill(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_infill(spark, monkeypatch, hot):
    monkeypatch.setattr(infill, "HOT_ROWS", hot)
    monkeypatch.setattr(infill, "HOT_TEXTS", 10**9)
    r = random.Random(3)
    pieces = ["a", "Bc", " ", "\n", "é", "漢字", "𝒳", "1", "<", "<P", "<S", "M>", "-", "\r\n", "word"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 60))) for _ in range(120)] + [None, "", "x", "<P>", "a<M>b", "no <S> more", "é", "long word " * 30_000]
    rows = [(i if i % 17 else None, t, i, "s") for i, t in enumerate(texts)] + [(i, "copy of one", 0, "t") for i in range(1000, 1030)] + [(5, texts[5], 5, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string")
    got = infill.digest(infill.transform(docs)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_infill(i, t)) for i, t, *_ in rows)
    assert {x.form for x in got} == {"plain", "psm", "spm"}


# Filter audit


def brute_audit(docs, labels):
    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    told = {}
    for i, q, x in labels:
        a, b = told.get(i, (False, False))
        told[i] = (a or q == 1, b or x == 1)
    rows = []
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and ids[t] < i}
        rows.append((source or "", {k for k, v in fails.items() if v}, *((False, False) if i is None else told.get(i, (False, False)))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            for step in range(1, 6):
                here, before = p[step - 1], set(p[: step - 1])
                gone = [x for x in own if here in x[0] and not x[0] & before]
                total[here] += len(gone)
                out[part, "".join(p), step] = [
                    sum(not x[0] & set(p[:step]) for x in own), len(gone), sum(here in x[0] and bool(x[0] & before) for x in own), sum(x[0] == {here} for x in own),
                    sum(x[1] for x in gone), sum(x[2] for x in gone),
                ]
        for p, step in [(p, s) for p in permutations("ABCDE") for s in range(1, 6)]:
            out[part, "".join(p), step].append(total[p[step - 1]])
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("hot", [50_000, 1])
def test_audit(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT_TEXTS", 10**9)
    r = random.Random(8)
    long = " ".join(f"w{i}" for i in range(260))
    texts = [None, "", " \t\n", long, long, long + " A", "Ab " * 300, "one two", "É" * 40, long + " é#", "x\x0by\x0cz " * 90, long.upper(), long + " 𝒳 " * 5]
    docs = [(r.choice([None, *range(40)]), r.choice(texts), r.choice([None, "", "a", "b"])) for _ in range(150)]
    labels = [(i, r.choice([None, 0, 1]), r.choice([None, 0, 1])) for i in range(30)] + [(3, 1, None), (3, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id long, text string, source string, fails int, good boolean")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    copies = filter_audit.copies
    monkeypatch.setattr(filter_audit, "copies", lambda d, key, order: copies(d, key, order, hot))
    assert {tuple(x) for x in filter_audit.audit(frame, told).collect()} == brute_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), told).count() == 0


# Neighbours


def brute_nearest(rows, k=20, step=20):
    """{query: [(id, score)]} of rows (id, vector), all usable and of one length; ids are distinct."""
    out = {}
    for i, v in rows:
        if i % step == 0:
            near = []
            for j, x in rows:
                score = 0.0
                for a, b in zip(v, x, strict=True):
                    score += a * b
                if j != i:
                    near.append((-score, j))
            out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r["rank"] == len(own)
    return out


def test_probes_retrieve_every_code_within_the_radius():
    r = np.random.default_rng(1)
    codes = r.integers(0, 1 << 63, 700, dtype=np.uint64)
    asked = np.concatenate([codes[:40] ^ (np.uint64(1) << np.uint64(5)), codes[:40] ^ np.uint64(0x8181008100810001), r.integers(0, 1 << 63, 40, dtype=np.uint64)])
    table = ann.substring_index(codes)
    for radius in (0, 1, 2, 7, 8, 9, 13, 24, 31, 64):
        want = np.bitwise_count(asked[:, None] ^ codes) <= radius
        assert (ann.retrieved(asked, codes, ann.probes(table, radius), radius) == want).all()


@pytest.mark.parametrize("dim", [3, 24, 90])
def test_neighbours_of_awkward_rows(spark, monkeypatch, dim):
    """With the full radius and many strips and blocks, the answers are exact: hot vectors, ties, lengths and broken rows."""
    for name, value in (("STRIP", 40), ("BLOCK", 3), ("learned_radius", lambda *_: 64)):
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(dim)
    good = [(i, [float(x) for x in r.standard_normal(dim) * r.choice([0.1, 1, 9])]) for i in range(-40, 130)] + [(i, [1.0] * dim) for i in range(200, 280)]
    bad = [(300, None), (320, []), (340, [0.0] * dim), (360, [None] + [1.0] * (dim - 1)), (380, [float("nan")] * dim), (400, [float("inf")] * dim), (420, [1.0] * (dim + 1)), (None, [1.0] * dim), good[7], good[-1]]
    table = spark.createDataFrame([(i, v, 7, "x") for i, v in good + bad], "vec_id long, embedding array<double>, code int, digest string")
    assert found(ann.search(table)) == brute_nearest(good)


def test_short_answers_are_made_whole(spark, monkeypatch):
    monkeypatch.setattr(ann, "learned_radius", lambda *_: 0)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.standard_normal(8)]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(ann.search(table)) == brute_nearest(rows)
    assert found(ann.search(table.where("vec_id < 5"))) == brute_nearest(rows[:5])
    for nothing in (table.limit(0), table.where("vec_id = 0"), table.where("vec_id in (1, 2)")):
        assert ann.search(nothing).count() == 0


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = found(queries.QUERIES["op11_multi_index_hashing"](spark, "/root/testdata/sf0.1"))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]].tolist()) & {j for j, _ in got[ids[i]]})
    assert hits / (20 * len(got)) >= 0.95 and len(got) == (ids % 20 == 0).sum()
