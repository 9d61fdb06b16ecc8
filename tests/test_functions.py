import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colophon.functions import annotation, arrays, hashing, text
from colophon.operators import annotate, classify, dedup, naming, registry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "slug"), [("  Hello,  World_again! ", "hello-world-again"), ("Café — déjà vu", "café-déjà-vu"), ("!!!", "image"), ("", "image"), ("a--b___c", "a-b-c"), ("x" * 79 + " y", "x" * 79)])
def test_slug(spark, given, slug):
    assert one(spark, text.slugify(F.lit(given))) == slug


@pytest.mark.parametrize(("title", "name", "status", "out"), [("Red Fox", "IMG.TIF", "READY", "red-fox.jpg"), ("", "IMG_1.TIF", "DUPLICATE", "img-1.tif")])
def test_final_name(spark, title, name, status, out):
    assert one(spark, text.final_name(F.lit(title), F.lit(name), F.lit(status))) == out


@pytest.mark.parametrize(
    ("words", "out"),
    [(["Tree", "trees", "tree"], ["Tree"]), (["cats", "Cat"], ["cats"]), (["gas", "ga"], ["gas"]), (["boxes", "box"], ["boxes", "box"]), (["bus", "bu"], ["bus"]), (["bu", "bus"], ["bu", "bus"]), (["a", " TREE "], ["TREE"]), ([f"w{i}x" for i in range(60)], [f"w{i}x" for i in range(50)])],
)
def test_keywords(spark, words, out):
    assert one(spark, arrays.clean_keywords(F.array(*[F.lit(w) for w in words]))) == out


@pytest.mark.parametrize(
    ("message", "kind", "wait"),
    [("RESOURCE_EXHAUSTED retry in 12.5 s", "rate_limit", 12.5), ("RESOURCE_EXHAUSTED 'retryDelay': '7s'", "rate_limit", 7.0), ("RESOURCE_EXHAUSTED Requests Per Day", "quota", None), ("503 UNAVAILABLE", "overload", 20.0), ("bad json", "generic", 6.0), ("RESOURCE_EXHAUSTED retry in 0s", "rate_limit", 30.0)],
)
def test_retry(spark, message, kind, wait):
    m = F.lit(message)
    assert one(spark, text.error_kind(m)) == kind
    assert one(spark, text.backoff(text.error_kind(m), text.retry_hint(m), F.lit(2.0))) == wait


@pytest.mark.parametrize(
    ("score", "risk", "people", "prop", "mark", "status"),
    [(95, "Low", 0, 0, 1, "LOW_QUALITY"), (59, "Low", 1, 0, 0, "LOW_QUALITY"), (60, "High", 1, 0, 0, "NEEDS_RELEASE"), (60, "Low", 0, 1, 0, "NEEDS_RELEASE"), (60, "Medium", 0, 0, 0, "REVIEW"), (60, "Low", 0, 0, 0, "READY"), (60, "medium", 0, 0, 0, "READY"), (250, "Unknown", 0, 0, 0, "READY")],
)
def test_status(spark, score, risk, people, prop, mark, status):
    flags = [F.lit(bool(x)) for x in (people, prop, mark)]
    s = classify.choose_status(F.lit(score), F.lit(risk), *flags)
    assert one(spark, s) == status
    assert one(spark, classify.explain_status(s, F.lit(score), F.lit(risk), F.lit(" "), flags[2]))


@pytest.mark.parametrize(("status", "attempts", "out"), [(None, None, True), ("READY", 0, False), ("ERROR_PERMANENT", 3, False), ("ERROR", 2, True), ("ERROR", 3, False), ("ERROR", None, True), ("error", 0, True)])
def test_pending(spark, status, attempts, out):
    assert one(spark, registry.is_pending(F.lit(status).cast("string"), F.lit(attempts).cast("int"))) is out


def test_unique_names(spark):
    rows = [(i, "d", n) for i, n in enumerate(["a.jpg", "a.jpg", "a-2.jpg", "a.jpg"])]
    out = naming.unique_exact(spark.createDataFrame(rows, "ord int, g string, name string"), "g", "name", "ord").orderBy("ord").collect()
    assert [r.unique_name for r in out] == ["a.jpg", "a-2.jpg", "a-2-2.jpg", "a-3.jpg"]


def test_near(spark):
    rows = [(0, "A", 0), (1, "B", 0x3F), (2, "C", 0x7F), (3, "D", None), (4, "E", 0x7F)]
    out = dedup.near(spark.createDataFrame(rows, "ord int, name string, bits long"), "bits", "ord", "name").collect()
    assert {r.ord: r.near_duplicate_of for r in out} == {0: None, 1: "A", 2: "B", 4: "B"}


def test_hamming_and_hash(spark):
    assert one(spark, hashing.hamming64(hashing.from_hex(F.lit("f" * 16)), F.lit(0).cast("long"))) == 64
    assert one(spark, hashing.from_hex(F.lit("xyz"))) is None
    assert len(hashing.phash(np.random.default_rng(0).random((32, 32)))) == 16


@pytest.mark.parametrize(
    ("change", "error"),
    [("", None), ('"category": 1, ', None), ('"commercial_score": 87.5, ', None), ('"commercial_score": null, ', "score is no integer"), ('"rejection_reason": null, ', "reason is no text"), ('"keywords": [], ', "keywords empty or not a list")],
)
def test_annotation(spark, change, error):
    base = {"title": '"T"', "description": '"d"', "keywords": '["a"]', "category": '"Nature"', "commercial_score": "87.9", "rejection_risk": '"Low"', "people_visible": '"false"'}
    if change:
        k, v = change.rstrip(", ").split(": ", 1)
        base[k.strip('"')] = v
    raw = "```json\n{" + ", ".join(f'"{k}": {v}' for k, v in base.items()) + "}\n```"
    row = annotation.parse(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert row.parse_error == error
    assert row.people_visible is True
    if not change:
        assert row.score == 87 and row.title == "T"


def test_annotation_rejects(spark):
    rows = [('{"title": 1} x',), ('{"title": "a"}',), (None,), ("",)]
    out = annotation.parse(spark.createDataFrame(rows, "raw string"), "raw").collect()
    assert [r.parse_error[:7] for r in out] == ["not a J", "missing", "not a J", "not a J"]


_VALUES = ["1", "-0", "1.50", "01", "1.", "1E2", "NaN", "Infinity", "-Infinity", "+Infinity", "INF", "tru", "true", "null", '"a"', '"INF +I"', '"a\\u00e9\\"b"', '"\\x"', '"a\tb"', "'a'", "[]", "[1, {}]", "[1,]", "{}", '{"a": 1}', '{"a" 1}', ""]
_BEFORE = ["", " \n", "\ufeff", "\x0c", "x", "[", "//\n"]
_AFTER = ["", "\n ", " x", "}", "}} x", "]", "] x", ', {"k": 1}', ', "value": {"k": 1}', '}, "value": {"k": 1}', '], "value": [{"k": 1}]} x', '], "value": [{}', "/**/", "\x00", ","]


def test_strict_object_as_a_strict_parser(spark):
    """Every value, also under an unread key and repeated, with every beginning and end, is taken or refused as json.loads does it."""
    bodies = [f'{{"k": {v}}}' for v in _VALUES] + [f'{{"z": {v}, "k": 1}}' for v in _VALUES] + [f'{{"k": 0, "k": {v}}}' for v in _VALUES] + ['{"z": {"a": 1, "a": 2}}', "{k: 1}", '{"K": 1}', "1", '""', "", "{", "}"]
    given = [None, *dict.fromkeys(b + x + a for x in bodies for b in _BEFORE for a in _AFTER)]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").withColumn("v", annotation.strict_object(F.col("t"), ["k", "absent"]))
    number = F.try_variant_get(F.col("v.k"), "$", "double")
    got = rows.select("i", F.col("v").isNotNull(), F.col("v.k").isNotNull(), annotation.truthy(F.col("v.k")), number.cast("string"), annotation.missing_keys(F.col("v"), ["k", "absent"])).collect()
    assert len(got) == len(given) and sum(r[1] for r in got) > 100
    for i, held, there, true, number, missing in got:
        try:
            value = json.loads(given[i])
        except (TypeError, ValueError):
            value = None
        assert held == isinstance(value, dict), given[i]
        if held:
            k = value.get("k")
            assert (there, true, missing) == ("k" in value, bool(k), [x for x in ("k", "absent") if x not in value]), given[i]
            if isinstance(k, int | float) and not isinstance(k, bool):
                assert float(number) == k or k != k and number == "NaN", given[i]


def test_strict_object_bounds(spark):
    texts = ['{"k": {"a": 1, "a": 2}}', '{"k": ' + "[" * 1500 + "]" * 1500 + "}", '{"k": ' + "9" * 1200 + "}", '{"k": "' + "é\\n" * 300_000 + '"}']
    v = spark.createDataFrame([(t,) for t in texts], "t string").select(annotation.strict_object(F.col("t"), ["k"]).alias("v"))
    assert [n for (n,) in v.select(F.length(F.try_variant_get(F.col("v.k"), "$", "string"))).collect()] == [None, None, None, 600_000]


def test_attempts(spark):
    good = '{"title":"t","description":"","keywords":["k"],"category":"Nature","commercial_score":90,"rejection_risk":"Low"}'
    rows = [("a", 1, None, "503"), ("a", 2, good, None), ("b", 1, None, "RESOURCE_EXHAUSTED per day"), ("b", 2, good, None), ("c", 1, "{", None)]
    out = {r.name: r for r in annotate.resolve(spark.createDataFrame(rows, "name string, attempt_no int, raw_text string, error_text string")).collect()}
    assert (out["a"].outcome, out["a"].retries, out["a"].waited) == ("OK", 1, 10.0)
    assert out["b"].outcome == "QUOTA" and out["c"].outcome == "ERROR"
