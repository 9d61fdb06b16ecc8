"""A whole run over pictures, and its parts: provider, files, writers, registry, incremental runs."""

import csv
import json
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from colophon.__main__ import main
from colophon.config import SUMMARY_COLUMNS, Settings
from colophon.functions import hashing, text
from colophon.operators import annotate, dedup, provider, registry, report
from colophon.plans.run import FOLDERS, run
from colophon.sources import effects, files, images, ledger, sinks
from colophon.streaming import incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
GOOD = {"title": "Red Fox, at Dawn", "description": "A fox", "keywords": ["fox", "foxs", "dawn"], "category": "Nature", "category2": "Nature", "commercial_score": 90, "rejection_risk": "Low"}


class Answers:
    """A provider with an answer, or an exception, for each name."""

    def __init__(self, answers):
        self.answers = answers

    def annotate(self, name, image):
        answer = self.answers[name]
        if isinstance(answer, str) and answer.startswith("!"):
            raise RuntimeError(answer[1:])
        return answer if isinstance(answer, str) else json.dumps(answer)


def picture(spark, path, seed, width, height, kind="png"):
    """Smooth random colours, written by the JVM."""
    awt = spark._jvm.java.awt.image.BufferedImage
    small, large = awt(8, 8, awt.TYPE_INT_RGB), awt(width, height, awt.TYPE_INT_RGB)
    r = np.random.default_rng(seed)
    for x in range(8):
        for y in range(8):
            small.setRGB(x, y, int(r.integers(0, 1 << 24)))
    pen = large.createGraphics()
    pen.drawImage(small, 0, 0, width, height, None)
    pen.dispose()
    spark._jvm.javax.imageio.ImageIO.write(large, kind, spark._jvm.java.io.File(str(path)))


def test_whole_run(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, name in enumerate(["a.jpg", "_b.jpg", "c.png", "d.JPG", "e.jpg", "z.jpg"]):
        picture(spark, folder / name, i, *((200, 150) if name == "d.JPG" else (2100, 2000)), "png" if name == "c.png" else "jpg")
    (folder / "a-copy.jpg").write_bytes((folder / "a.jpg").read_bytes())
    (folder / "broken.jpg").write_bytes(b"not a picture")
    (folder / "notes.txt").write_text("x")
    answers = {"_b.jpg": GOOD | {"people_visible": True, "category": "Bogus"}, "a-copy.jpg": GOOD, "c.png": GOOD, "e.jpg": "!bad luck", "z.jpg": "!RESOURCE_EXHAUSTED: per day"}
    settings = Settings(pause_seconds=0, call_attempts=1)
    got = run(spark, str(folder), lambda: Answers(answers), settings)
    assert list(got) == SUMMARY_COLUMNS
    counts = {k: got[k] for k in ("processed_this_run", "ready_to_upload", "low_res", "duplicates", "needs_release", "errors", "remaining", "api_hard_failures", "stopped_on_daily_quota")}
    # The file that can't be decoded has no size and fails like a call.
    assert counts == {"processed_this_run": 7, "ready_to_upload": 2, "low_res": 1, "duplicates": 1, "needs_release": 1, "errors": 2, "remaining": 3, "api_hard_failures": 2, "stopped_on_daily_quota": True}
    there = {d: sorted(os.listdir(folder / d)) for d in FOLDERS[:-1]}
    assert there == {
        "00_SOURCE_ORIGINALS": ["c.png"], "01_READY_UPLOAD": ["red-fox-at-dawn-2.jpg", "red-fox-at-dawn.jpg"], "02_SKIPPED_LOWRES": ["d.jpg"], "03_SKIPPED_LOWQUALITY": [],
        "04_DUPLICATES": ["a.jpg"], "05_NEEDS_RELEASE": ["red-fox-at-dawn.jpg"], "06_REVIEW": [],
    }
    assert (folder / "01_READY_UPLOAD/red-fox-at-dawn-2.jpg").read_bytes()[:2] == b"\xff\xd8"
    reports = folder / "Reports"
    rows = list(csv.reader((reports / "upload.csv").open(newline="")))
    assert rows == [["Filename", "Description", "Keywords", "Categories"], ["red-fox-at-dawn.jpg", "Red Fox, at Dawn", "fox, dawn", "Nature"], ["red-fox-at-dawn-2.jpg", "Red Fox, at Dawn", "fox, dawn", "Nature"]]
    document = json.loads((reports / "report.json").read_text())
    assert list(document) == ["summary", "items"] and len(document["items"]) == 7 and "score" not in document["items"][2]
    assert document["summary"]["average_commercial_score"] == 90.0 and document["summary"]["category_distribution"] == {"Nature": 2}
    assert len((reports / "report.csv").read_bytes().split(b"\r\n")) == 9
    log = (reports / "needs_review.txt").read_text().split("\n")
    assert any(x.startswith("BAD CATEGORY | _b.jpg") for x in log) and "NOTE | c.png | prepared for upload" in log and log[-2].startswith("QUOTA | z.jpg")
    # The next run has what failed and what the quota left; earlier results stay.
    again = run(spark, str(folder), lambda: Answers(answers | {"z.jpg": GOOD, "e.jpg": GOOD | {"commercial_score": 10}}), settings)
    assert (again["processed_this_run"], again["ready_to_upload"], again["low_quality"], again["remaining"]) == (3, 1, 1, 1)
    assert sorted(os.listdir(folder / "01_READY_UPLOAD")) == ["red-fox-at-dawn-2.jpg", "red-fox-at-dawn-3.jpg", "red-fox-at-dawn.jpg"]
    assert len(list(csv.reader((reports / "upload.csv").open(newline="")))) == 4
    assert report.console(again).startswith("Run finished")


def test_probe_and_phash(spark, tmp_path):
    for name, seed, side in (("_a.png", 1, 400), ("b.jpg", 1, 300), ("c.png", 2, 300)):
        picture(spark, tmp_path / name, seed, side, side, name[-3:])
    (tmp_path / "d.jpg").write_bytes(b"x")
    rows = {r.name: r for r in images.probe(spark, images.view(str(tmp_path), ["_a.png", "b.jpg", "c.png", "d.jpg"], str(tmp_path / "v"))).collect()}
    assert (rows["_a.png"].width, rows["d.jpg"].width, rows["d.jpg"].phash) == (400, None, None)
    apart = lambda a, b: (int(rows[a].phash, 16) ^ int(rows[b].phash, 16)).bit_count()
    assert apart("_a.png", "b.jpg") <= 6 < apart("b.jpg", "c.png")


def test_shrink_keeps_levels():
    grey = hashing.to_grey(bytes([10, 20, 30] * 50 * 40), 50, 40, 3)
    assert set(grey.ravel()) == {(19595 * 30 + 38470 * 20 + 7471 * 10 + 32768) >> 16}
    assert set(hashing.shrink(grey, 32).ravel()) == {float(grey[0, 0])}
    ramp = np.tile(np.arange(64, dtype=np.uint8) * 4, (64, 1))
    assert (np.diff(hashing.shrink(ramp, 32)[0]) > 0).all()


def test_normalise_steps():
    tried = []

    def encode(content, scale, quality, sharpen):
        tried.append((scale, quality, sharpen))
        return b"x" * int(1000 * quality / 92 * scale**2)

    assert images.normalise(b"x" * 10, "a.jpg", 10, encode) is None and not tried
    assert len(images.normalise(b"x" * 10, "a.PNG", 900, encode)) <= 900 and tried == [(1.0, 92, False), (1.0, 82, False)]
    tried.clear()
    images.normalise(b"x" * 500, "a.jpg", 300, encode)
    assert tried == [(1.0, q, False) for q in (92, 82, 72, 62, 52)] + [(x, 75, True) for x in (0.9, 0.8, 0.7, 0.6)]
    tried.clear()
    assert len(images.normalise(b"x" * 500, "a.jpg", 3, encode)) > 3 and tried[-1] == (0.4, 75, True) and len(tried) == 11


def test_codec(spark, tmp_path):
    picture(spark, tmp_path / "a.png", 3, 1600, 800)
    content, codec = (tmp_path / "a.png").read_bytes(), images.JvmCodec(spark)
    for name, data in (("fit.jpg", codec.fit(content)), ("small.jpg", codec.encode(content, 0.5, 75, True))):
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.width, r.height) for r in images.probe(spark, images.view(str(tmp_path), ["fit.jpg", "small.jpg"], str(tmp_path / "v"))).collect()}
    assert got == {"fit.jpg": (1024, 512), "small.jpg": (800, 400)}
    assert len(codec.encode(content, quality=52)) < len(codec.encode(content, quality=92))


def test_calls_wait_and_stop():
    waits = []
    say = lambda *answers: type("P", (), {"annotate": lambda self, n, i, left=iter(answers): Answers({n: next(left)}).annotate(n, i)})()
    go = lambda p, tries=5: [x[1:] for x in provider.call(p, "n", b"", tries, waits.append, lambda a, b: 0.0)]
    good = json.dumps(GOOD)
    assert go(say("!503", "!503", "!resource_exhausted retry in 12.5 s", "{", good))[-1] == (5, good, None) and waits == [10.0, 20.0, 12.5, 12.0]
    waits.clear()
    assert len(go(say("!RESOURCE_EXHAUSTED Requests Per Day", good))) == 1 and not waits
    assert len(go(say("!503 retry in 1.2.3 s", good))) == 1 and not waits
    assert len(go(say(*["!x"] * 5))) == 5 and waits == [3.0, 6.0, 9.0, 12.0]
    waits.clear()
    go(say("!429: no", "! 429 retry in 0 s", "!503 'retryDelay' : '7 s'", good))
    assert waits == [3.0, 30.0, 7.0]


def test_attempts_stop_at_quota(spark):
    items = spark.createDataFrame([(i, n, b"x") for i, n in enumerate("cab")], "ord int, name string, image binary")
    answers = {"c": GOOD, "a": "!resource_exhausted perday", "b": GOOD}
    got = provider.attempts(items, lambda: Answers(answers), Settings(pause_seconds=0)).collect()
    assert [(r.name, r.error_text) for r in got] == [("c", None), ("a", "resource_exhausted perday")]


HINTS = ["retry in 12.5 s", "RETRY IN 3s now", "retryDelay: 7s", "retryDelay : '7 s'", "'retryDelay' :  \"2.5s\"", "retry in 1.2.3 s", "retry in 1.2.3 s retryDelay: 4s", "none", "retryDelay: .5s", "retryDelay: 4s, retry in 9 s"]


def test_hints_agree(spark):
    rows = spark.createDataFrame([(m,) for m in HINTS], "m string").select("m", text.retry_hint(F.col("m")).alias("s"), text.unreadable_hint(F.col("m")).alias("bad")).collect()
    for r in rows:
        try:
            assert (provider.hint_of(r.m), False) == (r.s, r.bad)
        except ValueError:
            assert (r.s, r.bad) == (None, True)
    assert [r.s for r in rows] == [12.5, 3, 7, 7, 2.5, None, None, None, None, 9]


def test_unreadable_hint_ends_an_item(spark):
    rows = [("a", 1, None, "503 retry in 1.2.3 s"), ("a", 2, json.dumps(GOOD), None)]
    r = annotate.resolve(spark.createDataFrame(rows, provider.ATTEMPTS)).first()
    assert (r.outcome, r.retries, r.failures, r.raw) == ("ERROR", 0, 0, None)


def test_text_helpers(spark):
    rows = spark.createDataFrame([("a \n\n",), ("b  ",), ("\n",), ("c\nd\n",)], "t string").select(text.trim_lines(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["a ", "b  ", "", "c\nd"]
    waits = spark.range(50).select(text.jitter(F.lit("rate_limit"), 1).alias("a"), text.jitter(F.lit("overload"), 1).alias("b"), text.jitter(F.lit("generic"), 1).alias("c")).collect()
    assert all(0 <= r.a < 3 and 0 <= r.b < 5 and r.c == 0 for r in waits)


def test_log_and_upload_append(spark, tmp_path):
    base = f"file://{tmp_path}"
    for number, line in ((1, "one \n"), (2, "two"), (2, "two again")):
        sinks.write_log(spark.createDataFrame([(2, 0, "last"), (1, 1, line)], "ord int, seq int, line string"), f"{base}/log", number)
        row = spark.createDataFrame([(1, "READY", f"f{number}.jpg", 'a "quoted", title', ["k", "l"], "C", "")], "ord int, status string, final_name string, title string, keywords array<string>, category string, category2 string")
        sinks.write_upload(row, f"{base}/up", number)
    sinks.export_log(spark, f"{base}/log", f"{base}/log.txt")
    assert (tmp_path / "log.txt").read_text() == "one \nlast\ntwo again\nlast\n"
    sinks.export_upload(spark, f"{base}/up", f"{base}/up.csv")
    assert (tmp_path / "up.csv").read_bytes() == b'Filename,Description,Keywords,Categories\r\nf1.jpg,"a ""quoted"", title","k, l",C\r\nf2.jpg,"a ""quoted"", title","k, l",C\r\n'
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["log", "log.txt", "up", "up.csv"]


def test_failed_items_are_retried_without_new_files(spark, tmp_path):
    folder, base = f"{tmp_path}/in", f"file://{tmp_path}/registry"
    spark.createDataFrame([("a",), ("b",)], "name string").write.parquet(folder)
    seen = []

    def process(new, again):
        seen.append((sorted(r.name for r in new.collect()), sorted(r.name for r in again.collect())))
        before = again.select("name", "attempts").union(new.select("name", F.lit(0)))
        status, tries = registry.promote(F.col("attempts"))
        bad = F.col("name") == "a"
        return before.select("name", F.when(bad, status).otherwise("READY").alias("status"), F.when(bad, tries).otherwise(0).alias("attempts"))

    for _ in range(5):
        incremental.run_available(spark, folder, "name string", base, f"{tmp_path}/check", process)
    # Retried twice, then given up; nothing is processed after that.
    assert seen == [(["a", "b"], []), ([], ["a"]), ([], ["a"])]
    state = {r.name: (r.status, r.attempts) for r in ledger.read(spark, base, incremental.REGISTRY).collect()}
    assert state == {"a": ("ERROR_PERMANENT", 3), "b": ("READY", 0)}


def test_moves(tmp_path, spark):
    for n in "abc":
        (tmp_path / n).write_text(n)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/taken").write_text("other")
    plan = spark.createDataFrame([("a", "d", "x"), ("b", "d", "taken"), ("gone", "d", "y")], "original_name string, destination string, final_name string")
    for first in ("moved", "there already"):
        assert {r.original_name: r.done for r in effects.apply_moves(plan, str(tmp_path)).collect()} == {"a": first, "b": "name taken", "gone": "missing"}
    assert (tmp_path / "d/taken").read_text() == "other" and (tmp_path / "b").exists()


def test_tags_and_tool(tmp_path):
    tool = tmp_path / "tagger"
    tool.write_text('#!/bin/sh\n[ "$1" = -ver ] && exit 0\n[ "$2" = -Title=bad ] && { echo no >&2; exit 3; }\nprintf "%s\\n" "$@" > "$0.out"\n')
    tool.chmod(0o755)
    assert effects.find_tool("tagger", str(tmp_path)) == str(tool) and effects.works(str(tool)) and not effects.works(None)
    effects.embed(str(tool), "f.jpg", [("Title", "T"), ("Keywords", "a"), ("XMP-dc:Subject", "a")])
    assert (tmp_path / "tagger.out").read_text().split("\n")[:-1] == ["-overwrite_original", "-Title=T", "-Keywords+=a", "-XMP-dc:Subject+=a", "f.jpg"]
    with pytest.raises(RuntimeError, match="no"):
        effects.embed(str(tool), "f.jpg", [("Title", "bad")])


def test_command_line_says_what_is_missing(tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    for args, said in ((["/no/such"], "no such folder"), ([str(tmp_path), "--tag-tool", "none"], "tag tool"), ([str(tmp_path)], "no provider"), ([str(tmp_path), "--provider", "m:f", "--key", "NO_SUCH_KEY"], "NO_SUCH_KEY")):
        assert main(args) == 1 and said in capsys.readouterr().err
    assert sorted(os.listdir(tmp_path)) == sorted(FOLDERS)


@pytest.mark.parametrize("threshold", [0, 3, 6, 9, 20])
def test_near_against_brute_force(spark, threshold):
    r = np.random.default_rng(threshold)
    bits = [int(x) for x in r.integers(0, 1 << 63, 12)]
    for _ in range(150):
        x = bits[int(r.integers(0, len(bits)))] & (1 << 64) - 1
        for b in r.choice(64, int(r.integers(0, threshold + 3)), replace=False):
            x = (x ^ 1 << int(b)) & (1 << 64) - 1
        bits.append(x - (1 << 64) if x >= 1 << 63 else x)
    rows = [(i, f"n{i}", b if i % 17 else None) for i, b in enumerate(bits)]
    got = {x.ord: x.near_duplicate_of for x in dedup.near(spark.createDataFrame(rows, "ord int, name string, bits long"), "bits", "ord", "name", threshold).collect()}
    live = [(i, n, b) for i, n, b in rows if b is not None]
    want = {i: next((n2 for j, n2, c in live if j < i and ((b ^ c) & (1 << 64) - 1).bit_count() <= threshold), None) for i, n, b in live}
    assert got == want


def test_exact_duplicates_of_hot_and_missing_keys(spark):
    rows = [(i, f"n{i}", "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(60)]
    got = {r.ord: r.duplicate_of for r in dedup.exact(spark.createDataFrame(rows, "ord int, name string, key string"), "key", "ord", "name").collect()}
    assert got == {i: "n1" if k == "hot" and i > 1 else None for i, _, k in rows}


def test_legacy_registry_attempts(spark):
    got = files.import_registry(spark, '{"a": "error", "b": "ERROR", "c": "done"}').collect()
    assert {r.name: r.attempts for r in got} == {"a": 0, "b": 1, "c": 1}


def test_sql_functions_equal_columns(spark):
    from colophon.functions import sql
    from colophon.operators import classify

    sql.register_functions(spark)
    rows = spark.createDataFrame([(f" Hello, W{i}_x -- Ünï ", i, ["Low", "High", "medium"][i % 3], i % 2 == 0, i % 5 == 0, i % 7 == 0) for i in range(40, 90)], "t string, score int, risk string, people boolean, prop boolean, mark boolean")
    rows = rows.withColumns({"h": F.md5("t"), "status": F.element_at(F.array(F.lit("ERROR"), F.lit("READY"), F.lit("error")), F.col("score") % 3 + 1), "attempts": F.col("score") % 5})
    rows = rows.withColumn("h", F.left("h", F.lit(16)))
    flags = [F.col(c) for c in ("people", "prop", "mark")]
    want = [text.slugify(F.col("t")), classify.choose_status(F.col("score"), F.col("risk"), *flags), hashing.from_hex(F.col("h")), registry.is_pending(F.col("status"), F.col("attempts")), hashing.megapixels(F.col("score"), F.lit(7))]
    got = ["slugify(t)", "choose_status(score, risk, people, prop, mark)", "from_hex64(h)", "is_pending(status, attempts)", "megapixels(score, 7)"]
    for a, b in zip(want, got, strict=True):
        assert all(r[0] == r[1] for r in rows.select(a, F.expr(b)).collect()), b
    assert spark.sql("SELECT hamming64(from_hex64('ffffffffffffffff'), 0)").first()[0] == 64
