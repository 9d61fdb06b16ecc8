"""The registry's log, and runs that are cut off or meet trouble at any place."""

import csv
import json
import os
import shutil
import sys

import pytest
from pyspark import cloudpickle
from test_run import GOOD, Answers, picture

from colophon.config import Settings
from colophon.plans import run as runs
from colophon.sources import effects, ledger

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SCHEMA = "name string, status string, attempts int"


def test_commits_hold_their_own_rows(spark, tmp_path):
    base = f"file://{tmp_path}"
    frame = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    state = lambda: {r.name: (r.status, r.attempts) for r in ledger.read(spark, base, SCHEMA).collect()}
    assert state() == {} and ledger.committed_batch(spark, base) is None and ledger.unfinished(spark, base) == []
    want, r = {}, 0
    for number in range(1, 14):
        rows = [(f"n{(number * 7 + i) % 11}", f"S{number}", i) for i in range(3)]
        assert ledger.commit(frame(*rows), base, outbox={"x": number} if number in (2, 5) else None, batch=number if number % 3 == 0 else None) == number
        last = ledger.commits(spark, base)[-1]
        assert spark.read.parquet(last.delta).count() == 3
        want |= {n: (s, a) for n, s, a in rows}
        assert state() == want and ledger.committed_batch(spark, base) == (number // 3 * 3 or None)
        if number == 5:
            ledger.finish(spark, base, 5)
        r += ledger.compact(spark, base, SCHEMA, every=4)
        assert state() == want and [c.number for c in ledger.unfinished(spark, base)] == ([2] if number >= 2 else [])
    assert r == 3
    kinds = [x.split("-")[0] for x in os.listdir(tmp_path) if not x.startswith(".")]
    # The last two snapshots, the commits behind the one before, and the one with an unfinished outbox.
    assert kinds.count("table") == kinds.count("snapshot") == 2 and kinds.count("commit") == kinds.count("delta") == 6
    ledger.finish(spark, base, 2)
    assert ledger.unfinished(spark, base) == [] and ledger.next_number(spark, base) == 14


def test_half_a_commit_is_none(spark, tmp_path):
    base = f"file://{tmp_path}"
    ledger.commit(spark.createDataFrame([("a", "ERROR", 1)], SCHEMA), base, batch=7)
    spark.createDataFrame([("a", "READY", 1)], SCHEMA).write.parquet(f"{base}/delta-lost")
    (tmp_path / "draft-x").write_text(json.dumps({"delta": f"{base}/delta-lost", "outbox": None, "batch": 8}))
    assert ledger.read(spark, base, SCHEMA).first().status == "ERROR" and ledger.committed_batch(spark, base) == 7
    with pytest.raises(RuntimeError, match="another writer"):
        ledger.commit(spark.createDataFrame([("a", "READY", 1)], SCHEMA), base, number=1)
    assert ledger.read(spark, base, SCHEMA).first().status == "ERROR"


def test_lines_are_appended_once(tmp_path):
    path, head, lines = str(tmp_path / "f"), b"head\n", b"one\ntwo\n"
    read = lambda: (tmp_path / "f").read_bytes()
    for cut in range(len(head + lines) + 1):
        (tmp_path / "f").write_bytes((head + lines)[:cut])
        for _ in range(2):
            effects.append(path, 0, head, lines)
            assert read() == head + lines
    for rest in (b"", b"on", b"one\ntwo\n"):
        (tmp_path / "f").write_bytes(b"head\nzero\n" + rest)
        effects.append(path, 10, head, lines)
        assert read() == b"head\nzero\none\ntwo\n"
    (tmp_path / "f").write_bytes(b"edited by hand\n")
    for _ in range(2):
        effects.append(path, 3, head, lines)
    assert read() == b"edited by hand\none\ntwo\n"


STEPS = ["pending", "assets", "gated", "prepared", "attempts", "tagged", "records", "document", "committed", "moved", "uploaded", "logged", "indexed", "reported", "finished"]
ANSWERS = {
    "a.jpg": GOOD, "b.png": GOOD | {"title": "Owl", "people_visible": True, "category": "Bogus"}, "c.jpg": GOOD | {"title": "Bad tags", "rejection_risk": "High"},
    "d.png": GOOD | {"commercial_score": 10}, "e.jpg": "!bad luck",
}


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("given")
    for i, name in enumerate(sorted(ANSWERS)):
        picture(spark, folder / name, i, 300, 200, name[-3:])
    shutil.copy(folder / "a.jpg", folder / "a2.jpg")
    tool = folder.parent / "tagger"
    tool.write_text('#!/bin/sh\nfor x; do f="$x"; done\ncase "$*" in *"Bad tags"*) echo full >&2; exit 3;; esac\nprintf "%s" "$*" | sed "s#$f##" >> "$f"\n')
    tool.chmod(0o755)
    return folder, str(tool)


def outcome(folder):
    """All files but the registry, by content; the upload table and the log whole."""
    found = {}
    for d, _, names in os.walk(folder):
        for n in names:
            path = os.path.relpath(os.path.join(d, n), folder)
            if not path.startswith("Reports/r") and not n.startswith("."):
                with open(os.path.join(folder, path), "rb") as f:
                    found[path] = f.read()
    return found


SETTINGS = Settings(pause_seconds=0, call_attempts=1, min_megapixels=0.01, near_scope="all")


@pytest.fixture(scope="module")
def undisturbed(spark, given, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole") / "in"
    shutil.copytree(given[0], folder)
    document = runs.run(spark, str(folder), lambda: Answers(ANSWERS), SETTINGS, given[1])
    return outcome(folder), document


def test_a_failing_item_stops_nothing(undisturbed, given):
    found, document = undisturbed
    assert {k: document[k] for k in ("processed_this_run", "ready_to_upload", "needs_release", "review", "low_quality", "duplicates", "errors", "remaining")} == {
        "processed_this_run": 6, "ready_to_upload": 1, "needs_release": 1, "review": 0, "low_quality": 1, "duplicates": 1, "errors": 2, "remaining": 2}
    assert sorted(k for k in found if not k.startswith("Reports")) == [
        "00_SOURCE_ORIGINALS/b.png", "00_SOURCE_ORIGINALS/d.png", "01_READY_UPLOAD/red-fox-at-dawn.jpg", "03_SKIPPED_LOWQUALITY/red-fox-at-dawn.jpg",
        "04_DUPLICATES/a2.jpg", "05_NEEDS_RELEASE/owl.jpg", "c.jpg", "e.jpg"]
    assert b"-Title=Red Fox, at Dawn" in found["01_READY_UPLOAD/red-fox-at-dawn.jpg"] and b"-Title" not in found["03_SKIPPED_LOWQUALITY/red-fox-at-dawn.jpg"]
    assert found["01_READY_UPLOAD/red-fox-at-dawn.jpg"].count(b"-Keywords+=fox") == 1 and b"-Title" not in found["c.jpg"]
    log = found["Reports/needs_review.txt"].decode().split("\n")
    # The judgement that came before the tags, and then the error.
    assert [x.split(" | ")[0] for x in log if "c.jpg" in x] == ["REVIEW", "ERROR"] and "full" in next(x for x in log if x.startswith("ERROR | c.jpg"))


def test_runs_that_are_cut_off_are_made_up_for(spark, given, undisturbed, tmp_path):
    """A crash after each step in turn: each run meets what the one before has left, and is cut off one step later."""
    folder = tmp_path / "in"
    shutil.copytree(given[0], folder)
    for step in STEPS:

        def crash(name, step=step):
            if name == step:
                raise KeyboardInterrupt(name)

        with pytest.raises(KeyboardInterrupt):
            if STEPS.index(step) <= STEPS.index("committed"):
                runs.run(spark, str(folder), lambda: Answers(ANSWERS), SETTINGS, given[1], crash)
            else:
                runs.publish(spark, str(folder), crash)
        if STEPS.index(step) < STEPS.index("committed"):
            assert all((folder / n).exists() for n in ANSWERS) and not (folder / "Reports/upload.csv").exists()
    runs.publish(spark, str(folder))
    assert outcome(folder) == undisturbed[0]
    runs._clean(str(folder), 1)
    assert os.listdir(folder / "Reports/runs") == ["1"]


def test_a_name_that_is_taken_meanwhile(spark, given, tmp_path):
    folder = tmp_path / "in"
    shutil.copytree(given[0], folder)

    def meddle(name):
        if name == "committed":
            (folder / "01_READY_UPLOAD/red-fox-at-dawn.jpg").write_bytes(b"someone else's")

    runs.run(spark, str(folder), lambda: Answers(ANSWERS), SETTINGS, given[1], meddle)
    assert sorted(os.listdir(folder / "01_READY_UPLOAD")) == ["red-fox-at-dawn-2.jpg", "red-fox-at-dawn.jpg"]
    assert [r[0] for r in csv.reader((folder / "Reports/upload.csv").open(newline=""))] == ["Filename", "red-fox-at-dawn-2.jpg"]
    entry = ledger.read(spark, f"file://{folder}/Reports/registry", runs.REGISTRY).where("name = 'a.jpg'").first()
    assert (entry.status, entry.final_name) == ("READY", "red-fox-at-dawn-2.jpg") and not (folder / "a.jpg").exists()


def test_near_duplicates_of_earlier_runs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, seed, side in (("a.jpg", 1, 400), ("b.jpg", 2, 300), ("c.jpg", 1, 300), ("d.jpg", 2, 420)):
        picture(spark, folder / name, seed, side, side, "jpg")
    settings = Settings(pause_seconds=0, call_attempts=1, min_megapixels=0.01, near_scope="all", batch_limit=2)
    answers = dict.fromkeys(("a.jpg", "c.jpg", "d.jpg"), GOOD) | {"b.jpg": "!bad luck"}
    for _ in range(2):  # a.jpg and b.jpg, which fails; then b.jpg again and c.jpg
        runs.run(spark, str(folder), lambda: Answers(answers), settings)
        answers["b.jpg"] = GOOD
    runs.run(spark, str(folder), lambda: Answers(answers), settings)
    log = (folder / "Reports/needs_review.txt").read_text().split("\n")
    assert [x for x in log if x.startswith("NOTE")] == ["NOTE | c.jpg | close to a.jpg", "NOTE | d.jpg | close to b.jpg"]
