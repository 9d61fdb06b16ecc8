"""Streams of files and of retries."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from colophon.operators import registry
from colophon.sources import ledger
from colophon.streaming import incremental, retries


def test_a_folder_is_streamed_and_resumed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in ("_b.JPG", "a.png", "c.tif", ".d.jpg", "e.jpeg", "notes.txt"):
        (folder / n).write_bytes(n.encode())
    seen, base, check = [], f"file://{tmp_path}/registry", f"{tmp_path}/check"

    def process(new, again):
        seen.append((sorted((r.name, bytes(r.content).decode()) for r in new.collect()), sorted(r.name for r in again.collect())))
        before = again.select("name", "attempts").union(new.select("name", F.lit(0)))
        status, tries = registry.promote(F.col("attempts"))
        bad = F.col("name") == "a.png"
        return before.select("name", F.when(bad, status).otherwise("READY").alias("status"), F.when(bad, tries).otherwise(0).alias("attempts"))

    def once():
        seen.clear()
        incremental.run_folder(spark, str(folder), base, check, process, files=2)
        return [[n for n, _ in new] + [f"again {n}" for n in again] for new, again in seen]

    assert once() == [[".d.jpg", "_b.JPG"], ["a.png", "c.tif"], ["e.jpeg"]]
    assert all(n == text for new, _ in seen for n, text in new)
    (folder / "c.tif").write_bytes(b"another")  # replaced
    (folder / "0.jpg").write_bytes(b"0.jpg")
    os.unlink(folder / "e.jpeg")
    assert once() == [["0.jpg", "c.tif", "again a.png"]]
    assert once() == [["again a.png"]]
    assert once() == []
    state = {r.name: (r.status, r.attempts) for r in ledger.read(spark, base, incremental.REGISTRY).collect()}
    assert state == {"a.png": ("ERROR_PERMANENT", 3)} | dict.fromkeys(("_b.JPG", ".d.jpg", "c.tif", "e.jpeg", "0.jpg"), ("READY", 0))


def test_a_list_that_was_made_before_a_crash_is_given_again(spark, tmp_path):
    from colophon.sources.files import _StreamReader

    (tmp_path / "in").mkdir()
    for n in "abc":
        (tmp_path / "in" / n).write_bytes(b"x")
    options = {"path": str(tmp_path / "in"), "state": str(tmp_path / "state"), "filesPerBatch": "2"}
    first = _StreamReader(options)
    assert first.initialOffset() == {"list": 0} and first.latestOffset() == {"list": 1} and first.latestOffset() == {"list": 2} and first.latestOffset() == {"list": 2}
    second = _StreamReader(options)
    assert second.latestOffset() == {"list": 2}
    (tmp_path / "in/a").write_bytes(b"replaced")
    assert second.latestOffset() == {"list": 3} and second.latestOffset() == {"list": 3}
    names = lambda r, a, b: [os.path.basename(p) for x in r.partitions({"list": a}, {"list": b}) for p in x.paths]
    assert names(second, 0, 1) == ["a", "b"] and names(second, 1, 2) == ["c"] and names(second, 2, 2) == [] and names(second, 1, 3) == ["c", "a"]


def test_failed_keys_come_again_by_timers(spark, tmp_path):
    retries.enable(spark)
    source, check, got = str(tmp_path / "outcomes"), str(tmp_path / "check"), {}
    schema = "name string, error string, at timestamp"
    now = lambda: dt.datetime.now()

    def outcomes(*rows):
        spark.createDataFrame([(n, e, now()) for n, e in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def seen():
        return [row for number in sorted(got) for row in sorted(got[number])]

    def wait_for(n):
        start = query()
        until = time.time() + 60
        while len(seen()) < n and time.time() < until:
            time.sleep(0.3)
        start.stop()
        return seen()

    def query():
        tracked = retries.track(spark.readStream.schema(schema).parquet(source), 3)
        write = lambda df, number: got.update({number: [(r.name, r.action, r.attempts) for r in df.collect()]})
        return tracked.writeStream.foreachBatch(write).option("checkpointLocation", check).trigger(processingTime="500 milliseconds").start()

    outcomes(("a", "503 retry in 0.5 s"), ("b", None), ("c", "RESOURCE_EXHAUSTED retry in 3000 s"))
    first = wait_for(4)
    assert sorted(first[:3]) == [("a", "ERROR", 1), ("b", "OK", 0), ("c", "ERROR", 1)] and first[3:] == [("a", "RETRY", 1)]
    # Another start, from the checkpoint: attempts go on, and c still waits.
    outcomes(("a", "503 retry in 0.5 s"))
    assert wait_for(6)[4:] == [("a", "ERROR", 2), ("a", "RETRY", 2)]
    outcomes(("a", "bad luck"), ("c", None))
    assert sorted(wait_for(8)[6:]) == [("a", "ERROR_PERMANENT", 3), ("c", "OK", 0)]


def test_waits():
    assert [retries.wait_before("rate_limit", None, 2), retries.wait_before("overload", None, 5), retries.wait_before("generic", 9.0, 2), retries.wait_before("quota", 7.0, 1)] == [30.0, 90.0, 6.0, 7.0]
