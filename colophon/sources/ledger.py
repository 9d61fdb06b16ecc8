"""A registry as a log of commits, each of which holds only what it changed and the effects that are still to be carried out.

    base/commit-<number>     one small document: the commit's delta, its outbox, and the micro-batch that it stands for
    base/done-<number>       the effects of that commit are carried out
    base/snapshot-<number>   one small document: a table with the latest entry of each key up to that commit

A document is put in place by a rename to a name that nothing has yet, so a crash at any place leaves either the whole commit
or none of it, and of two writers with one number one fails.  A read joins the snapshot with the latest entries of the commits
behind it: those are few, the snapshot is not exchanged, and a commit writes its own rows however many entries there are.
Compaction writes the next snapshot and deletes what the one before the last covered, so that readers of the last one are
not disturbed.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import delete, file_system


class Commit(NamedTuple):
    number: int
    delta: str
    outbox: dict | None
    batch: int | None


def _documents(spark: SparkSession, base: str, kind: str) -> list[tuple[int, str]]:
    fs, make = file_system(spark, base)
    found = fs.globStatus(make(f"{base}/{kind}-*")) or []
    return sorted((int(x.getPath().getName().rpartition("-")[2]), x.getPath().toString()) for x in found)


def _load(spark: SparkSession, path: str) -> dict:
    fs, make = file_system(spark, path)
    stream = fs.open(make(path))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, value: dict) -> None:
    fs, make = file_system(spark, path)
    base = path.rpartition("/")[0]
    draft, target = make(f"{base}/draft-{uuid.uuid4().hex}"), make(path)
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has committed {path}")


def _snapshot(spark: SparkSession, base: str) -> tuple[int, dict | None]:
    last = _documents(spark, base, "snapshot")[-1:]
    return (last[0][0], _load(spark, last[0][1])) if last else (0, None)


def commits(spark: SparkSession, base: str, after: int = 0) -> list[Commit]:
    """The commits with a higher number than `after`, in order."""
    return [Commit(n, **_load(spark, p)) for n, p in _documents(spark, base, "commit") if n > after]


def next_number(spark: SparkSession, base: str) -> int:
    return max([0, _snapshot(spark, base)[0], *(n for n, _ in _documents(spark, base, "commit"))]) + 1


def commit(delta: DataFrame, base: str, outbox: dict | None = None, batch: int | None = None, number: int | None = None) -> int:
    """Append the delta's rows (one a key) with what is to be carried out; gives the commit's number.

    outbox: whatever carries the effects out, as JSON; batch: the micro-batch that this commit stands for.
    """
    spark = delta.sparkSession
    number = number or next_number(spark, base)
    path = f"{base}/delta-{uuid.uuid4().hex}"
    delta.write.parquet(path)
    _put(spark, f"{base}/commit-{number:020d}", {"delta": path, "outbox": outbox, "batch": batch})
    return number


def read(spark: SparkSession, base: str, schema: str, key: str | None = "name") -> DataFrame:
    """The latest entry of each key, or all rows of a log without keys; an empty table where nothing was committed."""
    through, snapshot = _snapshot(spark, base)
    old = spark.read.schema(schema).parquet(snapshot["table"]) if snapshot else spark.createDataFrame([], schema)
    new = None
    for c in commits(spark, base, through):
        rows = spark.read.schema(schema).parquet(c.delta).withColumn("_number", F.lit(c.number))
        new = rows if new is None else new.union(rows)
    if new is None:
        return old
    if key is None:
        return old.union(new.drop("_number"))
    latest = new.groupBy(key).agg(F.max_by(F.struct(*old.columns), "_number").alias("_row")).select("_row.*")
    return old.join(latest.select(key), key, "left_anti").unionByName(latest) if snapshot else latest


def committed_batch(spark: SparkSession, base: str) -> int | None:
    """The last micro-batch that the registry holds."""
    through, snapshot = _snapshot(spark, base)
    numbers = [c.batch for c in commits(spark, base, through) if c.batch is not None]
    return numbers[-1] if numbers else snapshot and snapshot["batch"]


def unfinished(spark: SparkSession, base: str) -> list[Commit]:
    """Commits with effects that are not known to be carried out, in order."""
    done = {n for n, _ in _documents(spark, base, "done")}
    return [c for c in commits(spark, base) if c.outbox is not None and c.number not in done]


def finish(spark: SparkSession, base: str, number: int) -> None:
    """The commit's effects are carried out."""
    fs, make = file_system(spark, base)
    fs.create(make(f"{base}/done-{number:020d}"), True).close()


def compact(spark: SparkSession, base: str, schema: str, key: str | None = "name", every: int = 32) -> bool:
    """Write a snapshot if it is behind by `every` commits, and delete what nobody reads any more."""
    before, snapshot = _snapshot(spark, base)
    behind = commits(spark, base, before)
    if len(behind) < every:
        return False
    table = f"{base}/table-{uuid.uuid4().hex}"
    read(spark, base, schema, key).write.parquet(table)
    _put(spark, f"{base}/snapshot-{behind[-1].number:020d}", {"table": table, "batch": committed_batch(spark, base)})
    waiting = {c.number for c in unfinished(spark, base)}
    for n, path in _documents(spark, base, "snapshot"):
        if n < before:
            delete(spark, _load(spark, path)["table"], path)
    for c in commits(spark, base):
        if c.number <= before and c.number not in waiting:
            delete(spark, c.delta, f"{base}/commit-{c.number:020d}", f"{base}/done-{c.number:020d}")
    return True
