"""Scans over range partitions and collision-free names, with hot keys, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from colophon.operators import naming, ranges


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_of_a_hot_key(spark, many_ranges):
    r = random.Random(4)
    rows = [(i, r.choice(["hot"] * 8 + ["a", "b", None]), r.random() < 0.8 or 100 < i < 220, r.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "at int, key string, failed boolean, v int")
    assert ranges.placed(df, ["key"], ["at"]).where("key = 'hot'").select("_part").distinct().count() >= 4
    sums, runs, first, want = {}, {}, {}, {}
    for at, key, failed, v in rows:
        sums[key] = sums.get(key, 0) + v
        runs[key] = runs.get(key, 0) + 1 if failed else 0
        want[at] = (sums[key], first.setdefault(key, at), runs[key])
    summed = {x["at"]: (x["sum"], x["_first"]) for x in ranges.running_sum(df, ["key"], ["at"], F.col("v"), "sum", "at").collect()}
    run = {x["at"]: x["run"] for x in ranges.failures_in_a_row(df, ["key"], ["at"], F.col("failed"), "run").collect()}
    assert {k: (*summed[k], run[k]) for k in summed} == want


def taken(rows, existing):
    used, out = {}, {}
    for g, n in existing:
        used.setdefault(g, set()).add(n)
    for at, g, name in sorted(rows):
        own, pick, k = used.setdefault(g, set()), name, 2
        i = name.rfind(".")
        base, tail = (name[:i], name[i:]) if i > 0 and i < len(name) - 1 else (name, "")
        while pick in own:
            pick, k = f"{base}-{k}{tail}", k + 1
        own.add(pick)
        out[at] = pick
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_of_hot_roots(spark, many_ranges, seed):
    r = random.Random(seed)
    stems = ["a"] * 12 + ["a-2", "a-3", "a-2-2", "a-2-3", "a-5", "a-12", "a-02", "a-1", "a-999999999999", "b", "-2", "-2-2", "c-7", "a-2-2-2", "a-40", "a-41"]
    rows = [(i, r.choice(["x", "x", "x", "y", None]), r.choice(stems) + r.choice([".jpg"] * 6 + [".png", "", ".tar.gz"])) for i in range(260)]
    existing = [(g, n) for g in ("x", "y") for n in ("a-4.jpg", "a-6.jpg", "a-2-2.jpg", "b.jpg", "c.jpg", "a-300.jpg")] if seed else []
    df = spark.createDataFrame(rows, "at int, folder string, name string")
    there = spark.createDataFrame(existing, "folder string, existing_name string") if existing else None
    got = {x["at"]: x.unique_name for x in naming.unique_exact(df, "folder", "name", "at", there).collect()}
    assert got == taken(rows, existing)
    fold = {x["at"]: x.unique_name for x in naming.unique_fold(df, "folder", "name", "at", there).collect()}
    assert fold == got
