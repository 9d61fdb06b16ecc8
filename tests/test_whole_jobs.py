"""Operators on tables where a part of the job would show."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colophon.functions import hashing
from colophon.operators import dedup
from colophon.plans import catalogue


def brute_simhash(text):
    words = {w.lower() for w in re.findall(r"[^\W_]+", text or "")}
    hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
    bits = sum(1 << i for i in range(64) if sum((h >> i & 1) * 2 - 1 for h in hashes) > 0)
    return bits - (1 << 64) * (bits >> 63) if words else None


@pytest.mark.parametrize("rows", [1, 3, 7, 1 << 18])
def test_simhash(rows):
    texts = ["", "a", "one two three four five six", "Ünï x", "", "z y x w v u t s r q p"]
    lists = pa.array([None, *[sorted({w.lower() for w in re.findall(r"[^\W_]+", t)}) for t in texts]], pa.list_(pa.string()))
    assert hashing.simhash(lists, rows).to_pylist() == [None, *map(brute_simhash, texts)]
    assert hashing.simhash(lists.slice(2, 4), rows).to_pylist() == [brute_simhash(t) for t in texts[1:5]]


def test_near_duplicates_read_whole_texts(spark, tmp_path):
    body = " ".join(f"w{i * i}" for i in range(300))
    texts = dict(enumerate([body, "Other: " + body, "w0 " + " ".join(f"v{i * 7}" for i in range(200)), None, "", "-", body.upper()]))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bits = {i: brute_simhash(t) for i, t in texts.items()}
    close = lambda a, b: None not in (a, b) and ((a ^ b) & (1 << 64) - 1).bit_count() <= 6
    want = {i: min((j for j in bits if j < i and close(bits[i], bits[j])), default=None) for i in bits}
    assert want[1] == 0 and want[2] is None
    got = {r.doc_id: r.near_duplicate_of for r in catalogue.QUERIES["near_duplicates"](spark, str(tmp_path)).collect()}
    assert got == want


def test_near_broadcasts_no_table_of_keys(spark, tmp_path):
    """A table under the threshold for broadcasts, whose rows in all their bands are far over it (before: 168,000 keys went through the driver)."""
    r = np.random.default_rng(3)
    bits = r.integers(-(1 << 63), 1 << 63, 6000)
    bits[3000:3500] = bits[:500] ^ (1 << r.integers(0, 63, 500))
    table = pa.table({"ord": range(6000), "bits": bits})
    pq.write_table(table, tmp_path / "f.parquet")
    limits = {"spark.sql.autoBroadcastJoinThreshold": "400k", "spark.sql.maxBroadcastTableSize": "4m"}
    old = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        assert (tmp_path / "f.parquet").stat().st_size < 400_000
        got = {x.ord: x.near_duplicate_of for x in dedup.near(spark.read.parquet(f"{tmp_path}/f.parquet"), "bits", "ord", "ord").collect()}
        f = spark.read.parquet(f"{tmp_path}/f.parquet").withColumn("name", F.col("ord").cast("string"))
        late = f.where("ord >= 3000")
        index = dedup.near_all(f.where("ord < 3000"), spark.createDataFrame([], dedup.INDEX), "bits", "ord", "name")[1]
        later = {x.ord: x.near_duplicate_of for x in dedup.near_all(late, index, "bits", "ord", "name")[0].collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    apart = lambda i: np.bitwise_count((bits[:i] ^ bits[i]).view(np.uint64))
    want = {i: int(near[0]) if len(near := np.flatnonzero(apart(i) <= 6)) else None for i in range(6000)}
    assert got == want and sum(x is not None for x in want.values()) == 500
    assert later == {i: None if want[i] is None else str(want[i]) for i in range(3000, 6000)}
