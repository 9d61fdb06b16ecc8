"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Row r of N goes to place p = walk(r); its shard is p mod n_shards and its slot p div n_shards, so shard sizes differ by
at most one and slots are gapless.  A place is computed from r, N and the seed alone; nothing is sorted to shuffle.

Global row numbers follow (doc_id, crc32, size), whatever files hold the rows.  Rows equal in all three are
interchangeable; a salt deals them over several range partitions, so a hot key doesn't land in one task.

Edge cases: null texts count as no bytes (size 16, crc32 0); null doc_ids come first; repeated rows each get a place;
an empty table gives an empty result; other columns of the input are ignored by `assign`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 6


def _round_keys(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)


def feistel(rows: np.ndarray, total: int, seed: int) -> np.ndarray:
    """The places of row numbers below total: a bijection of range(total)."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in keys:
            f = (right + key) * np.uint64(0xD6E8FEB86659FD93)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & mask)
        return (left << shift) | right

    out = once(rows.astype(np.uint64))
    while len(away := np.flatnonzero(out >= total)):
        out[away] = once(out[away])
    return out.astype(np.int64)


def assign(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `rows`)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = docs.select("doc_id", (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    keys = ["doc_id", "text_crc32", "size"]
    ranged = small.withColumn("salt", F.rand(seed)).repartitionByRange(*keys, "salt").sortWithinPartitions(*keys)
    numbered = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "rows")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted(tuple(r) for r in numbered.groupBy(part.alias("part")).count().collect())  # one row a partition
    offsets, total = {}, 0
    for k, n in counts:
        offsets[k] = total
        total += n

    @F.pandas_udf("long")
    def place(parts: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series(feistel((parts.map(offsets).to_numpy(np.int64) + rows.to_numpy(np.int64)), total, seed))

    p = F.col("place")
    return numbered.withColumn("place", place(part, row)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (p % n_shards).cast("int").alias("shard"),
        F.floor(p / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
