"""Exact and near duplicates."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import simhash
from .ranges import running_sum


def exact(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Adds duplicate_of: the first name of equal keys, null in the first row itself.  Rows without a key are none's duplicates.

    The first rows are found by an aggregation with partial sums and joined back, so that a key of very many rows (all empty
    files) is in no task as a whole while the heads of repeated keys are few enough to broadcast.  Project wide columns away first.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("_first"), F.count("*").alias("_rows"))
    out = df.join(first.where("_rows > 1"), F.col(key) == F.col("_key"), "left")
    return out.withColumn("duplicate_of", F.when(F.col("_first.o") < F.col(order), F.col("_first.n"))).drop("_key", "_first", "_rows")


def ranked(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Adds dup_rank, from 1 in each key, and duplicate_of.  Ranks are counted over ranges: a hot key is in many tasks."""
    out = running_sum(df, [key], [order], F.lit(1), "dup_rank", name)
    return out.select(*df.columns, F.col("dup_rank").cast("int").alias("dup_rank"), F.when(F.col("dup_rank") > 1, F.col("_first")).alias("duplicate_of"))


def _parts(threshold: int) -> tuple[list[tuple[int, int]], int]:
    """(first bit, bits) of the bands that 64 bits are cut into, and how many of them a pair within the threshold shares.

    Up to six flipped bits leave two of eight bands whole; more leave one of threshold + 1.
    """
    n, shared = (8, 2) if threshold <= 6 else (min(64, threshold + 1), 1)
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], shared


def _band(bits: str, part: tuple[int, int]) -> str:
    return f"(shiftrightunsigned({bits}, {part[0]}) & {(1 << part[1]) - 1 if part[1] < 64 else -1}L)"


def _keyed(df: DataFrame, threshold: int) -> DataFrame:
    """df once for each set of bands that its bits may share with others: k (the set's number) and band (its key, with k in it).

    A set's place and size are looked up by k, so that the generated code holds one set and not all of them.  The rows are
    made by an unpivot: Spark takes what explode makes for no larger than df, and would broadcast all keys of a table of up to
    10 MB (13 million of them for 465,000 fingerprints, by way of the driver), while it counts an unpivot's rows.
    """
    parts, shared = _parts(threshold)
    sets = list(combinations(parts, shared))
    of = lambda i, j: f"get(array({', '.join(str(s[i][j]) for s in sets)}), k)"
    values = [f"(shiftrightunsigned(bits, {of(i, 0)}) & {f'(shiftleft(1L, {of(i, 1)}) - 1L)' if max(s[i][1] for s in sets) < 64 else '-1L'})" for i in range(shared)]
    key = "CAST(k AS BIGINT)"
    for i, value in enumerate(values):
        key = f"(shiftleft({key}, {of(i, 1)}) | {value})"
    narrow = all(shared * size < 48 for _, size in parts)
    numbers = {f"_k{k}": F.lit(k) for k in range(len(sets))}
    keyed = df.withColumns(numbers).unpivot(df.columns, list(numbers), "_set", "k").drop("_set")
    return keyed.withColumn("band", F.expr(key if narrow else f"xxhash64(k, {', '.join(values)})"))


def _is_first_band(apart: str, k: str, threshold: int) -> Column:
    """Of two fingerprints' XOR: whether the k-th set of bands is the first that is whole in it."""
    parts, shared = _parts(threshold)
    signed = lambda v: f"{v - (1 << 64) if v >> 63 else v}L"
    whole = " | ".join(f"CASE WHEN {_band(apart, p)} = 0 THEN {signed(1 << i)} ELSE 0L END" for i, p in enumerate(parts))
    sets = list(combinations(range(len(parts)), shared))
    # Of the bands up to the set's last one, its own are whole and no others.
    numbers = lambda values: f"get(array({', '.join(map(signed, values))}), {k})"
    upto, own = numbers((2 << s[-1]) - 1 for s in sets), numbers(sum(1 << i for i in s) for s in sets)
    return F.expr(f"(({whole}) & {upto}) = {own}")


def near(df: DataFrame, bits: str, order: str, name: str, threshold: int = 6, asks: str | None = None) -> DataFrame:
    """order, near_duplicate_of: the earliest name within the threshold (of 0 to 63 bits).  Equal fingerprints collapse first.

    asks: a column that tells which rows want an answer; the others are only compared with.

    Fingerprints meet in the bands that they share, which loses no pair.  First each is compared with the earliest one of each
    of its bands alone; then only with those that are earlier than what that found, so that a large group of near copies
    costs no pairs within it.
    """
    own = df.where(F.col(bits).isNotNull()).select(F.col(bits).alias("bits"), F.col(order).alias("ord"), F.col(name).alias("name"), (F.col(asks) if asks else F.lit(True)).alias("asks"))
    groups = own.groupBy("bits").agg(F.min(F.struct("ord", "name")).alias("first"), F.max(F.when(F.col("asks"), F.col("ord"))).alias("last"))
    keyed = _keyed(groups, threshold)
    asked = keyed.where(F.col("last").isNotNull())
    heads = keyed.groupBy(F.col("band").alias("_band")).agg(F.min(F.struct("first", F.col("bits").alias("head_bits"))).alias("head"))
    near_head = F.bit_count(F.col("bits").bitwiseXOR(F.col("head.head_bits"))) <= threshold
    star = asked.join(heads, F.col("band") == F.col("_band")).where(near_head & (F.col("head.first.ord") < F.col("last")))
    star = star.groupBy("bits").agg(F.min("head.first").alias("found")).withColumnRenamed("bits", "_bits")
    bound = groups.where(F.col("last").isNotNull()).join(star, F.col("bits") == F.col("_bits"), "left").select("bits", "found", F.coalesce("found.ord", "last").alias("bound"))
    a = _keyed(bound.select("bits", "bound"), threshold)
    a, b = a.alias("a"), keyed.alias("b")
    apart = F.col("a.bits").bitwiseXOR(F.col("b.bits"))
    # A pair meets in all bands that it shares; it counts in the first of them.
    close = (F.col("a.band") == F.col("b.band")) & (F.col("b.first.ord") < F.col("a.bound")) & (F.bit_count(apart) <= threshold) & _is_first_band("(a.bits ^ b.bits)", "a.k", threshold)
    found = a.join(b, close).select(F.col("a.bits").alias("bits"), F.col("b.first").alias("earlier"))
    found = found.union(bound.where("found is not null").select("bits", F.col("found").alias("earlier")))
    best = found.groupBy("bits").agg(F.min("earlier").alias("earlier"))
    out = own.where("asks").join(best, "bits", "left")
    return out.select(F.col("ord").alias(order), F.when(F.col("earlier.ord") < F.col("ord"), F.col("earlier.name")).alias("near_duplicate_of"))


#: An index of fingerprints: each in all its sets of bands, under the earliest name that had it.
INDEX = "band long, bits long, ord long, name string"


def near_all(df: DataFrame, index: DataFrame, bits: str, order: str, name: str, threshold: int = 6) -> tuple[DataFrame, DataFrame]:
    """(order, near_duplicate_of as in `near` over all rows so far; the rows to add to the index).

    index: INDEX of the earlier rows, whose order is below that of all rows here.  Of the index only what shares a set of bands
    with a row here is looked at, found by a join on the bands in which the index is not exchanged while the rows here are few.
    """
    rows = df.where(F.col(bits).isNotNull()).select(F.col(bits).alias("bits"), F.col(order).cast("long").alias("ord"), F.col(name).alias("name"))
    groups = rows.groupBy("bits").agg(F.min(F.struct("ord", "name")).alias("first"))
    keyed = _keyed(groups, threshold)
    touched = index.join(keyed.select("band").distinct(), "band", "left_semi").groupBy("bits").agg(F.min(F.struct("ord", "name")).alias("first"))
    touched = touched.select("bits", "first.ord", "first.name", F.lit(False).alias("asks"))
    answers = near(rows.withColumn("asks", F.lit(True)).unionByName(touched), "bits", "ord", "name", threshold, "asks").withColumnRenamed("ord", "_ord")
    own = df.select(F.col(order), F.col(order).cast("long").alias("_ord")).join(answers, "_ord", "left").drop("_ord")
    new = keyed.join(touched.select("bits"), "bits", "left_anti").select("band", "bits", "first.ord", "first.name")
    return own, new


def fingerprints(df: DataFrame, text: str, name: str) -> DataFrame:
    """name, bits: the 64-bit SimHash of each whole text, over its distinct lower-case words; null without words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)")))
    own = df.select(F.col(name).alias("name"), words.alias("words"))

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("name"), simhash(batch.column("words"))], ["name", "bits"])

    kind = own.schema["name"].dataType.simpleString()
    return own.mapInArrow(run, f"name {kind}, bits long").withColumnRenamed("name", name)
