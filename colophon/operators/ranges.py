"""Ordered scans whose keys may be hot: rows are dealt by range and not by key, and a carry joins a key's ranges.

Every scan has three steps: rows are sorted over range partitions and written down with their places; each (partition, key) is
scanned by itself and summed up in one row; those rows, of which a key has at most one a partition, give what each partition
starts from.  So a key with a third of all rows is in as many tasks as its rows fill.  The order has to tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared, written


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with _part and _row, its place in the order of (keys, order)."""
    columns = [*keys, *order]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id())
    kept = written(ranged, shared(df.sparkSession, "ranges"))
    return kept.select(*df.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row"))


def _local(keys: list[str]):
    return Window.partitionBy("_part", *keys).orderBy("_row")


def _earlier(keys: list[str]):
    """The partitions of a key before a partition."""
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, carries: DataFrame, keys: list[str]) -> DataFrame:
    names = {c: f"_{i}" for i, c in enumerate(["_part", *keys])}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return rows.join(carries.withColumnsRenamed(names), same).drop(*names.values(), "_part", "_row")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, first: str | None = None) -> DataFrame:
    """Adds name: the sum of value over the rows of the keys up to each one, with it; and _first: the first row's `first`."""
    rows = placed(df.withColumn("_v", value), keys, order)
    sums = rows.groupBy("_part", *keys).agg(F.sum("_v").alias("_sum"), F.min_by(F.col(first) if first else F.lit(None).cast("string"), "_row").alias("_own"))
    carries = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(_earlier(keys)), F.lit(0)).alias("_carry"), F.coalesce(F.first("_own").over(_earlier(keys)), "_own").alias("_first"))
    out = _carried(rows.withColumn("_sum", F.sum("_v").over(_local(keys))), carries, keys)
    out = out.withColumn(name, F.col("_sum") + F.col("_carry")).drop("_sum", "_carry", "_v")
    return out if first else out.drop("_first")


def failures_in_a_row(df: DataFrame, keys: list[str], order: list[str], failed: Column, name: str) -> DataFrame:
    """Adds name: how many rows in a row failed up to each one, of the rows of its keys; a row that did not fail has 0."""
    rows = placed(df.withColumn("_f", F.coalesce(failed, F.lit(False)).cast("long")), keys, order)
    # Rows behind the same number of successes in their partition are one stretch; the first one goes on from before.
    rows = rows.withColumn("_stretch", F.sum(1 - F.col("_f")).over(_local(keys)))
    last = rows.groupBy("_part", *keys, "_stretch").agg(F.sum("_f").alias("_run"))
    last = last.groupBy("_part", *keys).agg(F.max_by("_run", "_stretch").alias("_run"), (F.max("_stretch") > 0).cast("long").alias("_ended"))
    last = last.withColumn("_group", F.sum("_ended").over(Window.partitionBy(*keys).orderBy("_part")))
    last = last.withColumn("_end", F.sum("_run").over(Window.partitionBy(*keys, "_group").orderBy("_part")))
    carries = last.select("_part", *keys, F.coalesce(F.lag("_end").over(Window.partitionBy(*keys).orderBy("_part")), F.lit(0)).alias("_carry"))
    own = F.sum("_f").over(Window.partitionBy("_part", *keys, "_stretch").orderBy("_row"))
    out = _carried(rows.withColumn("_own", own), carries, keys)
    return out.withColumn(name, F.col("_own") + F.when(F.col("_stretch") == 0, F.col("_carry")).otherwise(0)).drop("_f", "_stretch", "_own", "_carry")
