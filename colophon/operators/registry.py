"""Resumable state: pending items, latest-wins upserts, attempts and the quota cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import failures_in_a_row

TERMINAL = ["READY", "LOW_RESOLUTION", "LOW_QUALITY", "DUPLICATE", "NEEDS_RELEASE", "REVIEW", "ERROR_PERMANENT"]


def is_pending(status: Column, attempts: Column, max_attempts: int = 3) -> Column:
    return F.when(status.isNull(), True).when(status.isin(TERMINAL), False).when(status == "ERROR", F.coalesce(attempts, F.lit(0)) < max_attempts).otherwise(True)


def pending(items: DataFrame, registry: DataFrame, name: str = "name", max_attempts: int = 3) -> DataFrame:
    """Items that are still to do, with attempts_prev."""
    state = registry.select(F.col(name), F.col("status").alias("_status"), F.col("attempts").alias("attempts_prev"))
    joined = items.join(state, name, "left").where(is_pending(F.col("_status"), F.col("attempts_prev"), max_attempts))
    return joined.drop("_status").withColumn("attempts_prev", F.coalesce("attempts_prev", F.lit(0)))


def batch(todo: DataFrame, name: str = "name", limit: int = 50) -> DataFrame:
    """The first names, numbered from 1."""
    few = todo.orderBy(name).limit(limit)
    return few.withColumn("ord", F.row_number().over(Window.orderBy(name)))


def upsert(registry: DataFrame, new: DataFrame, key: str = "name", order: str = "updated_seq") -> DataFrame:
    """The latest row of each key, whole."""
    rows = registry.unionByName(new, allowMissingColumns=True)
    names = rows.columns
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_row"))
    return best.select(*[F.col("_row")[n].alias(n) for n in names])


def promote(attempts_prev: Column, max_attempts: int = 3) -> tuple[Column, Column]:
    """(status, attempts) after one more failure."""
    attempts = F.coalesce(attempts_prev, F.lit(0)) + 1
    return F.when(attempts >= max_attempts, "ERROR_PERMANENT").otherwise("ERROR"), attempts


def consecutive_failures(log: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Adds attempts: failures in a row up to each event; a success resets them.  A hot key is in many tasks."""
    return failures_in_a_row(log, [key], order, failed, "attempts")


def before_first(df: DataFrame, order: list[str], stop: Column, key: str | None = None) -> DataFrame:
    """Rows before the first that stops (of each key)."""
    mark = F.min(F.when(stop, F.struct(*order)))
    if key is None:
        cut = df.agg(mark.alias("_cut"))
        return df.join(F.broadcast(cut)).where(F.col("_cut").isNull() | (F.struct(*order) < F.col("_cut"))).drop("_cut")
    cut = df.groupBy(key).agg(mark.alias("_cut"))
    return df.join(cut, key).where(F.col("_cut").isNull() | (F.struct(*order) < F.col("_cut"))).drop("_cut")
