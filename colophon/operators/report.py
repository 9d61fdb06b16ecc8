"""Counts, the run summary and the run document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STATUSES, SUMMARY_COLUMNS, Settings


def status_counts(records: DataFrame) -> DataFrame:
    """One row per status, also of those that don't occur."""
    every = records.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = records.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def summary(records: DataFrame) -> DataFrame:
    """One row over all records: status, score, keyword_count, risk."""
    ready = F.col("status") == "READY"
    scored = F.col("status").isin("READY", "LOW_QUALITY", "NEEDS_RELEASE", "REVIEW")
    return records.agg(
        F.count("*").alias("processed"), F.count_if(ready).alias("ready"), F.count_if(F.col("status") == "LOW_QUALITY").alias("low_quality"),
        F.count_if(F.col("status") == "DUPLICATE").alias("duplicates"), F.count_if(F.col("status") == "LOW_RESOLUTION").alias("low_res"),
        F.count_if(F.col("status") == "NEEDS_RELEASE").alias("needs_release"), F.count_if(F.col("status") == "REVIEW").alias("review"),
        F.count_if(F.col("status").startswith("ERROR")).alias("errors"), F.bround(F.avg(F.when(scored, F.col("score"))), 1).alias("average_score"),
        F.bround(F.avg(F.when(ready, F.col("keyword_count"))), 1).alias("average_keywords"),
        F.bround(100.0 * F.count_if(ready & (F.col("risk") == "Low")) / F.nullif(F.count_if(ready), F.lit(0)), 1).alias("low_risk_percent"),
    )


def category_distribution(records: DataFrame, order: str | None = None) -> DataFrame:
    """category, n, and with an order the first place at which a category was seen."""
    ready = records.where((F.col("status") == "READY") & (F.col("category") != ""))
    return ready.groupBy("category").agg(F.count("*").alias("n"), *([F.min(order).alias("first")] if order else []))


def document(records: DataFrame, remaining: DataFrame, settings: Settings, folder: str, duration: float | None = None, stopped: bool = False, order: str = "ord") -> DataFrame:
    """One row of SUMMARY_COLUMNS: the summary of a run's records; categories stand in the order in which they were first seen.

    remaining: one row with the number of items that were pending before the run and are so after it.  Averages are null
    where nothing was scored or accepted.
    """
    seen = F.sort_array(F.collect_list(F.struct("first", "category", "n")))
    entries = F.transform(seen, lambda x: F.struct(x["category"].alias("key"), x["n"].alias("value")))
    counted = category_distribution(records, order).agg(F.map_from_entries(entries).alias("category_distribution"))
    calls = records.agg(F.coalesce(F.sum("retries"), F.lit(0)).cast("long").alias("api_retries"), F.coalesce(F.sum("failures"), F.lit(0)).cast("long").alias("api_hard_failures"))
    names = {
        "processed": "processed_this_run", "ready": "ready_to_upload", "average_score": "average_commercial_score", "average_keywords": "average_keyword_count",
        "low_risk_percent": "low_risk_ready_ratio_percent",
    }
    # One row each: nothing but these meets in the joins.
    whole = summary(records).withColumnsRenamed(names).join(F.broadcast(counted)).join(F.broadcast(calls)).join(F.broadcast(remaining.toDF("remaining")))
    fixed = {"version": F.lit(settings.version), "model": F.lit(settings.model), "folder": F.lit(folder), "duration_seconds": F.bround(F.lit(duration).cast("double"), 1), "stopped_on_daily_quota": F.lit(stopped)}
    return whole.withColumns(fixed).select(*SUMMARY_COLUMNS)


def console(row: dict) -> str:
    """A run document as lines for a terminal."""
    shown = [f"{k.replace('_', ' ')}: {v}" for k, v in row.items() if v is not None and k not in ("category_distribution",)]
    return "\n".join(["Run finished", *shown, *(f"  {c}: {n}" for c, n in (row.get("category_distribution") or {}).items())])
