"""Annotations from recorded attempts: the relation that a live provider would write, or tests hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.annotation import parse
from ..functions.text import backoff, error_kind, retry_hint, unreadable_hint


def resolve(attempts: DataFrame, call_attempts: int = 5) -> DataFrame:
    """name, raw, outcome (OK, ERROR, QUOTA), error, retries, failures, waited: the first usable attempt of each name.

    attempts: name, attempt_no, raw_text, error_text.  A refused text counts as a generic error; the run of a name ends
    at its first usable attempt, at a quota error, at a limit or overload whose delay can't be read (which is neither
    retried nor counted), or after call_attempts.
    """
    rows = parse(attempts.where(F.col("attempt_no") <= call_attempts), "raw_text")
    # Coercion failures come after the call, so they don't retry.
    refused = F.coalesce("error_text", F.when(F.col("parse_error").rlike("^(not|missing|keywords)"), F.col("parse_error")))
    rows = rows.select("name", "attempt_no", "raw_text", refused.alias("error"), F.coalesce(error_kind(F.col("error_text")), F.lit("generic")).alias("kind"))
    broken = F.col("kind").isin("rate_limit", "overload") & unreadable_hint(F.col("error"))
    rows = rows.withColumn("kind", F.when(broken, "broken").otherwise(F.col("kind")))
    ends = F.col("error").isNull() | F.col("kind").isin("quota", "broken")
    w = Window.partitionBy("name").orderBy("attempt_no")
    rows = rows.withColumn("over", F.coalesce(F.max(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("not over")
    failed = F.col("error").isNotNull() & ~F.col("kind").isin("quota", "broken")
    wait = F.when(failed & (F.col("attempt_no") < call_attempts), backoff(F.col("kind"), retry_hint(F.col("error")), F.col("attempt_no")))
    last = lambda c: F.max_by(c, "attempt_no")
    out = rows.groupBy("name").agg(last("raw_text").alias("raw"), last("error").alias("error"), last("kind").alias("kind"), F.count_if(failed).alias("retries"), F.coalesce(F.sum(wait), F.lit(0.0)).alias("waited"))
    outcome = F.when(F.col("error").isNull(), "OK").when(F.col("kind") == "quota", "QUOTA").otherwise("ERROR")
    out = out.withColumn("outcome", outcome)
    return out.select("name", F.when(F.col("outcome") == "OK", F.col("raw")).alias("raw"), "outcome", "error", "retries", ((F.col("outcome") == "ERROR") & (F.col("kind") != "broken")).cast("int").alias("failures"), "waited")
