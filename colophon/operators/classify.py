"""Status, reason, categories, destinations and review lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CATEGORIES, DESTINATIONS
from ..functions.text import strip


def choose_status(score: Column, risk: Column, people: Column, prop: Column, watermark: Column, min_score: int = 60) -> Column:
    return (
        F.when(watermark, "LOW_QUALITY").when(score < min_score, "LOW_QUALITY").when(people | prop, "NEEDS_RELEASE")
        .when(risk.isin("Medium", "High"), "REVIEW").otherwise("READY")
    )


def explain_status(status: Column, score: Column, risk: Column, reason: Column, watermark: Column, min_score: int = 60) -> Column:
    """The annotation's own reason, or one of ours: no status goes without."""
    own = F.nullif(strip(F.coalesce(reason, F.lit(""))), F.lit(""))
    ours = (
        F.when(watermark & (status == "LOW_QUALITY"), "carries a visible overlay")
        .when(status == "READY", F.concat(F.lit("accepted with score "), score.cast("string"), F.lit(" and risk "), risk))
        .when(status == "LOW_QUALITY", F.concat(F.lit("score "), score.cast("string"), F.lit(f" under {min_score}")))
        .when(status == "NEEDS_RELEASE", "shows people or property without a release")
        .when(status == "REVIEW", F.concat(F.lit("needs a look: risk "), risk))
    )
    return F.coalesce(own, ours, F.lit(""))


def repair_category(category: Column, allowed: list[str] | None = None) -> Column:
    return F.when(category.isin(allowed or CATEGORIES), category).otherwise("Miscellaneous")


def repair_second(second: Column, repaired: Column, allowed: list[str] | None = None) -> Column:
    return F.when(second.isin(allowed or CATEGORIES) & (second != repaired), second).otherwise("")


def destination(status: Column) -> Column:
    """The folder of a status; review where it has none."""
    pairs = [F.lit(x) for kv in DESTINATIONS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[status], F.lit(DESTINATIONS["REVIEW"]))


def review_lines(name: Column, status: Column, reason: Column, people: Column, prop: Column, watermark: Column, near: Column | None = None, bad_category: Column | None = None, prepared: Column | None = None) -> Column:
    """Lines for the review log, in order.  Accepted items, exact duplicates and low resolution have no line of their own."""
    line = lambda kind, rest: F.concat(F.lit(kind + " | "), name, F.lit(" | "), rest)
    out = []
    if near is not None:
        out.append(F.when(near.isNotNull(), line("NOTE", F.concat(F.lit("close to "), near))))
    if prepared is not None:
        out.append(F.when(prepared, line("NOTE", F.lit("prepared for upload"))))
    if bad_category is not None:
        out.append(F.when(bad_category.isNotNull(), line("BAD CATEGORY", bad_category)))
    out.append(F.when(~status.isin("READY", "DUPLICATE", "LOW_RESOLUTION"), F.concat(status, F.lit(" | "), name, F.lit(" | "), reason)))
    out.append(F.when((status == "NEEDS_RELEASE") & people, line("FLAG", F.lit("people"))))
    out.append(F.when((status == "NEEDS_RELEASE") & prop, line("FLAG", F.lit("property"))))
    out.append(F.when(watermark & (status == "LOW_QUALITY"), line("FLAG", F.lit("overlay"))))
    return F.array_compact(F.array(*out))
