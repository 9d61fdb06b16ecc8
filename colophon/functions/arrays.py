"""Ordered array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def clean_keywords(keywords: Column, limit: int = 50) -> Column:
    """Keep the first of each keyword, whatever its case or plural s, in order; at most `limit`."""
    none = F.array().cast("array<string>")

    def add(kept: Column, word: Column) -> Column:
        low = F.lower(word)
        known = lambda key: F.array_contains(kept["keys"], key)
        singular = low.endswith("s") & (F.length(low) > 3) & known(F.left(low, F.length(low) - 1))
        skip = (F.length(word) < 2) | known(low) | singular | known(F.concat(low, F.lit("s")))
        more = F.struct(F.concat(kept["keys"], F.array(low)).alias("keys"), F.concat(kept["words"], F.array(word)).alias("words"))
        return F.when(skip, kept).otherwise(more)

    def step(kept: Column, word: Column) -> Column:
        # Words behind a full list change nothing and are not even stripped; the transform computes a stripped word once.
        stripped = F.get(F.transform(F.array(strip(word)), lambda w: add(kept, w)), F.lit(0))
        return F.when(F.size(kept["keys"]) >= limit, kept).otherwise(stripped)

    # A word that stands there again would be refused: only the first of each is looked at.
    return F.aggregate(F.array_distinct(keywords), F.struct(none.alias("keys"), none.alias("words")), step, lambda kept: kept["words"])


def drop_blank(keywords: Column) -> Column:
    return F.filter(keywords, lambda k: strip(k) != "")


def join_nonempty(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])
