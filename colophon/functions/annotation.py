"""Annotations: strict JSON, presence checks and Python's coercions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RESPONSE_KEYS
from .text import strip, unfence

#: Fields that an annotation may have besides the required ones.
_OPTIONAL = ["category2", "rejection_reason", "people_visible", "property_or_trademark_visible", "watermark_or_overlay_visible"]


def strict_object(text: Column, keys: list[str]) -> Column:
    """The keys' values (VARIANT; null where a key is absent) of a JSON object; null where the text is anything else.

    Accepts what Python's json.loads accepts: text after the object is refused, the last of repeated keys counts, NaN, Infinity
    and -Infinity are numbers.  Spark's parser stops after the first value, so the text is read as a field's value and as the only
    element of a list: an object that ends early would have to be followed by a brace in one and by a bracket in the other.

    Refused although json.loads accepts it: a repeated key within the value of one of the keys, numbers of over 1,000 characters,
    more than about 1,000 levels, and values beyond VARIANT's size.  Infinity must not have a plus sign, as in json.loads.
    """
    options = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}
    fields = ", ".join(f"`{k}`: variant" for k in keys)
    field = F.from_json(F.concat(F.lit('{"value":'), text, F.lit("}")), f"value struct<{fields}>, _bad string", options)
    element = F.from_json(F.concat(F.lit('{"value":['), text, F.lit("]}")), "value array<map<string, string>>, _bad string", options)
    outside = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', "")
    alone = element["_bad"].isNull() & (F.size(element["value"]) == 1)
    plus = text.rlike(r"INF|\+I") & outside.rlike(r"INF|\+I")
    return F.when(field["_bad"].isNull() & alone & ~plus, field["value"])


def missing_keys(found: Column, keys: list[str]) -> Column:
    """The keys that a strict object does not hold, in the given order."""
    return F.filter(F.array(*[F.when(found[k].isNull(), k) for k in keys]), lambda k: k.isNotNull())


def truthy(v: Column) -> Column:
    """Python's bool() of a value; an absent key is false."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind == "STRING", text != "").when(kind == "VOID", F.lit(False))
        .when(kind.startswith("ARRAY"), text != "[]").when(kind.startswith("OBJECT"), text != "{}").otherwise(F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def as_text(v: Column, default: str) -> Column:
    """Python's str() of a value: null gives None, booleans start with a capital, nan and inf are small; the default where the key is absent."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return (
        F.when(kind.isNull(), F.lit(default)).when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text))
        .when((kind == "DOUBLE") & text.isin("NaN", "Infinity", "-Infinity"), F.lower(F.replace(text, F.lit("Infinity"), F.lit("inf")))).otherwise(text)
    )


def parse(df: DataFrame, raw: str) -> DataFrame:
    """Adds the typed fields and parse_error (null where the annotation is usable)."""
    df = df.withColumn("_text", unfence(F.col(raw))).withColumn("_v", strict_object(F.col("_text"), [*RESPONSE_KEYS, *_OPTIONAL]))
    v = F.col("_v")
    absent = missing_keys(v, RESPONSE_KEYS)
    keywords = F.try_variant_get(v["keywords"], "$", "array<string>")
    score = F.try_variant_get(v["commercial_score"], "$", "int")
    reason = F.schema_of_variant(v["rejection_reason"])
    error = (
        F.when(v.isNull(), "not a JSON object").when(F.size(absent) > 0, F.concat(F.lit("missing "), F.array_join(absent, ",")))
        .when(keywords.isNull() | (F.size(keywords) == 0), "keywords empty or not a list").when(score.isNull(), "score is no integer").when(reason.isNotNull() & (reason != "STRING"), "reason is no text")
    )
    return df.withColumns({
        "parse_error": error, "title": strip(as_text(v["title"], "")), "description": strip(as_text(v["description"], "")), "keywords": F.filter(keywords, lambda k: strip(F.coalesce(k, F.lit("None"))) != ""),
        "category": strip(as_text(v["category"], "")), "category2": strip(as_text(v["category2"], "")), "score": score, "risk": strip(as_text(v["rejection_risk"], "Medium")),
        "model_reason": strip(F.coalesce(F.try_variant_get(v["rejection_reason"], "$", "string"), F.lit(""))), "people_visible": truthy(v["people_visible"]),
        "property_or_trademark_visible": truthy(v["property_or_trademark_visible"]), "watermark_or_overlay_visible": truthy(v["watermark_or_overlay_visible"]),
    }).drop("_text", "_v")
