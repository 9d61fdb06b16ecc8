"""One batch run as staged frames: pending, deduplicated, gated, annotated, classified, named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ORIGINALS, Settings
from ..functions.annotation import parse
from ..functions.arrays import clean_keywords
from ..functions.hashing import from_hex, megapixels
from ..functions.text import final_name, suffix
from ..operators import annotate, classify, dedup, naming, registry as state


def gate(assets: DataFrame, registry: DataFrame, settings: Settings | None = None, index: DataFrame | None = None, number: int = 0) -> DataFrame:
    """The batch: the first pending items with their order, duplicates, size checks, and whether a provider is to be called.

    assets: name, sha256, phash (hex), width, height, length.  index: fingerprints of the runs before this one, which has this number;
    near duplicates are then looked for among those too.
    """
    s = settings or Settings()
    todo = state.batch(state.pending(assets, registry, max_attempts=s.max_attempts), limit=s.batch_limit)
    hashed = dedup.exact(todo, "sha256", "ord", "name").withColumn("_bits", F.when(F.col("duplicate_of").isNull(), from_hex(F.col("phash"))))
    if index is None:
        close = dedup.near(hashed, "_bits", "ord", "name", s.hash_threshold)
    else:
        placed = hashed.withColumn("_at", place(number))
        close = dedup.near_all(placed, index, "_bits", "_at", "name", s.hash_threshold)[0]
        close = placed.select("ord", "_at").join(close, "_at").drop("_at")
    mp = megapixels(F.col("width"), F.col("height"))
    gated = hashed.drop("_bits").join(close, "ord", "left").withColumns({"megapixels": mp, "low_res": F.coalesce(mp < s.min_megapixels, F.lit(False))})
    gated = gated.withColumn("needs_convert", needs_convert(F.col("name"), F.col("length"), s.max_file_mb))
    return gated.withColumn("called", F.col("duplicate_of").isNull() & ~F.col("low_res"))


def place(number: int) -> Column:
    """An item's place among those of all runs."""
    return F.lit(number << 32) + F.col("ord")


def indexed(gated: DataFrame, records: DataFrame, index: DataFrame, number: int, settings: Settings) -> DataFrame:
    """What a run adds to the index: fingerprints of the items that it is done with; failed ones come again."""
    done = records.where(~F.col("status").startswith("ERROR")).select("ord")
    rows = gated.where(F.col("duplicate_of").isNull()).join(done, "ord", "left_semi")
    return dedup.near_all(rows.withColumns({"_bits": from_hex(F.col("phash")), "_at": place(number)}), index, "_bits", "_at", "name", settings.hash_threshold)[1]


def needs_convert(name: Column, length: Column, max_file_mb: int = 50) -> Column:
    """PNG files, and files above the limit, are made JPEG files of at most that size."""
    return F.lower(suffix(name)).eqNullSafe(".png") | (length / 1048576 > max_file_mb)


def records(assets: DataFrame, attempts: DataFrame, registry: DataFrame, settings: Settings | None = None, existing: DataFrame | None = None) -> DataFrame:
    """One record per processed item, with its ord."""
    return finish(gate(assets, registry, settings), attempts, settings, existing)


def finish(gated: DataFrame, attempts: DataFrame, settings: Settings | None = None, existing: DataFrame | None = None, untagged: DataFrame | None = None) -> DataFrame:
    """The records of a gated batch.

    attempts: those of the items that are called; existing: (destination, existing_name); untagged: (name, tag_error) of items
    whose tags could not be written, which fails them after they were judged.
    """
    s = settings or Settings()
    resolved = parse(gated.join(annotate.resolve(attempts, s.call_attempts), "name", "left"), "raw")
    called = F.col("called")
    kept = state.before_first(resolved, ["ord"], called & (F.col("outcome") == "QUOTA"))
    if untagged is None:
        kept = kept.withColumn("tag_error", F.lit(None).cast("string"))
    else:
        kept = kept.join(untagged, "name", "left")
    called_failure = F.coalesce(F.when(F.col("outcome").isNull() | (F.col("outcome") == "ERROR"), F.coalesce("error", F.lit("no annotation"))), F.col("parse_error"))
    failure = F.coalesce(called_failure, F.col("tag_error"))
    error_status, tries = state.promote(F.col("attempts_prev"), s.max_attempts)
    flags = [F.col(c) for c in ("people_visible", "property_or_trademark_visible", "watermark_or_overlay_visible")]
    chosen = classify.choose_status(F.col("score"), F.col("risk"), *flags, s.min_score)
    out = kept.withColumns({"failure": F.when(called, failure), "_judged": F.when(called & called_failure.isNull() & F.col("tag_error").isNotNull(), chosen)})
    status = F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE").when(F.col("low_res"), "LOW_RESOLUTION").when(F.col("failure").isNotNull(), error_status).otherwise(chosen)
    out = out.withColumn("status", status).withColumn("classified", called & F.col("failure").isNull())
    reason = (
        F.when(F.col("status") == "DUPLICATE", F.concat(F.lit("same bytes as "), F.col("duplicate_of")))
        .when(F.col("status") == "LOW_RESOLUTION", F.concat(F.bround("megapixels", 1).cast("string"), F.lit(" megapixels are too few")))
        .when(F.col("failure").isNotNull(), F.concat(F.lit("attempt "), tries.cast("string"), F.lit(": "), F.col("failure")))
        .otherwise(classify.explain_status(F.col("status"), F.col("score"), F.col("risk"), F.col("model_reason"), flags[2], s.min_score))
    )
    explained = classify.explain_status(F.col("_judged"), F.col("score"), F.col("risk"), F.col("model_reason"), flags[2], s.min_score)
    out = out.withColumns({"reason": reason, "attempts": F.when(F.col("failure").isNotNull(), tries).otherwise(0), "_category": classify.repair_category(F.col("category"))})
    out = out.withColumns({
        "bad_category": F.when((F.col("classified") | F.col("_judged").isNotNull()) & (F.col("category") != F.col("_category")), F.col("category")),
        "category2": classify.repair_second(F.col("category2"), F.col("_category")), "category": F.col("_category"),
        "keywords": clean_keywords(F.col("keywords"), s.max_keywords), "destination": F.when(~F.col("status").startswith("ERROR"), classify.destination(F.col("status"))),
    })
    titled = F.when(F.col("classified"), F.col("title")).otherwise("")
    out = out.withColumn("base_name", F.when(F.col("destination").isNotNull(), final_name(titled, F.col("name"), F.col("status"))))
    prepared = F.col("needs_convert") & F.col("duplicate_of").isNull()
    # Each file's own name, and that of its original in the archive.
    wanted = F.array(F.struct("destination", F.col("base_name")), F.when(prepared & F.col("classified"), F.struct(F.lit(ORIGINALS).alias("destination"), F.col("name").alias("base_name"))))
    names = out.where("destination is not null").select("ord", F.explode(F.array_compact(wanted)).alias("w")).select("ord", "w.destination", "w.base_name")
    moved = naming.unique_fold(names, "destination", "base_name", "ord", existing)
    chosen_name = lambda archive: F.max(F.when((F.col("destination") == ORIGINALS) == archive, F.col("unique_name")))
    moved = moved.groupBy("ord").agg(chosen_name(F.lit(False)).alias("unique_name"), chosen_name(F.lit(True)).alias("archive_name"))
    out = out.join(moved, "ord", "left").withColumns({"final_name": F.coalesce("unique_name", F.lit("")), "keyword_count": F.size("keywords"), "error": F.left("failure", F.lit(300))})
    judged = classify.review_lines(F.col("name"), F.coalesce("_judged", "status"), F.when(F.col("_judged").isNull(), F.col("reason")).otherwise(explained), *flags, F.col("near_duplicate_of"), F.col("bad_category"), prepared)
    late = F.when(F.col("_judged").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.col("status"), F.lit(" | "), F.col("name"), F.lit(" | "), F.col("reason"))))
    out = out.withColumn("lines", F.concat(judged, late))
    only = ["score", "risk", "category", "category2", "title", "description", "people_visible", "property_or_trademark_visible", "watermark_or_overlay_visible", "keyword_count", "keywords"]
    return out.select(
        "ord", F.col("name").alias("original_name"), "final_name", "status", "destination", "reason", F.col("sha256").alias("hash"), "duplicate_of", "near_duplicate_of",
        F.when(F.col("status") == "LOW_RESOLUTION", F.bround("megapixels", 2)).alias("megapixels"), "error", "attempts", "retries", "failures", "bad_category", prepared.alias("needs_convert"), "lines", "archive_name",
        *[F.when(F.col("classified"), F.col(c)).alias(c) for c in only],
    )


def registry_rows(done: DataFrame, seq: int) -> DataFrame:
    return done.select(
        F.col("original_name").alias("name"), "status", "attempts", "destination", "final_name", "score", "risk", "category", "category2", "hash",
        "duplicate_of", "megapixels", F.col("error").alias("last_error"), "people_visible", "property_or_trademark_visible", "watermark_or_overlay_visible", F.lit(seq).cast("long").alias("updated_seq"),
    )
