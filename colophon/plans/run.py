"""One whole run over a folder of pictures: from its pending files to moved files, tables, log and report.

A run has two halves.  The first reads files, calls the provider, embeds tags in copies, and writes what it finds below
Reports/runs/<number>; it touches nothing else, so a crash leaves every file pending.  One commit then puts the registry's new
entries and the plan of all effects (the outbox) in place together.  The second half carries the outbox out: files, upload
table, log, report.  Each effect can be repeated, and a run first carries out what earlier commits have left, so that after a
crash at any place each file is either pending or wholly published.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DESTINATIONS, ORIGINALS, REPORTS, UPLOAD_COLUMNS, Settings
from ..functions.hashing import sha256
from ..functions.text import error_kind, trim_lines
from ..operators import dedup, naming, provider as calls, registry as state, report
from ..sources import effects, files, images, ledger, sinks
from ..sources.store import written
from . import batch

REGISTRY = (
    "name string, status string, attempts int, destination string, final_name string, score int, risk string, category string, category2 string, hash string, "
    "duplicate_of string, megapixels double, last_error string, people_visible boolean, property_or_trademark_visible boolean, watermark_or_overlay_visible boolean, updated_seq long"
)
FOLDERS = [ORIGINALS, *DESTINATIONS.values(), REPORTS]
TAGGED = ["READY", "NEEDS_RELEASE", "REVIEW"]
_HIDDEN = ["attempts", "retries", "failures", "bad_category", "needs_convert", "lines", "description", "keywords", "near_duplicate_of", "archive_name", "staged"]


def _existing(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(d, n) for d in FOLDERS[:-1] for n in sorted(os.listdir(os.path.join(folder, d)))]
    return spark.createDataFrame(rows, "destination string, existing_name string")


def run(spark: SparkSession, folder: str, make: Callable[[], calls.Provider], settings: Settings | None = None, tool: str | None = None, after: Callable[[str], None] = lambda step: None) -> dict:
    """Process one batch of the folder and give its run document.  The folder is on storage that every executor mounts.

    Each step's result is a table before the next one starts, so calls are made once.  after: told the name of each step that
    is done; what it raises ends the run there, as a crash would.
    """
    s, start = settings or Settings(), time.time()
    folder = os.path.abspath(folder)
    effects.ensure_dirs(folder, FOLDERS)
    base = _registry(folder)
    publish(spark, folder, after)
    number = ledger.next_number(spark, base)
    _clean(folder, number)
    before = ledger.read(spark, base, REGISTRY)

    def table(df: DataFrame, name: str) -> DataFrame:
        out = written(df, f"file://{_own(folder, number)}/{name}")
        after(name)
        return out

    listed = files.list_assets(spark, folder, content=False).select("name", "length")
    pending = table(state.pending(listed, before, max_attempts=s.max_attempts), "pending")
    few = [r.name for r in state.batch(pending, limit=s.batch_limit).collect()]  # at most batch_limit
    if not few:
        _clean(folder, number)
        return {}
    work = os.path.join(folder, REPORTS, f"view-{uuid.uuid4().hex}")
    try:
        seen = images.probe(spark, images.view(folder, few, work))
        hashed = files.list_assets(spark, folder, names=few).select("name", "length", sha256(F.col("content")).alias("sha256"))
        assets = table(hashed.join(seen, "name", "left"), "assets")
    finally:
        shutil.rmtree(work)
    index = _index(spark, folder) if s.near_scope == "all" else None
    gated = table(batch.gate(assets, before, s, index, number), "gated")
    items, refused, prepared = _prepare(spark, folder, number, gated, s)
    after("prepared")
    tried = table(calls.attempts(items, make, s).union(refused), "attempts")

    existing = _existing(spark, folder)
    staged = spark.createDataFrame([(o, f"prepared-{o}") for o in prepared], "ord int, _prepared string")
    untagged = None
    if tool:
        judged = batch.finish(gated, tried, s, existing).join(staged, "ord", "left")
        untagged = table(effects.stage_tags(_tag_plan(judged, number), folder, tool), "tagged")
    done = batch.finish(gated, tried, s, existing, untagged).join(staged, "ord", "left")
    copy = F.when(F.col("status").isin(TAGGED), F.concat(F.lit("copy-"), F.col("ord").cast("string"))) if tool else F.lit(None)
    used = F.when(F.col("status").isin(sinks.USED), F.col("_prepared"))
    done = table(done.withColumn("staged", F.coalesce(copy, used)).drop("_prepared"), "records")

    said = tried.where(F.col("error_text").isNotNull()).where(error_kind(F.col("error_text")) == "quota").select("name", "error_text").first()
    delta = batch.registry_rows(done, number)
    remaining = state.pending(pending.select("name"), state.upsert(before, delta), max_attempts=s.max_attempts).agg(F.count("*"))
    summary = table(report.document(done, remaining, s, folder, time.time() - start, said is not None), "document")
    _commit(spark, folder, number, delta, quota=said and f"QUOTA | {said.name} | {said.error_text}", threshold=s.hash_threshold if s.near_scope == "all" else None)
    after("committed")
    out = summary.first().asDict()
    publish(spark, folder, after)
    if ledger.compact(spark, base, REGISTRY):
        after("compacted")
    return out


def publish(spark: SparkSession, folder: str, after: Callable[[str], None] = lambda step: None) -> None:
    """Carry out what committed runs have left, oldest first."""
    folder = os.path.abspath(folder)
    while waiting := ledger.unfinished(spark, _registry(folder)):
        _publish(spark, folder, waiting[0], after)


def _registry(folder: str) -> str:
    return f"file://{os.path.join(folder, REPORTS, 'registry')}"


def _own(folder: str, number: int) -> str:
    return os.path.join(folder, REPORTS, "runs", str(number))


def _clean(folder: str, number: int) -> None:
    """Delete the tables of runs that are published, and of one with this number that was cut off before its commit."""
    runs = os.path.join(folder, REPORTS, "runs")
    for name in os.listdir(runs) if os.path.isdir(runs) else []:
        if int(name) <= number:
            shutil.rmtree(os.path.join(runs, name))
    os.makedirs(_own(folder, number))


def _prepare(spark: SparkSession, folder: str, number: int, gated: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, list[int]]:
    """(pictures for the provider, the failed attempts of those that can't be decoded, the items that have a smaller file)."""
    codec, rows, broken, prepared = images.JvmCodec(spark), [], [], []
    for r in gated.where("called").orderBy("ord").collect():  # at most batch_limit, one file in memory at a time
        with open(os.path.join(folder, r.name), "rb") as f:
            content = f.read()
        try:
            smaller = images.normalise(content, r.name, s.max_file_mb << 20, codec.encode) if r.needs_convert else None
            rows.append((r.ord, r.name, codec.fit(smaller or content, s.max_side)))
        except Exception as e:  # noqa: BLE001  a file that can't be decoded is an item's error
            broken.append((r.name, s.call_attempts, None, str(e)[:300]))
        else:
            if smaller:
                with open(os.path.join(_own(folder, number), f"prepared-{r.ord}"), "wb") as f:
                    f.write(smaller)
                prepared.append(r.ord)
    return spark.createDataFrame(rows, "ord int, name string, image binary"), spark.createDataFrame(broken, calls.ATTEMPTS), prepared


def _tag_plan(judged: DataFrame, number: int) -> DataFrame:
    """name, source, copy, tags of the items that get tags."""
    own = f"{REPORTS}/runs/{number}/"
    chosen = judged.where(F.col("status").isin(TAGGED))
    lists = sinks.tags(chosen.withColumn("final_name", F.col("original_name"))).groupBy("name").agg(F.collect_list(F.struct("tag", "value")).alias("tags"))
    source = F.coalesce(F.concat(F.lit(own), F.col("_prepared")), F.col("original_name"))
    rows = chosen.select(F.col("original_name").alias("name"), source.alias("source"), F.concat(F.lit(f"{own}copy-"), F.col("ord").cast("string")).alias("copy"))
    return rows.join(lists, "name")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.read(spark, f"{_registry(folder)}-fingerprints", dedup.INDEX, key=None)


def _commit(spark: SparkSession, folder: str, number: int, delta: DataFrame, quota: str | None, threshold: int | None) -> None:
    """The registry's new entries, and with them the plan: the run's records, and where the files that grow end now.

    threshold: of the near duplicates of all runs, where the run adds to their index.
    """
    sizes = {name: effects.size_of(os.path.join(folder, REPORTS, name)) for name in ("upload.csv", "needs_review.txt")}
    ledger.commit(delta, _registry(folder), outbox={"quota": quota, "sizes": sizes, "threshold": threshold}, number=number)


def _publish(spark: SparkSession, folder: str, commit: ledger.Commit, after: Callable[[str], None]) -> None:
    own, reports, number = f"file://{_own(folder, commit.number)}", os.path.join(folder, REPORTS), commit.number
    done = spark.read.parquet(f"{own}/records")
    moved = written(effects.apply_files(sinks.file_effects(done, f"{REPORTS}/runs/{number}"), folder), f"{own}/moved")
    after("moved")
    # A name that someone else has taken since it was planned: the item gets the next free one, by a commit of its own.
    taken = done.join(moved.where(F.col("done") == "name taken").select("ord").distinct(), "ord", "left_semi")
    if not taken.isEmpty():
        _rename(spark, folder, number, taken)
        done = done.join(taken.select("ord"), "ord", "left_anti")
        after("renamed")
    sizes, text = commit.outbox["sizes"], lambda rows: "".join(r.value for r in rows.collect()).encode()  # at most batch_limit rows
    rows = sinks.upload_rows(done, "ord").orderBy("ord").select(F.concat(sinks.quoted_line(UPLOAD_COLUMNS), F.lit("\r\n")).alias("value"))
    if upload := text(rows):
        effects.append(os.path.join(reports, "upload.csv"), sizes["upload.csv"], (",".join(UPLOAD_COLUMNS) + "\r\n").encode(), upload)
    after("uploaded")
    if commit.outbox.get("renames"):
        return _finish(spark, folder, number, after)
    everything = spark.read.parquet(f"{own}/records")
    lines = everything.select("ord", F.posexplode("lines").alias("seq", "line")).orderBy("ord", "seq").select(F.concat(trim_lines(F.col("line")), F.lit("\n")).alias("value"))
    quota, threshold = commit.outbox["quota"], commit.outbox["threshold"]
    if log := text(lines) + (f"{quota.rstrip(chr(10))}\n".encode() if quota else b""):
        effects.append(os.path.join(reports, "needs_review.txt"), sizes["needs_review.txt"], b"", log)
    after("logged")
    kept = f"{_registry(folder)}-fingerprints"
    if threshold is not None and (ledger.committed_batch(spark, kept) or 0) < number:
        new = batch.indexed(spark.read.parquet(f"{own}/gated"), everything, _index(spark, folder), number, Settings(hash_threshold=threshold))
        ledger.commit(new, kept, batch=number)
        ledger.compact(spark, kept, dedup.INDEX, key=None)
    after("indexed")
    sinks.write_report(everything, f"file://{reports}/report.csv")
    sinks.write_document(spark.read.parquet(f"{own}/document"), everything.drop(*_HIDDEN), f"file://{reports}/report.json")
    after("reported")
    return _finish(spark, folder, number, after)


def _finish(spark: SparkSession, folder: str, number: int, after: Callable[[str], None]) -> None:
    ledger.finish(spark, _registry(folder), number)
    after("finished")
    later = [c for c in ledger.unfinished(spark, _registry(folder)) if (c.outbox.get("renames") or 0) == number]
    if not later:  # a commit with new names still needs this run's copies
        shutil.rmtree(_own(folder, number), ignore_errors=True)


def _rename(spark: SparkSession, folder: str, number: int, taken: DataFrame) -> None:
    """Plan the same files under free names, as a commit with entries and effects of its own."""
    new = ledger.next_number(spark, _registry(folder))
    shutil.rmtree(_own(folder, new), ignore_errors=True)
    names = F.array(F.struct("destination", F.col("final_name").alias("base")), F.struct(F.lit(ORIGINALS).alias("destination"), F.col("archive_name").alias("base")))
    wanted = taken.select("ord", F.explode(F.filter(names, lambda x: x["base"].isNotNull())).alias("w")).select("ord", "w.*")
    free = naming.unique_fold(wanted, "destination", "base", "ord", _existing(spark, folder)).select("ord", F.col("destination").alias("_to"), "unique_name")
    pick = lambda archive: F.max(F.when((F.col("_to") == ORIGINALS) == archive, F.col("unique_name")))
    free = free.groupBy("ord").agg(pick(F.lit(False)).alias("_final"), pick(F.lit(True)).alias("_archive"))
    staged = F.when(F.col("staged").isNotNull(), F.concat(F.lit(f"../{number}/"), F.col("staged")))
    rows = taken.join(free, "ord").withColumns({"final_name": F.col("_final"), "archive_name": F.col("_archive"), "staged": staged}).select(*taken.columns)
    rows = written(rows, f"file://{_own(folder, new)}/records")
    sizes = {"upload.csv": effects.size_of(os.path.join(folder, REPORTS, "upload.csv"))}
    ledger.commit(batch.registry_rows(rows, new), _registry(folder), outbox={"renames": number, "quota": None, "sizes": sizes}, number=new)
