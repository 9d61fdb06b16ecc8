"""Writers: upload and report tables, review log, report document, tags, and the files that a run moves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ORIGINALS, REPORT_COLUMNS, UPLOAD_COLUMNS
from ..functions.arrays import join_nonempty
from ..functions.text import trim_lines
from .store import file_system

_FLAGS = REPORT_COLUMNS[10:13]
#: Statuses whose prepared file is used, and so their original archived.
USED = ["READY", "LOW_QUALITY", "NEEDS_RELEASE", "REVIEW"]


def upload_rows(records: DataFrame, *keep: str) -> DataFrame:
    """Accepted items; the description holds the title; keep: further columns."""
    ready = records.where(F.col("status") == "READY")
    return ready.select(
        *keep, F.col("final_name").alias("Filename"), F.col("title").alias("Description"),
        F.array_join("keywords", ", ").alias("Keywords"), join_nonempty(F.col("category"), F.col("category2")).alias("Categories"),
    )


def report_rows(records: DataFrame, *keep: str) -> DataFrame:
    """The report's columns as text; keep: further columns."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c not in _FLAGS else F.initcap(F.coalesce(F.col(c), F.lit(False)).cast("string")).alias(c) for c in REPORT_COLUMNS]
    return records.select(*keep, *text)


def quoted_line(columns: list[str]) -> Column:
    """A CSV line of text columns without its end, with quotes only where a field needs them."""

    def field(name: str) -> Column:
        c = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        return F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.concat_ws(",", *[field(c) for c in columns])


def write_file(parts: list[DataFrame], path: str, end: str = "\n") -> None:
    """One text file of the parts' rows, each part in its own order, put in place by a rename.

    parts: frames of `at` (something to sort by) and `value`.  One task writes them, sorted with spilling; nothing is collected.
    """
    spark = parts[0].sparkSession
    rows = parts[0].select(F.lit(0).alias("part"), F.col("at").cast("long").alias("at"), "value")
    for i, df in enumerate(parts[1:], 1):
        rows = rows.union(df.select(F.lit(i), F.col("at").cast("long"), "value"))
    work = f"{path}.{uuid.uuid4().hex}"
    rows.repartition(1).sortWithinPartitions("part", "at").select("value").write.option("lineSep", end).text(work)
    fs, make = file_system(spark, path)
    found = fs.globStatus(make(f"{work}/part-*"))
    if fs.exists(make(path)):
        fs.delete(make(path), False)
    fs.rename(found[0].getPath(), make(path))
    fs.delete(make(work), True)


def _one(spark: SparkSession, value: str) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("at"), F.lit(value).alias("value"))


def write_upload(records: DataFrame, path: str, run: int) -> None:
    """Append a run's accepted items, in order; a repeated run replaces what it wrote."""
    rows = upload_rows(records, "ord").select(F.col("ord").alias("at"), quoted_line(UPLOAD_COLUMNS).alias("value"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}")


def export_upload(spark: SparkSession, path: str, file: str) -> None:
    """All runs' accepted items as one CSV file with one header."""
    runs = spark.read.parquet(path).select((F.col("run").cast("long") * F.lit(1 << 40) + F.col("at")).alias("at"), "value")
    write_file([_one(spark, ",".join(UPLOAD_COLUMNS)), runs], file, "\r\n")


def write_report(records: DataFrame, file: str) -> None:
    """The report's CSV file, overwritten."""
    rows = report_rows(records, F.col("ord").alias("_at"))
    lines = rows.select(F.col("_at").alias("at"), quoted_line(REPORT_COLUMNS).alias("value"))
    write_file([_one(records.sparkSession, ",".join(REPORT_COLUMNS)), lines], file, "\r\n")


def write_log(lines: DataFrame, path: str, run: int) -> None:
    """Append a run's lines (ord, seq, line), in order and without line ends of their own; a repeated run replaces its own."""
    value = trim_lines(F.col("line")).alias("value")
    lines.coalesce(1).sortWithinPartitions("ord", "seq").select("ord", "seq", value).write.mode("overwrite").parquet(f"{path}/run={run}")


def export_log(spark: SparkSession, path: str, file: str) -> None:
    """All runs' lines as one text file."""
    at = F.col("run").cast("long") * F.lit(1 << 40) + F.col("ord").cast("long") * 1000 + F.col("seq")
    write_file([spark.read.parquet(path).select(at.alias("at"), "value")], file)


def write_document(summary: DataFrame, records: DataFrame, file: str) -> None:
    """One JSON document: the summary with its nulls, and the items in order (ord) without theirs."""
    spark = records.sparkSession
    fields = [c for c in records.columns if c != "ord"]
    first = records.agg(F.min("ord").alias("_first"))
    items = records.select(F.col("ord").alias("at"), F.to_json(F.struct(*fields)).alias("item")).join(F.broadcast(first))
    items = items.select("at", F.concat(F.when(F.col("at") == F.col("_first"), "").otherwise(","), "item").alias("value"))
    head = summary.select(F.lit(0).alias("at"), F.concat(F.lit('{"summary": '), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), F.lit(', "items": [')).alias("value"))
    write_file([head, items, _one(spark, "]}")], file)


def tags(records: DataFrame) -> DataFrame:
    """name, tag, value for each embedded tag; keywords under both of their tags."""
    eligible = records.where(F.col("status").isin("READY", "NEEDS_RELEASE", "REVIEW"))
    pair = lambda tag, value: F.struct(F.lit(tag).alias("tag"), value.alias("value"))
    title, text = F.col("title"), F.col("description")
    single = [("Title", title), ("Description", text), ("Caption-Abstract", text), ("XMP-dc:Title", title), ("XMP-dc:Description", text)]
    words = F.flatten(F.transform("keywords", lambda k: F.array(pair("Keywords", k), pair("XMP-dc:Subject", k))))
    rows = eligible.select(F.col("final_name").alias("name"), F.explode(F.concat(F.array(*[pair(t, v) for t, v in single]), words)).alias("t"))
    return rows.select("name", "t.tag", "t.value")


def moves(records: DataFrame) -> DataFrame:
    """name, destination, final_name for every file that moves; files that were converted and used archive their original too."""
    own = F.struct(F.col("destination"), F.col("final_name"))
    old = F.struct(F.lit(ORIGINALS).alias("destination"), F.col("original_name").alias("final_name"))
    both = F.when(F.col("needs_convert") & F.col("status").isin(USED), F.array(own, old)).otherwise(F.array(own))
    rows = records.where(~F.col("status").startswith("ERROR")).select("original_name", F.explode(both).alias("m"))
    return rows.select("original_name", "m.destination", "m.final_name")


def file_effects(records: DataFrame, work: str) -> DataFrame:
    """ord, seq, kind, source, target: what happens to each record's files, in order, as paths below the run's folder.

    A prepared or tagged copy (`staged`, below the work folder) takes the planned name, and then its original is archived if it was
    converted, and dropped otherwise; a file without a copy moves itself.
    """
    target = F.concat_ws("/", "destination", "final_name")
    step = lambda seq, kind, source, to: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), source.alias("source"), to.alias("target"))
    copy = F.concat(F.lit(f"{work}/"), F.col("staged"))
    archive = step(1, "move", F.col("original_name"), F.concat(F.lit(ORIGINALS + "/"), F.coalesce("archive_name", "original_name")))
    used = F.col("needs_convert") & F.col("status").isin(USED)
    steps = (
        F.when(F.col("staged").isNotNull() & used, F.array(step(0, "move", copy, target), archive))
        .when(F.col("staged").isNotNull(), F.array(step(0, "move", copy, target), step(1, "drop", F.col("original_name"), target)))
        .otherwise(F.array(step(0, "move", F.col("original_name"), target)))
    )
    return records.where("destination is not null").select("ord", F.explode(steps).alias("s")).select("ord", "s.*")
