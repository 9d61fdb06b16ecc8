"""Filter interaction audit: what each filter takes out, alone and behind others, in every order of the filters.

The orders are replayed over the documents: each document's failures meet all orders, which are broadcast (their number is
the factorial of the number of filters and rests on no table), each order gives its steps, and the first step whose filter
the document fails removes it.  Counts are summed within each task before anything is exchanged, so that the exchange holds
one row per task, part, order and step, however many documents a part has.

Copies are found by an aggregation with partial sums and joined back.  Documents whose text very many rows share (at most
HOT_TEXTS texts, by the least number of rows that makes one hot) take their text's first id from a broadcast and go through
the join under keys of their own, so that no task holds them all.

Edge cases: null and empty texts have no words, hold no character, and are copies of each other; a null source is the part
'' and an own part has no other name; a null doc_id is no smaller id, its row is no copy, and it has no labels; equal rows
count one by one, and equal doc_ids are not smaller than each other; of several label rows of a doc_id one that says 1 is
enough; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: A text is hot from so many rows, and from 1 / HOT_TEXTS of all rows: at most HOT_TEXTS texts are.
HOT_ROWS, HOT_TEXTS = 50_000, 5_000
#: Documents that one task replays: each becomes 600 rows there.
TASK_ROWS = 20_000
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"


def copies(docs: DataFrame, key: str, order: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds is_copy: whether a row with a smaller `order` has the same key.  Keys are binary digests."""
    groups = docs.where(F.col(order).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    limit = max(hot_rows, docs.select(order).count() // HOT_TEXTS)
    hot = groups.where(F.col("_rows") > limit).select(F.col("_key").alias("_hot"), F.col("_first").alias("_hot_first"))
    rows = docs.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    own = F.encode(F.concat(F.lit("row "), F.coalesce(F.col(order).cast("string"), F.lit(""))), "utf-8")
    rows = rows.withColumn("_at", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(own))
    rows = rows.join(groups.where(F.col("_rows") <= limit), F.col("_at") == F.col("_key"), "left")
    smaller = F.coalesce("_hot_first", "_first") < F.col(order)
    return rows.withColumn("is_copy", F.coalesce(smaller, F.lit(False))).drop("_key", "_first", "_rows", "_hot", "_hot_first", "_at")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bit i: the filter FILTERS[i] fails), good, toxic, for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split("text", BETWEEN_WORDS), "")
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    # Counts in a projection of their own, so that each text's words are found once.
    read = read.select("doc_id", "part", "text", F.unhex(F.sha2("text", 256)).alias("digest"), words.alias("words"))
    n, capitals = F.size("words"), F.regexp_count("text", F.lit("[A-Z]"))
    conditions = [n < 200, 100 * F.size(F.array_distinct("words")) < 50 * n, 100 * capitals > 2 * F.length("text"), F.col("text").rlike(r"[#$%&*|]")]
    flagged = read.select("doc_id", "part", "digest", _mask(conditions).alias("fails"))
    marked = copies(flagged, "digest", "doc_id")
    fails = F.col("fails") + F.when(F.col("is_copy"), 1 << len(conditions)).otherwise(0)
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    told = labels.groupBy(F.col("doc_id").alias("_id")).agg(says("quality"), says("toxic"))
    joined = marked.join(told, F.col("doc_id") == F.col("_id"), "left")
    return joined.select("part", fails.alias("fails"), F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _mask(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for i, c in enumerate(conditions):
        out = out + F.when(c, 1 << i).otherwise(0)
    return out


def orders(spark: SparkSession, letters: str = FILTERS) -> DataFrame:
    """One row per order: order_id, and four bits each of `at` (the filter of each step) and of `turns` (the step of each filter)."""
    rows = []
    for k, p in enumerate(permutations(range(len(letters)))):
        rows.append((k, sum(i << 4 * step for step, i in enumerate(p)), sum((step + 1) << 4 * i for step, i in enumerate(p))))
    return spark.createDataFrame(rows, "order_id int, at int, turns int")


def _four(packed: Column, place: Column) -> Column:
    return F.call_function("shiftright", packed, place * 4).bitwiseAND(15)


def replay(flags: DataFrame, letters: str = FILTERS, tasks: int | None = None) -> DataFrame:
    """One row per part, filter_order and step, with the counts of documents.  flags: part, fails, good, toxic; up to 7 filters.

    tasks: how many to deal the rows to, evenly, as each row here is n! * n rows below.
    """
    n = len(letters)
    dealt = flags.repartition(tasks) if tasks else flags
    crossed = dealt.crossJoin(F.broadcast(orders(flags.sparkSession, letters)))
    first = F.least(*[F.when(F.col("fails").bitwiseAND(1 << i) != 0, _four(F.col("turns"), F.lit(i))).otherwise(n + 1) for i in range(n)])
    steps = crossed.withColumn("first", first).withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(n)])))
    steps = steps.withColumn("bit", F.call_function("shiftleft", F.lit(1), _four(F.col("at"), F.col("step") - 1)))
    removed, failed = F.col("first") == F.col("step"), F.col("fails").bitwiseAND(F.col("bit")) != 0
    counts = {
        "kept": F.col("first") > F.col("step"), "removed": removed, "redundant": failed & (F.col("first") < F.col("step")),
        "unique_fails": F.col("fails") == F.col("bit"), "good_lost": removed & F.col("good"), "toxic_lost": removed & F.col("toxic"),
    }
    summed = steps.groupBy("part", "order_id", "step").agg(F.first("at").alias("at"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    summed = summed.withColumn("filter", _four(F.col("at"), F.col("step") - 1))
    names = F.array(*[F.lit("".join(letters[i] for i in p)) for p in permutations(range(n))])
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return summed.select("part", F.get(names, F.col("order_id")).alias("filter_order"), "step", *counts, shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return replay(failures(docs, labels), tasks=max(docs.sparkSession.sparkContext.defaultParallelism, docs.count() // TASK_ROWS))
