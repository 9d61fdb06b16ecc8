"""Collision-free names, as one item after another would take them, without a task that holds a hot name.

An item takes its own name if that is free, and else the name with the least free number from 2.  A number of a name can be
taken by what exists, or by an item whose own name looks like that (`a-2` for `a`); nobody else makes that name.  So of each
name only two things have to be found out: whether its first item finds it free, and which of its numbers are gone when it comes
to them.  Both are settled among the contested names alone, shortest first: one row per distinct name, and of the items of a
hot name the first few.  Then an item's number is its rank among the items of its name, counted over the numbers that are
free; both are scans over range partitions.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stem, suffix
from ..sources.store import shared, written
from .ranges import running_sum

#: A stem that another one makes: the stem before it, and a number from 2.
_NUMBERED = r"(?s)^(.+)-([2-9]|[1-9][0-9]{1,8})$"
_SETTLED = "_group string, _name string, _number long, _by string"


def _numbered(base: Column, number: Column, tail: Column) -> Column:
    return F.concat(base, F.lit("-"), number.cast("string"), tail)


def unique_fast(df: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Adds unique_name by counting equal names.  Right only where no stem ends in -<digits> and nothing exists yet."""
    ranked = running_sum(df, [group, name], [order], F.lit(1), "_rank")
    numbered = _numbered(stem(F.col(name)), F.col("_rank"), suffix(F.col(name)))
    return ranked.withColumn("unique_name", F.when(F.col("_rank") == 1, F.col(name)).otherwise(numbered)).drop("_rank")


def _settle(rows: pa.Table) -> pa.Table:
    """Of one name: which of its numbers are gone when its items come to them.

    rows: _kind 0: _number has existed before; 1: an item whose own name is that number comes first at _place; 2: the item that
    takes the _number-th number comes at _place.  Gives the numbers, and by whom they are taken: it (the name's items, before the
    other's first one comes), or gone.
    """
    kinds, numbers, places = (rows.column(c).to_pylist() for c in ("_kind", "_number", "_place"))
    existing = {n for k, n in zip(kinds, numbers, strict=True) if k == 0}
    first = {n: p for k, n, p in zip(kinds, numbers, places, strict=True) if k == 1}
    comes = {n: p for k, n, p in zip(kinds, numbers, places, strict=True) if k == 2}
    out, gone = [], 0
    for number in sorted(existing | first.keys()):
        if number in existing:
            gone += 1
            continue
        at = comes.get(number - 1 - gone)
        taken = at is not None and at < first[number]
        gone += not taken
        out.append((number, "it" if taken else "gone"))
    group, name = rows.column("_group")[0], rows.column("_name")[0]
    columns = [pa.array([x.as_py()] * len(out), pa.string()) for x in (group, name)] + [pa.array([n for n, _ in out], pa.int64()), pa.array([b for _, b in out], pa.string())]
    return pa.Table.from_arrays(columns, ["_group", "_name", "_number", "_by"])


def unique_exact(df: DataFrame, group: str, name: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Adds unique_name.  existing: (group, existing_name) of names that are taken; order: whole numbers that tell rows apart."""
    spark = df.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # a null is a group of its own
    items = df.withColumns({"_group": key, "_name": F.col(name)})
    items = written(running_sum(items, ["_group", "_name"], [order], F.lit(1), "_rank"), shared(spark, "items"))
    there = spark.createDataFrame([], "_group string, _name string")
    if existing is not None:
        there = existing.select(key.alias("_group"), F.col("existing_name").alias("_name")).distinct()
    there = written(there, shared(spark, "existing"))
    names = items.groupBy("_group", "_name").agg(F.min(order).cast("long").alias("_place"), F.count("*").alias("_items"))
    names = written(names.join(there.withColumn("_exists", F.lit(True)), ["_group", "_name"], "left").withColumn("_exists", F.coalesce("_exists", F.lit(False))), shared(spark, "names"))

    def parents(rows: DataFrame) -> DataFrame:
        """Rows whose name is a number of another: _group, _name (the other), _number, and their own columns."""
        base, tail = stem(F.col("_name")), suffix(F.col("_name"))
        number = F.regexp_extract(base, _NUMBERED, 2)
        own = rows.withColumns({"_number": F.when(number != "", number).cast("long"), "_child": F.col("_name")})
        return own.where("_number is not null").withColumn("_name", F.concat(F.regexp_extract(base, _NUMBERED, 1), tail))

    # Numbers that exist, and those that are others' own names, of names that have items here.
    have = names.select("_group", "_name", "_items", F.col("_exists").alias("_taken"))
    old = parents(there).join(have.select("_group", "_name"), ["_group", "_name"], "left_semi").select("_group", "_name", "_number")
    contested = parents(names.where("not _exists").select("_group", "_name", "_place")).join(have, ["_group", "_name"])
    # A number beyond all that the items can come to is not contested.
    n_old = old.groupBy("_group", "_name").agg(F.count("*").alias("_old"))
    n_new = contested.groupBy("_group", "_name").agg(F.count("*").alias("_new"))
    contested = contested.join(n_old, ["_group", "_name"], "left").join(n_new, ["_group", "_name"])
    contested = written(contested.where(F.col("_number") <= F.col("_items") + F.coalesce("_old", F.lit(0)) + F.col("_new") + 1).select("_group", "_name", "_number", "_place", "_child", "_taken"), shared(spark, "contested"))

    lost = spark.createDataFrame([], "_group string, _name string")  # names that others' items took before their first item came
    settled = spark.createDataFrame([], _SETTLED)
    dashes = F.regexp_extract(stem(F.col("_name")), r"((?:-(?:[2-9]|[1-9][0-9]{1,8}))*)$", 1)
    depth = F.length(dashes) - F.length(F.replace(dashes, F.lit("-"), F.lit("")))
    contested = contested.withColumn("_depth", depth)
    for level in sorted(r[0] for r in contested.select("_depth").distinct().collect()):  # a handful: dashes at the end of names
        own = contested.where(F.col("_depth") == level)
        last = own.groupBy("_group", "_name").agg(F.max("_number").alias("_last"), F.first("_taken").alias("_taken"))
        last = last.join(lost.withColumn("_lost", F.lit(True)), ["_group", "_name"], "left")
        # The item that takes the n-th number: one later where the first item has the name itself.
        ahead = F.when(F.col("_taken") | F.coalesce("_lost", F.lit(False)), 0).otherwise(1)
        few = items.join(last, ["_group", "_name"]).where((F.col("_rank") > ahead) & (F.col("_rank") - ahead < F.col("_last")))
        few = few.select("_group", "_name", F.lit(2).alias("_kind"), (F.col("_rank") - ahead).alias("_number"), F.col(order).cast("long").alias("_place"))
        before = old.join(last, ["_group", "_name"]).where(F.col("_number") <= F.col("_last")).select("_group", "_name", F.lit(0).alias("_kind"), "_number", F.lit(None).cast("long").alias("_place"))
        events = few.union(before).union(own.select("_group", "_name", F.lit(1).alias("_kind"), "_number", "_place"))
        done = written(events.groupBy("_group", "_name").applyInArrow(_settle, _SETTLED), shared(spark, "settled"))
        settled = settled.union(done)
        taken = own.join(done.where("_by = 'it'").select("_group", "_name", "_number"), ["_group", "_name", "_number"])
        lost = lost.union(taken.select("_group", F.col("_child").alias("_name")))

    free = have.join(lost.withColumn("_lost", F.lit(True)), ["_group", "_name"], "left")
    free = free.select("_group", "_name", F.when(F.col("_taken") | F.coalesce("_lost", F.lit(False)), 0).otherwise(1).alias("_ahead"))
    gone = old.union(settled.where("_by = 'gone'").select("_group", "_name", "_number"))
    gone = running_sum(gone, ["_group", "_name"], ["_number"], F.lit(1), "_gone")
    # Of the n-th free number, those gone below it are the ones with fewer than n free numbers below them.
    steps = gone.select("_group", "_name", (F.col("_number") - 1 - F.col("_gone")).alias("_n"), F.lit(1).alias("_mark"), F.lit(None).cast("long").alias("_rank"), F.col("_number").alias("_tie"))
    wanted = items.select("_group", "_name", "_rank").join(free, ["_group", "_name"])
    wanted = wanted.select("_group", "_name", (F.col("_rank") - F.col("_ahead")).alias("_n"), F.lit(0).alias("_mark"), F.col("_rank").cast("long").alias("_rank"), F.lit(0).cast("long").alias("_tie"))
    counted = running_sum(wanted.union(steps), ["_group", "_name"], ["_n", "_mark", "_tie"], F.col("_mark"), "_below").where("_mark = 0")
    out = items.join(counted.select("_group", "_name", "_rank", "_n", "_below"), [items["_group"].eqNullSafe(counted["_group"]), items["_name"] == counted["_name"], items["_rank"] == counted["_rank"]])
    number = F.col("_n") + 1 + F.col("_below")
    return out.select(*[items[c] for c in df.columns], F.when(F.col("_n") == 0, items[name]).otherwise(_numbered(stem(items[name]), number, suffix(items[name]))).alias("unique_name"))


def unique_fold(df: DataFrame, group: str, name: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """The same as unique_exact by a fold per root, for a table whose roots are small, such as the batch of a run.

    Names can only meet names with the same root (the stem without trailing -<digits>).
    """
    root = F.regexp_replace(stem(F.col(name)), r"(-\d+)+$", "")
    schema = T.StructType([*df.schema.fields, T.StructField("unique_name", T.StringType())])
    rows = df.withColumn("_root", F.concat(root, suffix(F.col(name)))).withColumn("_taken", F.lit(False))
    if existing is not None:
        old = existing.select(F.col(group), F.col("existing_name").alias(name), F.lit(True).alias("_taken"))
        old = old.withColumn("_root", F.concat(F.regexp_replace(stem(F.col(name)), r"(-\d+)+$", ""), suffix(F.col(name))))
        rows = rows.unionByName(old, allowMissingColumns=True)
    columns = df.columns

    def fold(rows: pa.Table) -> pa.Table:
        old = rows.column("_taken")
        used, next_free, out = set(rows.filter(old).column(name).to_pylist()), {}, []
        rows = rows.filter(pc.invert(old)).sort_by(order)
        for n in rows.column(name).to_pylist():
            cut = re.match(r"(?s)^(.+)(\.[^.]+)$", n)
            base, tail = (cut[1], cut[2]) if cut else (n, "")
            pick, k = n, next_free.get(n, 2)
            while pick in used:
                pick, k = f"{base}-{k}{tail}", k + 1
            next_free[n] = k
            used.add(pick)
            out.append(pick)
        return rows.select(columns).append_column("unique_name", pa.array(out, pa.string()))

    return rows.groupBy(group, "_root").applyInArrow(fold, schema)
