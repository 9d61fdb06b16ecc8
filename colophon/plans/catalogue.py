"""Queries over the driver's tables, one or more per operator, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORIES, STATUSES, Settings
from ..functions import annotation, arrays, hashing, text
from ..operators import classify, dedup, naming, registry, report
from ..sources import ledger, sinks
from ..sources.store import shared, spread, written
from . import batch

_CATS = ", ".join(f"'{c}'" for c in CATEGORIES)


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Assets made from documents and labels by rules both engines share.
_ASSETS_SQL = f"""
a0 AS (SELECT d.doc_id, d.source, d.text, d.n_chars, l.quality, l.toxic,
  row_number() OVER (PARTITION BY sha256(d.text) ORDER BY d.doc_id) AS dup_rank,
  first(d.doc_id) OVER (PARTITION BY sha256(d.text) ORDER BY d.doc_id) AS head
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
a1 AS (SELECT *, CAST(doc_id * 37 % 101 AS INTEGER) AS score,
  CASE doc_id % 5 WHEN 0 THEN 'Medium' WHEN 1 THEN 'High' ELSE 'Low' END AS risk,
  doc_id % 7 = 0 AS people, doc_id % 11 = 0 AS prop, coalesce(toxic, 0) = 1 AS mark,
  'doc' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PNG' ELSE '.jpg' END AS name FROM a0),
a2 AS (SELECT *, CASE WHEN dup_rank > 1 THEN 'DUPLICATE' WHEN n_chars < 300 THEN 'LOW_RESOLUTION' WHEN n_chars % 13 = 0 THEN CASE WHEN doc_id % 3 = 2 THEN 'ERROR_PERMANENT' ELSE 'ERROR' END WHEN mark OR score < 60 THEN 'LOW_QUALITY'
  WHEN people OR prop THEN 'NEEDS_RELEASE' WHEN risk IN ('Medium', 'High') THEN 'REVIEW' ELSE 'READY' END AS status FROM a1),
a3 AS (SELECT *, CASE WHEN status = 'DUPLICATE' THEN 'same text as doc' || head WHEN status = 'LOW_RESOLUTION' THEN 'too small'
  WHEN status LIKE 'ERROR%' THEN 'attempt ' || (doc_id % 3 + 1) WHEN mark THEN 'carries a visible overlay' WHEN status = 'READY' THEN 'accepted with score ' || score || ' and risk ' || risk
  WHEN status = 'LOW_QUALITY' THEN 'score ' || score || ' under 60' WHEN status = 'NEEDS_RELEASE' THEN 'shows people or property without a release'
  ELSE 'needs a look: risk ' || risk END AS reason,
  CASE status WHEN 'READY' THEN '01_READY_UPLOAD' WHEN 'LOW_RESOLUTION' THEN '02_SKIPPED_LOWRES' WHEN 'LOW_QUALITY' THEN '03_SKIPPED_LOWQUALITY'
  WHEN 'DUPLICATE' THEN '04_DUPLICATES' WHEN 'NEEDS_RELEASE' THEN '05_NEEDS_RELEASE' ELSE '06_REVIEW' END AS destination,
  'doc' || doc_id || CASE WHEN status IN ('READY', 'REVIEW', 'NEEDS_RELEASE', 'LOW_QUALITY') OR doc_id % 3 <> 0 THEN '.jpg' ELSE '.png' END AS final_name,
  list_distinct(['k' || doc_id % 10, 'k' || doc_id % 4, source]) AS kw FROM a2)"""


def _assets(spark, sf_dir) -> DataFrame:
    labels = _t(spark, sf_dir, "labels")
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", hashing.sha256(F.col("text").cast("binary")).alias("sha256"))
    d = dedup.exact(d, "sha256", "doc_id", "doc_id").join(labels, "doc_id", "left")
    i = F.col("doc_id")
    d = d.withColumns({
        "score": (i * 37 % 101).cast("int"), "risk": F.when(i % 5 == 0, "Medium").when(i % 5 == 1, "High").otherwise("Low"), "people": i % 7 == 0, "prop": i % 11 == 0,
        "mark": F.coalesce("toxic", F.lit(0)) == 1, "name": F.concat(F.lit("doc"), i.cast("string"), F.when(i % 3 == 0, ".PNG").otherwise(".jpg")),
    })
    chosen = classify.choose_status(F.col("score"), F.col("risk"), F.col("people"), F.col("prop"), F.col("mark"))
    failed, tries = registry.promote(i % 3)
    d = d.withColumn("status", F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE").when(F.col("n_chars") < 300, "LOW_RESOLUTION").when(F.col("n_chars") % 13 == 0, failed).otherwise(chosen))
    why = classify.explain_status(F.col("status"), F.col("score"), F.col("risk"), F.lit(""), F.col("mark"))
    own = F.when(F.col("status") == "DUPLICATE", F.concat(F.lit("same text as doc"), F.col("duplicate_of").cast("string"))).when(F.col("status") == "LOW_RESOLUTION", "too small").when(F.col("status").startswith("ERROR"), F.concat(F.lit("attempt "), tries.cast("string")))
    words = F.array_distinct(F.array(F.concat(F.lit("k"), (i % 10).cast("string")), F.concat(F.lit("k"), (i % 4).cast("string")), F.col("source")))
    return d.withColumns({
        "reason": F.coalesce(own, why), "destination": classify.destination(F.col("status")),
        "final_name": text.final_name(F.lit(""), F.col("name"), F.col("status")), "keywords": words, "keyword_count": F.size(words),
    })


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, sha256(text) AS sha256, CAST(row_number() OVER w AS INTEGER) AS dup_rank, CASE WHEN row_number() OVER w > 1 THEN first(doc_id) OVER w END AS duplicate_of FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)")
def exact_duplicates(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", hashing.sha256(F.col("text").cast("binary")).alias("sha256"))
    return dedup.ranked(d, "sha256", "doc_id", "doc_id")


_SIGNS = lambda half: " + ".join(f"CASE WHEN sum(({half} >> {i}) % 2 * 2 - 1) > 0 THEN CAST({1 << i} AS BIGINT) ELSE 0 END" for i in range(32))


_NEAR = f"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS w FROM documents),
h AS (SELECT doc_id, CAST('0x' || left(md5(w), 8) AS BIGINT) AS a, CAST('0x' || substr(md5(w), 9, 8) AS BIGINT) AS b FROM t),
f AS (SELECT doc_id, {_SIGNS('a')} AS a, {_SIGNS('b')} AS b FROM h GROUP BY doc_id)
SELECT d.doc_id, min(y.doc_id) AS near_duplicate_of FROM documents d LEFT JOIN f x ON x.doc_id = d.doc_id
LEFT JOIN f y ON y.doc_id < x.doc_id AND bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)) <= 6 GROUP BY d.doc_id"""


@query(_NEAR)
def near_duplicates(spark, sf_dir):
    """64-bit SimHash of the whole texts, compared within six bits."""
    f = dedup.fingerprints(spread(_t(spark, sf_dir, "documents").select("doc_id", "text")), "text", "doc_id")
    f = written(f, shared(spark, "fingerprints"))
    wordless = f.where("bits IS NULL").select("doc_id", F.lit(None).cast("long").alias("near_duplicate_of"))
    return dedup.near(f, "bits", "doc_id", "doc_id").union(wordless)


@query(_NEAR)
def near_duplicates_by_batch(spark, sf_dir):
    """The same over four batches, in order of doc_id: each is compared with itself and with a kept index of the earlier ones."""
    docs = spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    f = written(dedup.fingerprints(docs, "text", "doc_id"), shared(spark, "fingerprints"))
    low, high = f.agg(F.min("doc_id"), F.max("doc_id")).first()
    base, out = shared(spark, "index"), f.where("bits IS NULL").select("doc_id", F.lit(None).cast("long").alias("near_duplicate_of"))
    for number in range(4 if low is not None else 0):
        place = F.floor((F.col("doc_id") - low) * 4 / (high - low + 1))
        part = f.where((place == number) & F.col("bits").isNotNull()).withColumn("name", F.col("doc_id").cast("string"))
        found, new = dedup.near_all(part, ledger.read(spark, base, dedup.INDEX, key=None), "bits", "doc_id", "name")
        found = written(found, f"{base}-found/{number}")
        ledger.commit(new, base, batch=number)
        ledger.compact(spark, base, dedup.INDEX, key=None, every=2)
        out = out.union(found.select("doc_id", F.col("near_duplicate_of").cast("long")))
    return out


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def registry_log(spark, sf_dir):
    """The latest event of each user, from a registry that is committed in six parts by time and compacted on the way."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    base, schema = shared(spark, "registry"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    seconds = F.col("ts").cast("timestamp").cast("double")
    part = F.floor((seconds - F.lit(low).cast("timestamp").cast("double")) * 6 / (F.lit(high).cast("timestamp").cast("double") - F.lit(low).cast("timestamp").cast("double") + 1))
    for number in range(6 if low is not None else 0):
        own = e.where(part == number)
        delta = own.groupBy("user_id").agg(F.max_by(F.struct(*e.columns), F.struct("ts", "event_id")).alias("r")).select("r.*")
        ledger.commit(delta, base, batch=number)
        ledger.compact(spark, base, schema, "user_id", every=4)
    return ledger.read(spark, base, schema, "user_id").select("user_id", "event_type", "value")


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CASE WHEN v > (list_sort(embedding)[32] + list_sort(embedding)[33]) / CAST(2.0 AS DOUBLE) THEN '1' ELSE '0' END), '') AS bits FROM embeddings")
def fingerprint_embeddings(spark, sf_dir):
    values = F.transform("embedding", lambda v: v.cast("double"))
    return spread(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", hashing.median_bits(values).alias("bits"))


def _cosines() -> str:
    """The low 64 coefficients of an 8 x 8 grid whose cells are 4 x 4 pixels, as weights of the cells."""
    along = [[sum(math.cos(math.pi * (2 * (4 * x + k) + 1) * u / 64) for k in range(4)) for x in range(8)] for u in range(8)]
    return "[" + ", ".join("[" + ", ".join(f"{along[u][x] * along[v][y]!r}::DOUBLE" for x in range(8) for y in range(8)) + "]" for u in range(8) for v in range(8)) + "]"


@query(f"""WITH m AS (SELECT {_cosines()} AS w), c AS (SELECT vec_id, list_transform(w, lambda row: list_dot_product(row, CAST(embedding AS DOUBLE[]))) AS c FROM embeddings, m)
SELECT vec_id, array_to_string(list_transform(c, lambda v: CASE WHEN v > (list_sort(c)[32] + list_sort(c)[33]) / CAST(2.0 AS DOUBLE) THEN '1' ELSE '0' END), '') AS bits FROM c""")
def phash_grids(spark, sf_dir):
    """The perceptual hash of each vector as an 8 x 8 grid of cells of 4 x 4 pixels."""

    def run(it):
        for batch in it:
            cells = batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(-1, 8, 8)
            found = [f"{int(hashing.phash(np.kron(x, np.ones((4, 4)))), 16):064b}" for x in cells]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found)], ["vec_id", "bits"])

    return _t(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, bits string")


_STRIPPED = r"regexp_replace(w, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g')"


@query(rf"""SELECT doc_id, array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda w: {_STRIPPED}), lambda w: length(w) > 1), lambda w: [w])),
lambda acc, t: CASE WHEN len(acc) >= 50 OR list_contains(list_transform(acc, lambda k: lower(k)), lower(t[1])) OR (lower(t[1])[-1:] = 's' AND length(t[1]) > 3 AND list_contains(list_transform(acc, lambda k: lower(k)), left(lower(t[1]), length(t[1]) - 1)))
  OR list_contains(list_transform(acc, lambda k: lower(k)), lower(t[1]) || 's') THEN acc ELSE list_concat(acc, t) END), ',') AS keywords FROM documents""")
def clean_keywords(spark, sf_dir):
    """The words of each whole text as its keywords."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    docs = spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(arrays.clean_keywords(words), ",").alias("keywords"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
s AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85-]', '', 'g'), '[\s\p{Z}\x0b\x1c-\x1f\x85_]+', '-', 'g'), '-{2,}', '-', 'g'), '-') AS a FROM t)
SELECT page_id, coalesce(nullif(trim(left(coalesce(nullif(a, ''), 'image'), 80), '-'), ''), 'image') AS slug FROM s""")
def slugify_titles(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.slugify(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query(f"WITH {_ASSETS_SQL} SELECT doc_id, score, risk, status, reason FROM a3")
def classify_assets(spark, sf_dir):
    return _assets(spark, sf_dir).select("doc_id", "score", "risk", "status", "reason")


@query(f"WITH {_ASSETS_SQL} SELECT s.status, count(a3.doc_id) AS n FROM (VALUES {', '.join(f"('{s}')" for s in STATUSES)}) s(status) LEFT JOIN a3 ON a3.status = s.status GROUP BY s.status")
def status_summary(spark, sf_dir):
    return report.status_counts(_assets(spark, sf_dir))


@query(f"""WITH {_ASSETS_SQL} SELECT count(*) AS processed, count(*) FILTER (status = 'READY') AS ready, count(*) FILTER (status = 'LOW_QUALITY') AS low_quality, count(*) FILTER (status = 'DUPLICATE') AS duplicates,
count(*) FILTER (status = 'LOW_RESOLUTION') AS low_res, count(*) FILTER (status = 'NEEDS_RELEASE') AS needs_release, count(*) FILTER (status = 'REVIEW') AS review, count(*) FILTER (status LIKE 'ERROR%') AS errors,
round_even(avg(score) FILTER (status IN ('READY', 'LOW_QUALITY', 'NEEDS_RELEASE', 'REVIEW')), 1) AS average_score, round_even(avg(len(kw)) FILTER (status = 'READY'), 1) AS average_keywords,
round_even(100.0 * count(*) FILTER (status = 'READY' AND risk = 'Low') / nullif(count(*) FILTER (status = 'READY'), 0), 1) AS low_risk_percent FROM a3""")
def run_summary(spark, sf_dir):
    return report.summary(_assets(spark, sf_dir))


@query(f"WITH {_ASSETS_SQL} SELECT source AS category, count(*) AS n FROM a3 WHERE status = 'READY' AND source <> '' GROUP BY source")
def category_distribution(spark, sf_dir):
    return report.category_distribution(_assets(spark, sf_dir).withColumn("category", F.col("source")))


@query(f"""SELECT p_partkey, CASE WHEN a IN ({_CATS}) THEN a ELSE 'Miscellaneous' END AS category,
CASE WHEN b IN ({_CATS}) AND b <> CASE WHEN a IN ({_CATS}) THEN a ELSE 'Miscellaneous' END THEN b ELSE '' END AS category2
FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Nature' ELSE p_type END AS a, CASE p_partkey % 3 WHEN 0 THEN 'Nature' WHEN 1 THEN 'Miscellaneous' ELSE 'Bogus' END AS b FROM part)""")
def repair_categories(spark, sf_dir):
    i = F.col("p_partkey")
    p = _t(spark, sf_dir, "part").select(i, F.when(i % 2 == 0, "Nature").otherwise(F.col("p_type")).alias("a"), F.when(i % 3 == 0, "Nature").when(i % 3 == 1, "Miscellaneous").otherwise("Bogus").alias("b"))
    p = p.withColumn("category", classify.repair_category(F.col("a")))
    return p.select("p_partkey", "category", classify.repair_second(F.col("b"), F.col("category")).alias("category2"))


_AVERAGE = lambda what, which: f"round_even(avg({what}) FILTER ({which}), 1)"


@query(f"""WITH {_ASSETS_SQL}, m AS (SELECT source AS c, count(*) AS n, min(doc_id) AS seen FROM a3 WHERE status = 'READY' AND source <> '' GROUP BY source)
SELECT '1.0' AS version, 'none' AS model, count(*) AS processed_this_run, count(*) FILTER (status = 'READY') AS ready_to_upload, count(*) FILTER (status = 'LOW_RESOLUTION') AS low_res, count(*) FILTER (status = 'LOW_QUALITY') AS low_quality,
count(*) FILTER (status = 'DUPLICATE') AS duplicates, count(*) FILTER (status = 'NEEDS_RELEASE') AS needs_release, count(*) FILTER (status = 'REVIEW') AS review, count(*) FILTER (status LIKE 'ERROR%') AS errors, (SELECT count(*) FROM documents WHERE n_chars > 5000) AS remaining, 'documents' AS folder, CAST(1.5 AS DOUBLE) AS duration_seconds,
{_AVERAGE('score', "status IN ('READY', 'LOW_QUALITY', 'NEEDS_RELEASE', 'REVIEW')")} AS average_commercial_score, {_AVERAGE('len(kw)', "status = 'READY'")} AS average_keyword_count, (SELECT string_agg(c || '=' || n, ',' ORDER BY seen) FROM m) AS category_distribution,
CAST(sum(doc_id % 3) AS BIGINT) AS api_retries, count(*) FILTER (doc_id % 50 = 0) AS api_hard_failures, round_even(100.0 * count(*) FILTER (status = 'READY' AND risk = 'Low') / nullif(count(*) FILTER (status = 'READY'), 0), 1) AS low_risk_ready_ratio_percent, false AS stopped_on_daily_quota FROM a3""")
def run_document(spark, sf_dir):
    i = F.col("doc_id")
    rows = _assets(spark, sf_dir).withColumns({"category": F.col("source"), "retries": i % 3, "failures": (i % 50 == 0).cast("int")})
    remaining = _t(spark, sf_dir, "documents").where("n_chars > 5000").agg(F.count("*"))
    out = report.document(rows, remaining, Settings(), "documents", 1.5, order="doc_id")
    pairs = F.transform(F.map_entries("category_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.withColumn("category_distribution", F.array_join(pairs, ","))


_REGISTRY_SQL = """r AS (SELECT 'doc' || doc_id AS name, CASE doc_id % 6 WHEN 0 THEN 'READY' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'error' ELSE 'REVIEW' END AS status, CAST(doc_id % 4 AS INTEGER) AS attempts FROM documents WHERE doc_id % 2 = 0 OR doc_id % 6 = 1)"""


def _registry(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % 6 == 0, "READY").when(i % 6 == 1, "ERROR").when(i % 6 == 2, "error").otherwise("REVIEW")
    return docs.where((i % 2 == 0) | (i % 6 == 1)).select(F.concat(F.lit("doc"), i.cast("string")).alias("name"), status.alias("status"), (i % 4).cast("int").alias("attempts"))


@query(f"""WITH {_REGISTRY_SQL} SELECT name, coalesce(r.attempts, 0) AS attempts_prev, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS ord FROM (SELECT 'doc' || doc_id AS name FROM documents) d LEFT JOIN r USING (name)
WHERE r.status IS NULL OR r.status = 'error' OR (r.status = 'ERROR' AND r.attempts < 3) ORDER BY name LIMIT 50""")
def pending_batch(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    names = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    return registry.batch(registry.pending(names, _registry(docs)))


@query(f"""WITH {_REGISTRY_SQL}, p AS (SELECT name, r.attempts FROM (SELECT 'doc' || doc_id AS name FROM documents) d LEFT JOIN r USING (name) WHERE r.status IS NULL OR r.status = 'error' OR (r.status = 'ERROR' AND r.attempts < 3)),
b AS (SELECT *, row_number() OVER (ORDER BY name) AS ord FROM p ORDER BY name LIMIT 50)
SELECT count(*) AS remaining FROM p LEFT JOIN b USING (name) WHERE b.ord IS NULL OR (b.ord % 3 = 0 AND coalesce(b.attempts, 0) + 1 < 3)""")
def remaining_items(spark, sf_dir):
    """What was pending and still is after a run of one batch in which every third item fails."""
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    names = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    before = _registry(docs).withColumn("updated_seq", F.lit(0))
    todo = registry.pending(names, before)
    status, tries = registry.promote(F.col("attempts_prev"))
    failed = F.col("ord") % 3 == 0
    done = registry.batch(todo).select("name", F.when(failed, status).otherwise("READY").alias("status"), F.when(failed, tries).otherwise(0).alias("attempts"), F.lit(1).alias("updated_seq"))
    return registry.pending(todo.select("name"), registry.upsert(before, done)).agg(F.count("*").alias("remaining"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def registry_latest(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("seq"))
    return registry.upsert(e.where("false"), e, "user_id", "seq").select("user_id", "event_type", "value")


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isle FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isle ORDER BY ts, event_id) AS BIGINT) AS attempts,
CASE WHEN event_type = 'error' THEN CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isle ORDER BY ts, event_id) >= 3 THEN 'ERROR_PERMANENT' ELSE 'ERROR' END ELSE 'OK' END AS status FROM e""")
def registry_attempts(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    e = registry.consecutive_failures(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    status = F.when(F.col("event_type") == "error", registry.promote(F.col("attempts") - 1)[0]).otherwise("OK")
    return e.select("event_id", "attempts", status.alias("status"))


@query("""WITH c AS (SELECT user_id, min((ts, event_id)) FILTER (event_type = 'purchase') AS cut FROM events GROUP BY user_id)
SELECT event_id, user_id FROM events JOIN c USING (user_id) WHERE cut IS NULL OR (ts, event_id) < cut""")
def quota_prefix(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return registry.before_first(e, ["ts", "event_id"], F.col("event_type") == "purchase", "user_id").select("event_id", "user_id")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, array_to_string(list_filter(['k', 'other'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing FROM events")
def json_props(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    found = annotation.strict_object(F.col("props"), ["k", "other"])
    e = e.select("event_id", found.alias("v"))
    return e.select("event_id", F.try_variant_get(F.col("v.k"), "$", "int").alias("k"), F.array_join(annotation.missing_keys(F.col("v"), ["k", "other"]), ",").alias("missing"))


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+|[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '', 'g')".format


@query(f"""WITH r AS (SELECT *, doc_id % 8 AS shape, doc_id % 8 IN (2, 4, 7) AS bad FROM documents),
t AS (SELECT *, CASE WHEN shape = 3 THEN coalesce(text, 'earlier') ELSE text END AS given,
  CASE WHEN shape = 6 THEN CAST([] AS VARCHAR[]) ELSE list_filter([coalesce(source, ''), coalesce(lang, '')], lambda x: {_STRIP("x")} <> '') END AS kept FROM r)
SELECT doc_id, CASE WHEN bad THEN 'not a JSON object' WHEN given IS NULL THEN 'missing title' WHEN shape = 6 THEN 'keywords empty or not a list' WHEN shape = 5 THEN 'score is no integer' END AS parse_error,
CASE WHEN bad THEN '' ELSE {_STRIP("coalesce(given, '')")} END AS title, CASE WHEN NOT bad THEN array_to_string(kept, '|') END AS keywords,
CASE WHEN NOT bad AND shape <> 5 THEN CAST(doc_id % 101 AS INTEGER) END AS score, CASE WHEN bad THEN 'Medium' ELSE 'None' END AS risk, NOT bad AND doc_id % 3 = 0 AS people_visible FROM t""")
def parse_annotations(spark, sf_dir):
    """Answers made of whole texts: plain, fenced, followed by text, with a repeated key, in a list, without a number, without keywords, with single quotes."""
    d = _t(spark, sf_dir, "documents")
    shape, blank = F.col("doc_id") % 8, F.coalesce("source", F.lit(""))
    words = F.when(shape == 6, F.array().cast("array<string>")).otherwise(F.array(blank, F.coalesce("lang", F.lit(""))))
    score = F.when(shape != 5, F.col("doc_id") % 101 + F.lit(0.75))
    people = F.when(F.col("doc_id") % 3 == 0, "false").when(F.col("doc_id") % 3 == 1, "")
    body = F.to_json(F.struct(F.col("text").alias("title"), blank.alias("description"), words.alias("keywords"), blank.alias("category"), score.alias("commercial_score"), people.alias("people_visible")))
    inner = F.concat(F.lit('"rejection_risk":null,'), F.expr("substring(body, 2)"))
    raw = (
        F.when(shape == 1, F.concat(F.lit("```json\n{"), inner, F.lit("\n```"))).when(shape == 2, F.concat(F.lit("{"), inner, F.lit(" x"))).when(shape == 3, F.concat(F.lit('{"title":"earlier",'), inner))
        .when(shape == 4, F.concat(F.lit("[{"), inner, F.lit("]"))).when(shape == 5, F.concat(F.lit('{"commercial_score":NaN,'), inner)).when(shape == 7, F.concat(F.lit("{'x':1,"), inner))
        .otherwise(F.concat(F.lit("{"), inner))
    )
    d = annotation.parse(d.select("doc_id", body.alias("body")).select("doc_id", raw.alias("raw")), "raw")
    return d.select("doc_id", "parse_error", "title", F.array_join("keywords", "|").alias("keywords"), "score", "risk", "people_visible")


_MESSAGES = ["RESOURCE_EXHAUSTED: retry in 12.5 s", "RESOURCE_EXHAUSTED 'retryDelay': '7s'", "RESOURCE_EXHAUSTED: Requests Per Day", "503 UNAVAILABLE", "RESOURCE_EXHAUSTED retry in 0s", "bad json", "model overloaded, retry in 2 s", "RESOURCE_EXHAUSTED 'retryDelay' : 7 s", "503 retryDelay:'3.5s'", "503 retry in 1.2.3 s, retryDelay: 4s"]
_M = ", ".join("('" + m.replace("'", "''") + "')" for m in _MESSAGES)


@query(rf"""WITH m AS (SELECT item_id, m, CAST(item_id % 4 + 1 AS INTEGER) AS attempt FROM benchmark, (VALUES {_M}) v(m)),
t AS (SELECT *, regexp_replace(replace(replace(lower(m), chr(39), ''), '"', ''), '\s+', '', 'g') AS flat FROM m),
u AS (SELECT *, regexp_extract(flat, 'retryin([0-9.]+)s', 1) AS plain, regexp_extract(flat, 'retrydelay:([0-9.]+)s', 1) AS keyed FROM t),
h AS (SELECT item_id, m, attempt, nullif(CASE WHEN plain <> '' THEN TRY_CAST(plain AS DOUBLE) ELSE TRY_CAST(nullif(keyed, '') AS DOUBLE) END, 0) AS hint, plain <> '' AND TRY_CAST(plain AS DOUBLE) IS NULL AS broken,
CASE WHEN contains(lower(m), 'resource_exhausted') AND contains(replace(lower(m), ' ', ''), 'perday') THEN 'quota' WHEN contains(lower(m), 'resource_exhausted') THEN 'rate_limit' WHEN contains(lower(m), '503') OR contains(lower(m), 'unavailable') OR contains(lower(m), 'overloaded') THEN 'overload' ELSE 'generic' END AS kind FROM u)
SELECT item_id, m AS message, kind, broken, CASE kind WHEN 'rate_limit' THEN coalesce(hint, 15.0 * attempt) WHEN 'overload' THEN coalesce(hint, least(10.0 * pow(2.0, attempt - 1), 90.0)) WHEN 'generic' THEN CAST(3.0 * attempt AS DOUBLE) END AS wait FROM h""")
def retry_parse(spark, sf_dir):
    m = F.explode(F.array(*[F.lit(x) for x in _MESSAGES])).alias("message")
    b = _t(spark, sf_dir, "benchmark").select("item_id", m).withColumn("attempt", (F.col("item_id") % 4 + 1).cast("int"))
    b = b.withColumn("kind", text.error_kind(F.col("message")))
    return b.select("item_id", "message", "kind", text.unreadable_hint(F.col("message")).alias("broken"), text.backoff(F.col("kind"), text.retry_hint(F.col("message")), F.col("attempt").cast("double")).alias("wait"))


@query("""SELECT doc_id, CASE WHEN n = 1 THEN b || '.jpg' ELSE b || '-' || n || '.jpg' END AS unique_name FROM (SELECT doc_id, source AS b, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)""")
def unique_names(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("source", F.lit(".jpg")).alias("name"))
    return naming.unique_fast(d, "lang", "name", "doc_id").select("doc_id", "unique_name")


@query("""WITH n AS (SELECT doc_id, lang, source, source || CASE doc_id % 5 WHEN 0 THEN '-2' WHEN 1 THEN '-3' ELSE '' END AS stem FROM documents),
g AS (SELECT list(doc_id ORDER BY doc_id) AS ids, list(stem ORDER BY doc_id) AS stems FROM n GROUP BY lang, source),
f AS (SELECT ids, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(stems, lambda s: [s])), lambda used, s: list_append(used, CASE WHEN NOT list_contains(used, s[1]) THEN s[1]
  ELSE s[1] || '-' || list_filter(range(2, len(used) + 3), lambda k: NOT list_contains(used, s[1] || '-' || k))[1] END)) AS names FROM g)
SELECT unnest(ids) AS doc_id, unnest(names) || '.jpg' AS unique_name FROM f""")
def unique_names_exact(spark, sf_dir):
    """Names of which some already look like numbered ones."""
    i = F.col("doc_id")
    tail = F.when(i % 5 == 0, "-2.jpg").when(i % 5 == 1, "-3.jpg").otherwise(".jpg")
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("source", tail).alias("name"))
    return naming.unique_exact(d, "lang", "name", "doc_id").select("doc_id", "unique_name")


@query(f"""WITH {_ASSETS_SQL}, l AS (SELECT doc_id, list_filter([CASE WHEN status NOT IN ('READY', 'DUPLICATE', 'LOW_RESOLUTION') THEN status || ' | ' || name || ' | ' || reason END, CASE WHEN status = 'NEEDS_RELEASE' AND people THEN 'FLAG | ' || name || ' | people' END,
CASE WHEN status = 'NEEDS_RELEASE' AND prop THEN 'FLAG | ' || name || ' | property' END, CASE WHEN mark AND status = 'LOW_QUALITY' THEN 'FLAG | ' || name || ' | overlay' END], lambda x: x IS NOT NULL) AS lines FROM a3)
SELECT doc_id, CAST(unnest(range(len(lines))) AS INTEGER) AS seq, unnest(lines) AS line FROM l""")
def review_log(spark, sf_dir):
    lines = classify.review_lines(F.col("name"), F.col("status"), F.col("reason"), F.col("people"), F.col("prop"), F.col("mark"))
    return _assets(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("seq", "line"))


@query(f"""WITH {_ASSETS_SQL} SELECT final_name AS "Filename", name AS "Description", array_to_string(list_filter(['k' || doc_id % 10, CASE WHEN doc_id % 10 <> doc_id % 4 THEN 'k' || doc_id % 4 END, source], lambda x: x IS NOT NULL), ', ') AS "Keywords", source AS "Categories" FROM a3 WHERE status = 'READY'""")
def upload_rows(spark, sf_dir):
    return sinks.upload_rows(_assets(spark, sf_dir).withColumns({"title": F.col("name"), "category": F.col("source"), "category2": F.lit("")}))


_PY = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"


@query(f"""WITH {_ASSETS_SQL} SELECT name AS original_name, final_name, status, CAST(score AS VARCHAR) AS score, risk, source AS category, '' AS category2, '' AS title, destination, reason, {_PY('people')} AS people_visible, {_PY('prop')} AS property_or_trademark_visible, {_PY('mark')} AS watermark_or_overlay_visible, CAST(len(kw) AS VARCHAR) AS keyword_count FROM a3""")
def report_rows(spark, sf_dir):
    a = _assets(spark, sf_dir).withColumns({
        "original_name": F.col("name"), "category": F.col("source"), "category2": F.lit(None).cast("string"), "title": F.lit(None).cast("string"),
        "people_visible": F.col("people"), "property_or_trademark_visible": F.col("prop"), "watermark_or_overlay_visible": F.col("mark"),
    })
    return sinks.report_rows(a)


@query("SELECT doc_id, CAST(n_chars AS DOUBLE) * 2000 / 1e6 AS megapixels, CAST(n_chars AS DOUBLE) * 2000 / 1e6 < 4.0 AS low_res, doc_id % 3 = 0 OR n_chars * 10000 > 50 * 1048576 AS needs_convert FROM documents")
def low_res_gate(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    mp = hashing.megapixels(F.col("n_chars").cast("double"), F.lit(2000))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PNG").otherwise(".jpg"))
    return d.select("doc_id", mp.alias("megapixels"), (mp < 4.0).alias("low_res"), batch.needs_convert(name, F.col("n_chars") * 10_000, 50).alias("needs_convert"))


@query(f"WITH {_ASSETS_SQL} SELECT name, destination, final_name FROM a3")
def naming_plan(spark, sf_dir):
    return _assets(spark, sf_dir).select("name", "destination", "final_name")


@query(f"""WITH {_ASSETS_SQL} SELECT final_name AS name, unnest(['Title', 'Description', 'Caption-Abstract', 'XMP-dc:Title', 'XMP-dc:Description']) AS tag, unnest([name, source, source, name, source]) AS value FROM a3 WHERE status IN ('READY', 'NEEDS_RELEASE', 'REVIEW')
UNION ALL SELECT final_name, t.tag, k FROM (SELECT final_name, unnest(kw) AS k FROM a3 WHERE status IN ('READY', 'NEEDS_RELEASE', 'REVIEW')), (VALUES ('Keywords'), ('XMP-dc:Subject')) t(tag)""")
def keyword_tags(spark, sf_dir):
    return sinks.tags(_assets(spark, sf_dir).withColumns({"title": F.col("name"), "description": F.col("source")}))


@query(f"""WITH {_ASSETS_SQL} SELECT name AS original_name, destination, final_name FROM a3 WHERE status NOT LIKE 'ERROR%' UNION ALL SELECT name, '00_SOURCE_ORIGINALS', name FROM a3 WHERE doc_id % 3 = 0 AND status IN ('READY', 'LOW_QUALITY', 'NEEDS_RELEASE', 'REVIEW')""")
def move_plan(spark, sf_dir):
    a = _assets(spark, sf_dir).withColumns({"original_name": F.col("name"), "needs_convert": F.col("doc_id") % 3 == 0})
    return sinks.moves(a)


@query(r"""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '{"n": ' || item_id || '}' ELSE 'n ' || item_id END AS body FROM benchmark""")
def unfence_responses(spark, sf_dir):
    b, i = _t(spark, sf_dir, "benchmark"), F.col("item_id").cast("string")
    raw = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(' ```json\n{"n": '), i, F.lit("}\n``` "))).otherwise(F.concat(F.lit("\t n "), i, F.lit("\n")))
    return b.select("item_id", text.unfence(raw).alias("body"))
