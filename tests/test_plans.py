import json

import duckdb
import pytest

from colophon.plans import batch, catalogue
from colophon.sources import files

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "documents", "embeddings", "events", "pages", "benchmark", "labels", "part"]


def norm(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(r) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert [tuple(map(str, r)) for r in norm(ours)] == [tuple(map(str, r)) for r in norm(theirs)] or norm(ours) == norm(theirs)


def test_batch_run(spark):
    good = {"title": "Red Fox", "description": "d", "keywords": ["fox", "foxs"], "category": "Bogus", "commercial_score": 90, "rejection_risk": "Low"}
    assets = [("a.jpg", "s1", "0" * 16, 3000, 2000, 10), ("b.jpg", "s1", "0" * 16, 3000, 2000, 10), ("c.png", "s2", "f" * 16, 100, 100, 10), ("d.jpg", "s3", "0" * 15 + "1", 3000, 2000, 10), ("e.jpg", "s4", None, 3000, 2000, 10), ("z.jpg", "s5", None, 3000, 2000, 10)]
    tries = [("a.jpg", 1, json.dumps(good), None), ("d.jpg", 1, "nope", None), ("e.jpg", 1, None, "RESOURCE_EXHAUSTED per day")]
    out = batch.records(
        spark.createDataFrame(assets, "name string, sha256 string, phash string, width int, height int, length long"),
        spark.createDataFrame(tries, "name string, attempt_no int, raw_text string, error_text string"),
        spark.createDataFrame([], "name string, status string, attempts int"),
    )
    rows = {r.original_name: r for r in out.collect()}
    assert {k: r.status for k, r in rows.items()} == {"a.jpg": "READY", "b.jpg": "DUPLICATE", "c.png": "LOW_RESOLUTION", "d.jpg": "ERROR"}
    assert rows["a.jpg"].final_name == "red-fox.jpg" and rows["a.jpg"].category == "Miscellaneous" and rows["a.jpg"].bad_category == "Bogus"
    assert rows["b.jpg"].duplicate_of == "a.jpg" and rows["d.jpg"].near_duplicate_of == "a.jpg" and rows["d.jpg"].attempts == 1
    assert batch.registry_rows(out, 1).count() == 4


def test_folder_source(spark, tmp_path):
    for n in ("_D.JPG", ".jpg", "b.png", "c.txt", "sp ace#1.tif"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    assert sorted(r.name for r in files.list_assets(spark, str(tmp_path)).collect()) == ["_D.JPG", "b.png", "sp ace#1.tif"]


def test_legacy_registry(spark):
    old = files.import_registry(spark, '{"a": "error", "b": {"status": "READY", "attempts": 2}}').orderBy("name").collect()
    assert [(r.name, r.status, r.attempts) for r in old] == [("a", "error", 0), ("b", "READY", 2)]
    assert files.import_registry(spark, "junk").count() == 0
