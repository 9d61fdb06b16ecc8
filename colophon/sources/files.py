"""A folder of files as a table or a stream: names that start with _ or . included, not recursive."""

from __future__ import annotations

import heapq
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..config import IMAGE_SUFFIXES
from ..functions.text import suffix

_SCHEMA = "name string, path string, length long, content binary"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.content = options["path"], options.get("content", "true").lower() == "true"
        self.names = set(json.loads(options["names"])) if "names" in options else None
        self.per_task = int(options.get("filesPerTask", "64"))

    def partitions(self):
        paths = sorted(e.path for e in os.scandir(self.folder) if e.is_file() and (self.names is None or e.name in self.names))
        return [_Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [_Files([])]

    def read(self, partition):
        yield from _rows(partition.paths, self.content)


class _StreamReader(DataSourceStreamReader):
    """New files, at most filesPerBatch a micro-batch.

    An offset is the number of a list in the state folder.  A list is put in place whole and never changes, so a micro-batch that
    is replayed has the files that it had; a file that is replaced by another is new again.  A list that was made right before a
    crash, and that no micro-batch knows of, goes with the next one.
    """

    def __init__(self, options):
        self.folder, self.state = options["path"], options["state"]
        self.most, self.per_task = int(options.get("filesPerBatch", "50")), int(options.get("filesPerTask", "8"))
        self.content = options.get("content", "true").lower() == "true"
        self.endings = tuple(json.loads(options.get("endings", "[]")))
        self.seen, self.read_lists = set(), 0

    def _list(self, number: int) -> list:
        with open(os.path.join(self.state, f"list-{number}.json"), encoding="utf-8") as f:
            return json.load(f)

    def _known(self) -> int:
        while os.path.exists(os.path.join(self.state, f"list-{self.read_lists + 1}.json")):
            self.read_lists += 1
            self.seen.update(map(tuple, self._list(self.read_lists)))
        return self.read_lists

    def initialOffset(self):
        return {"list": 0}

    def latestOffset(self):
        last, new = self._known(), []
        for e in os.scandir(self.folder):
            if e.is_file() and (not self.endings or os.path.splitext(e.name)[1].lower() in self.endings):
                found = e.stat()
                key = (e.name, found.st_size, found.st_mtime_ns)
                if key not in self.seen:
                    heapq.heappush(new, key)
        if new:
            os.makedirs(self.state, exist_ok=True)
            draft = os.path.join(self.state, f"draft-{os.getpid()}")
            with open(draft, "w", encoding="utf-8") as f:
                json.dump(heapq.nsmallest(self.most, new), f)
            os.link(draft, os.path.join(self.state, f"list-{last + 1}.json"))  # fails where another stream has made it
            os.unlink(draft)
        return {"list": self._known()}

    def partitions(self, start, end):
        names = [name for k in range(start["list"] + 1, end["list"] + 1) for name, *_ in self._list(k)]
        paths = [os.path.join(self.folder, n) for n in names]
        return [_Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)]

    def read(self, partition):
        yield from _rows([p for p in partition.paths if os.path.exists(p)], self.content)  # a replayed one may have moved


def _rows(paths: list[str], content: bool):
    for path in paths:
        data = None
        if content:
            with open(path, "rb") as f:
                data = f.read()
        yield os.path.basename(path), path, os.path.getsize(path), data


class FolderSource(DataSource):
    """Format `colophon_folder`; the folder must be on storage that every executor mounts."""

    @classmethod
    def name(cls):
        return "colophon_folder"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def list_assets(spark: SparkSession, folder: str, content: bool = True, names: list[str] | None = None) -> DataFrame:
    """Image files of a folder; names: a batch of them, so that no other file is read."""
    spark.dataSource.register(FolderSource)
    files = spark.read.format("colophon_folder").option("content", str(content))
    files = (files if names is None else files.option("names", json.dumps(names))).load(folder)
    return files.where(F.lower(suffix(F.col("name"))).isin(IMAGE_SUFFIXES))


def stream_assets(spark: SparkSession, folder: str, state: str, files: int = 50, content: bool = True) -> DataFrame:
    """A stream of a folder's image files, `files` a micro-batch; state: a folder for the lists of files that were given out."""
    spark.dataSource.register(FolderSource)
    source = spark.readStream.format("colophon_folder").option("state", state).option("filesPerBatch", files).option("content", str(content))
    return source.option("endings", json.dumps(IMAGE_SUFFIXES)).load(folder)


def dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """name, width, height by the JVM's image codecs; -1 where a file can't be decoded."""
    images = spark.read.format("image").option("dropInvalid", False).load(folder)
    return images.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def import_registry(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a JSON registry; plain strings become entries, anything unreadable an empty registry."""
    one = spark.createDataFrame([(text,)], "raw string").withColumn("v", F.try_parse_json("raw"))
    keys = one.select("v", F.explode(F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))).alias("name")).where(F.col("v").isNotNull())
    entry = F.expr("try_variant_get(v, '$', 'map<string,variant>')")[F.col("name")]
    keys = keys.withColumn("e", entry)
    plain = F.schema_of_variant("e") == "STRING"
    text_of = F.try_variant_get("e", "$", "string")
    return keys.select(
        "name", F.when(plain, text_of).otherwise(F.try_variant_get("e", "$.status", "string")).alias("status"),
        F.when(plain, F.when(text_of == "error", 0).otherwise(1)).otherwise(F.try_variant_get("e", "$.attempts", "int")).alias("attempts"),
    )
