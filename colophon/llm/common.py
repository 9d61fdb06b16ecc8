"""Shared pieces: materialised tables in the shared folder, and vectorised word hashing of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch, about: what the JVM and a Python worker hold of the rows at once.
BATCH_BYTES = 3 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="colophon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold about BATCH_BYTES and not 10,000 rows, however long; a setting of its own stays."""
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table = path
    return out


def settle(df: DataFrame, name: str, rows: int = 2_000_000) -> DataFrame:
    """materialize for what is small next to the corpus: computed once, then written in files of about `rows` rows."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = materialize(held.coalesce(1 + held.count() // rows), name)
    held.unpersist()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables whose readers have been written to the shared folder themselves."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word_table(separators: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Word bytes after A-Z became lower case; every separator is ASCII, so bytes and code points agree.
ALNUM_WORDS = _word_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
SPACE_WORDS = _word_table([(0x20, 0x20), (0x09, 0x0D)])

_RADIX = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_RADIX, -1, 1 << 64)
_CHUNK = 1 << 16
_STATE: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_STATE.get("up", ())) < n:
        for key, base in (("up", _RADIX), ("down", _INVERSE)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _STATE[key] = a
    return _STATE["up"], _STATE["down"]


def _values() -> np.ndarray:
    if "values" not in _STATE:
        v = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        lower = np.arange(256)
        lower[65:91] += 32
        _STATE["values"] = v[lower]
    return _STATE["values"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mix of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, without copies; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int32)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def word_hashes(column, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of a text column, and each text's first word number.

    The second array has one entry more than the column: text i has the words starts[i]:starts[i+1].
    """
    data, offsets = text_buffers(column)
    base, end = int(offsets[0]), int(offsets[-1])
    data, offsets = data[base:end], offsets - base
    n = end - base
    table = words.copy()
    table[65:91] = words[97:123]  # A-Z as a-z
    inside = table[data]
    begin, stops = inside.copy(), inside.copy()
    np.greater(inside[1:], inside[:-1], out=begin[1:])
    np.greater(inside[:-1], inside[1:], out=stops[:-1])
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    first = np.flatnonzero(begin)
    last = np.flatnonzero(stops) + 1
    return span_hashes(data, first, last, _values()), np.searchsorted(first, offsets)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans first[i]:last[i], which follow one another; values: a number for each byte."""
    hashes = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        start = int(first[i])
        j = max(i + 1, int(np.searchsorted(last, start + _CHUNK, "right")))
        stop = int(last[j - 1])
        up, down = _powers(max(stop - start, _CHUNK))
        total = np.empty(stop - start + 1, np.uint64)
        total[0] = 0
        np.multiply(values.take(data[start:stop]), up[: stop - start], out=total[1:])
        np.cumsum(total, out=total)
        a, b = first[i:j] - start, last[i:j] - start
        hashes[i:j] = (total.take(b) - total.take(a)) * down.take(a)
        i = j
    return mix(hashes)


def batches(it, max_bytes: int = 4 << 20, column: str = "text"):
    """Cut Arrow batches into slices of about max_bytes of text, so that memory stays bounded."""
    for batch in it:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.names.index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
