"""Fill-in-middle transformation over an index of distinct texts.

Texts are grouped by their SHA-256; a second hash and the length of all texts of a group are compared, and a difference is
an error.  Each distinct text's boundaries (the places, in code points, at which its tokens end) are found once and kept as
Elias-Fano lists: about two bits and log2 of the mean token length for each token, from which any boundary is read without
unpacking the others.  The index row of a text also holds the ids of its documents, so that texts and documents meet in the
exchange that groups them: a text travels at most once from each task that reads it, and no second time to be joined.  Each
document then selects its two cuts, and the output is put together by expressions.

A text with very many copies (HOT_ROWS and 1 / HOT_TEXTS of all rows or more) is in the index once for each so many of its
rows, so that no task and no list holds all of them.

Edge cases: a null text is empty; an empty text has no tokens and stays plain, as does a text that holds a mark; a null
doc_id is hashed as no digits and stays null; equal rows each give a row, equal ones; very long texts are read whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, text_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 1, 90, 20
HOT_ROWS, HOT_TEXTS = 20_000, 5_000
#: Ones of the high bits between two entries of a list's directory.
_STEP = 512
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends, in code points, of the tokens of a text (UTF-8 bytes): runs of A-Z and a-z, and each other code point alone."""
    letter = _LETTERS[data[(data & 0xC0) != 0x80]]
    ends = np.ones(len(letter), bool)
    ends[:-1] = ~(letter[:-1] & letter[1:])
    return np.flatnonzero(ends) + 1


def encode(ends: np.ndarray) -> bytes:
    """A rising list as Elias-Fano code: n, low bits' width, directory of the high bits, high bits, low bits."""
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    places = (ends >> width) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    low = np.packbits((ends[:, None] >> np.arange(width) & 1).astype(np.uint8)) if width else np.zeros(0, np.uint8)
    head = np.array([n, width, len(high)], "<i8").tobytes()
    return head + places[::_STEP].astype("<i8").tobytes() + np.packbits(high).tobytes() + low.tobytes()


def select(code: bytes, k: int) -> int:
    """The k-th number of a list (from 1; 0 gives 0): the place of the k-th one of the high bits, and its low bits."""
    if k == 0:
        return 0
    n, width, bits = np.frombuffer(code, "<i8", 3).tolist()
    entries = -(-n // _STEP)
    directory = np.frombuffer(code, "<i8", entries, 24)
    begin = 24 + 8 * entries
    block = (k - 1) // _STEP
    first = int(directory[block]) // 8
    last = int(directory[block + 1]) // 8 + 1 if block + 1 < entries else -(-bits // 8)
    part = np.frombuffer(code, np.uint8, last - first, begin + first)
    # Ones of the first byte that belong to the block before.
    before = int(np.bitwise_count(part[0] >> np.uint8(8 - int(directory[block]) % 8))) if int(directory[block]) % 8 else 0
    rank = k - 1 - block * _STEP + before
    ones = np.cumsum(np.bitwise_count(part))
    byte = int(np.searchsorted(ones, rank, "right"))
    rank -= int(ones[byte - 1]) if byte else 0
    place = 8 * (first + byte) + int(np.flatnonzero(np.unpackbits(part[byte : byte + 1]))[rank])
    high = place - (k - 1)
    if not width:
        return high
    at = (k - 1) * width
    own = np.unpackbits(np.frombuffer(code, np.uint8, (at + width - 1) // 8 - at // 8 + 1, begin + -(-bits // 8) + at // 8))[at % 8 : at % 8 + width]
    return (high << width) + int((own.astype(np.int64) << np.arange(width)).sum())


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("ends", T.BinaryType())]))
def _listed(text: pa.Array) -> pa.Array:
    data, offsets = text_buffers(text)
    counts, codes = [], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        ends = boundaries(data[a:b])
        counts.append(len(ends))
        codes.append(encode(ends))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(codes, pa.binary())], ["n", "ends"])


@F.arrow_udf(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
def _selected(code: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    cuts = [(select(c, i), select(c, j)) for c, i, j in zip(code.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True)]
    return pa.array([{"a": a, "b": b} for a, b in cuts], pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _hot(keyed: DataFrame, rows: int) -> DataFrame:
    """Digests of texts with very many rows, at most HOT_TEXTS, and over how many groups to deal theirs."""
    limit = max(HOT_ROWS, rows // HOT_TEXTS)
    counted = keyed.groupBy(F.col("digest").alias("_digest")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
    return counted.select("_digest", F.ceil(F.col("_rows") / limit).cast("int").alias("_groups"))


def index(keyed: DataFrame) -> DataFrame:
    """digest, text, n, ends, docs, one row per distinct text (and part of a hot one's).  keyed: digest, part, text, doc_id."""
    hashed = F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("length"))
    docs = F.collect_list(F.struct("doc_id")).alias("docs")  # a struct, as lists leave nulls out
    grouped = keyed.groupBy("digest", "part").agg(F.first("text").alias("text"), F.min(hashed).alias("least"), F.max(hashed).alias("most"), docs)
    verified = F.when(F.col("least") == F.col("most"), F.col("text")).otherwise(F.raise_error(F.lit("two texts have one SHA-256")).cast("string"))
    listed = grouped.select("digest", "docs", verified.alias("text")).withColumn("list", _listed("text"))
    return listed.select("digest", "text", "list.n", "list.ends", "docs")


def _draw(seed: int, number: int) -> Column:
    """The number-th (from 1) group of eight digits of the SHA-256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the document with its middle last, or as it is (plain)."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    hot = _hot(keyed, docs.count())
    dealt = keyed.join(F.broadcast(hot), F.col("digest") == F.col("_digest"), "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_groups")), F.lit(0)).cast("int"))
    rows = index(dealt.select("digest", "part", "text", "doc_id")).select(F.explode("docs").alias("doc"), "text", "n", "ends")
    return cut(rows.select("doc.doc_id", "text", "n", "ends"), seed, fim_percent, spm_percent)


def cut(rows: DataFrame, seed: int, fim_percent: int, spm_percent: int) -> DataFrame:
    """The documents' outputs.  rows: doc_id, text, and its list (n, ends)."""
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(m)
    plain = (F.col("text") == "") | marked | (_draw(seed, 3) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(_draw(seed, 4) % 100 < spm_percent, "spm").otherwise("psm")
    one, two = _draw(seed, 1) % (F.col("n") + 1), _draw(seed, 2) % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", form.alias("form"), "ends", F.least(one, two).alias("i"), F.greatest(one, two).alias("j"))
    rows = rows.withColumn("cut", _selected("ends", "i", "j")).select("doc_id", "text", "n", "form", F.col("cut.a").cast("int").alias("a"), F.col("cut.b").cast("int").alias("b"))
    t, a, b = F.col("text"), F.col("a"), F.col("b")
    prefix, middle, suffix = F.left(t, a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.length(t) - b)
    p, s, m = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    chars = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return rows.select("doc_id", "n", "form", chars(a).alias("prefix_chars"), chars(b - a).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of.  A mark's first place is its own: no text that is cut holds one."""
    second = lambda mark: F.locate(mark, output)
    last = second(MIDDLE)
    tail = F.substring(output, last + len(MIDDLE), F.length(output))

    def part(mark: str, until: Column) -> Column:
        begin = second(mark) + len(mark)
        return F.substring(output, begin, until - begin)

    psm = F.concat(part(PREFIX, second(SUFFIX)), tail, part(SUFFIX, last))
    spm = F.concat(part(PREFIX, last), tail, part(SUFFIX, second(PREFIX)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(outputs: DataFrame) -> DataFrame:
    """The outputs and the texts rebuilt from them as SHA-256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return outputs.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
