"""Approximate nearest neighbours by multi-index hashing: the largest inner products within a Hamming radius.

A rotation of the centred principal components is learned (alternating between the signs and the nearest rotation) on a
sample of at most about SAMPLE vectors, in hash order of their ids; every vector gets the 64 signs as its code.  The radius
is learned on the same sample: the least that holds RECALL of its vectors' nearest neighbours, of which the sample holds
their share of the NEIGHBOURS in the whole table.  A code is split into its eight bytes, each indexed: by the pigeonhole
principle, of two codes that differ in at most r = 8a + b bits, one of the first b + 1 bytes differs in at most a bits or
one of the others in at most a - 1.  Probing those values of each byte retrieves every code within the radius; their
vectors are then compared in double precision.

Equal vectors are one class, found by a digest of their bytes, with its NEIGHBOURS + 1 smallest ids (no more of them can be
among anyone's nearest); the queries of a class are answered once.  Classes are dealt evenly to strips and query classes to
blocks; a task has one strip and one block, reads them as a stream and keeps the best NEIGHBOURS + 1 of each query.  Strips'
answers are merged in groups of bounded size.  Where the radius holds fewer neighbours than there are, the query goes
through all codes once more with the full radius of 64 bits, so that answers are never short.

Every strip meets every block, and what a task does with the two rests on the radius: at 64 random dimensions the nearest of
51,000 vectors are 20 to 30 of 64 bits away, so that about a third of all codes are compared; near copies are a few bits away.

Scores are inner products of the original vectors, summed in the order of their components.  The nearest come first, ties go
to the smaller id.

Edge cases: vectors that are null or empty, hold a null, a NaN or an infinity, or are zero take no part, nor do rows without an id
or vectors of another length than the commonest (the longer one of two).  Equal rows are one; a row with the query's id is
never its answer; of several vectors under one query id the one with the least digest is searched, and each is a candidate.
Without vectors, or without queries, the result is empty; a query that is alone has no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import bound_batches, discard, materialize

NEIGHBOURS, QUERY_STEP, BITS = 20, 20, 64
SAMPLE, TRIALS, RECALL, SEED = 10_000, 1_000, 0.985, 5
#: Classes of a strip, query classes of a block, classes that a task indexes at once, queries that it compares at once.
STRIP, BLOCK, CHUNK, SLICE = 8_192, 4_096, 8_192, 256
_RESULT = "query_id long, rank int, vec_id long, score double"
_ROWS = "strip int, block int, kind int, digest binary, code long, vector binary, ids array<long>"
_FOUND = "digest binary, strip int, found array<struct<far:double, id:long>>"


def rotation(sample: np.ndarray, rounds: int = 30, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, weights): a code's bits are the signs of (x - mean) @ weights."""
    r, mean = np.random.default_rng(seed), sample.mean(0)
    _, axes = np.linalg.eigh(np.cov(sample - mean, rowvar=False).reshape(sample.shape[1], -1) if len(sample) > 1 else np.eye(sample.shape[1]))
    axes = axes[:, ::-1][:, :BITS]
    turned, frames = (sample - mean) @ axes, []
    while sum(f.shape[1] for f in frames) < BITS:
        turn = np.linalg.qr(r.standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(turned.T @ np.where(turned @ turn > 0, 1.0, -1.0))
            turn = u @ v
        frames.append(axes @ turn)
    return mean, np.hstack(frames)[:, :BITS]


def codes_of(vectors: np.ndarray, mean: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.packbits((vectors - mean) @ weights > 0, axis=1).view("<u8").ravel()


def learned_radius(sample: np.ndarray, codes: np.ndarray, near: int, recall: float = RECALL) -> int:
    """The least radius that holds `recall` of the `near` nearest others of the sample's first vectors."""
    apart = []
    for a in range(0, min(TRIALS, len(sample)), 100):
        some = slice(a, min(a + 100, TRIALS, len(sample)))
        scores = sample[some] @ sample.T
        scores[np.arange(len(scores)), np.arange(len(scores)) + a] = -np.inf
        best = np.argsort(-scores, axis=1)[:, : min(near, len(sample) - 1)]
        apart.append(np.bitwise_count(codes[some, None] ^ codes[best]).ravel())
    apart = np.sort(np.concatenate(apart)) if apart else np.zeros(0)
    return int(apart[min(len(apart) - 1, math.ceil(recall * len(apart)))]) if len(apart) else BITS


def substring_index(codes: np.ndarray) -> np.ndarray:
    """For each byte of the codes and each value of it, the codes that have it, as a bitmap: [8, 256, codes / 8]."""
    values = codes.view(np.uint8).reshape(-1, 8)
    return np.stack([np.packbits(values[:, j] == np.arange(256, dtype=np.uint8)[:, None], axis=1) for j in range(8)])


_APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def probes(index: np.ndarray, radius: int) -> np.ndarray:
    """For each byte and each value that a query may have there, the codes that its probes of the byte retrieve, as bitmaps."""
    a, b = divmod(min(radius, BITS), 8)
    out = np.zeros_like(index)
    for j in range(8):
        reach = a if j <= b else a - 1
        for value in range(256) if reach >= 0 else ():
            np.bitwise_or.reduce(index[j][_APART[value] <= reach], axis=0, out=out[j, value])
    return out


def retrieved(queries: np.ndarray, codes: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """[query, code]: whether the code is within the radius of the query's, by probing and a test of what that retrieves."""
    values = queries.view(np.uint8).reshape(-1, 8)
    bitmap = table[0][values[:, 0]]
    for j in range(1, 8):
        bitmap |= table[j][values[:, j]]
    found = np.unpackbits(bitmap, axis=1, count=len(codes)).view(bool)
    if found.mean() > 0.1:
        return found & (np.bitwise_count(queries[:, None] ^ codes) <= radius)
    q, x = np.nonzero(found)
    found[q, x] = np.bitwise_count(queries[q] ^ codes[x]) <= radius
    return found


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components, so that equal vectors have equal products."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class _Block:
    """The queries of a block and the best of what they have met."""

    def __init__(self, digests: list[bytes], codes: np.ndarray, vectors: np.ndarray, keep: int):
        self.digests, self.codes, self.vectors, self.keep = digests, codes, vectors, keep
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(codes), -np.inf)

    def meet(self, codes: np.ndarray, vectors: np.ndarray, ids: np.ndarray, ends: np.ndarray, radius: int) -> None:
        """Compare with a chunk of classes; class i has the ids ids[ends[i]:ends[i + 1]]."""
        table = probes(substring_index(codes), radius)
        slack = 1e-9 * np.abs(vectors).max() * np.abs(self.vectors).max() * vectors.shape[1]
        parts = [(self.query, self.score, self.id)]
        for a in range(0, len(self.codes), SLICE):
            own = slice(a, a + SLICE)
            near = retrieved(self.codes[own], codes, table, radius)
            scores = np.where(near, self.vectors[own] @ vectors.T, -np.inf)
            bound = self.least[own]
            if scores.shape[1] > self.keep:
                bound = np.maximum(bound, np.partition(scores, -self.keep, axis=1)[:, -self.keep])
            q, x = np.nonzero(near & (scores >= (bound - slack)[:, None]))
            exact, sizes = inner(self.vectors[own][q], vectors[x]), ends[x + 1] - ends[x]
            at = np.repeat(ends[x] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            parts.append((np.repeat(q + a, sizes), np.repeat(exact, sizes), ids[at]))
        query, score, number = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((number, -score, query))
        query, score, number = query[order], score[order], number[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = rank < self.keep
        self.query, self.score, self.id = query[best], score[best], number[best]
        last = rank == self.keep - 1
        self.least[query[last]] = score[last]

    def answers(self, strip: int) -> pa.RecordBatch:
        starts = np.searchsorted(self.query, np.arange(len(self.codes) + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(-self.score), pa.array(self.id)], ["far", "id"])
        found = pa.ListArray.from_arrays(pa.array(starts), entries)
        return pa.RecordBatch.from_arrays([pa.array(self.digests, pa.binary()), pa.array([strip] * len(self.digests), pa.int32()), found], ["digest", "strip", "found"])


def _vectors(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _searcher(radius: int, kind: str, keep: int):
    """Over rows of _ROWS in order of (strip, block, kind): the queries of a block (kind 0), then the classes that they meet."""

    def run(it):
        key, block, waiting, rows = None, None, [], 0

        def meet():
            nonlocal waiting, rows
            if rows and block:
                held = pa.Table.from_batches(waiting).combine_chunks()
                ids = held["ids"].combine_chunks()
                ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                ends = np.asarray(ids.offsets).astype(np.int64)
                block.meet(held["code"].to_numpy().view(np.uint64), _vectors(held["vector"], kind), ids.values.to_numpy(), ends, radius)
            waiting, rows = [], 0

        queries: list = []

        def begin():
            nonlocal block, queries
            if queries and block is None:
                held = pa.Table.from_batches(queries)
                block = _Block(held["digest"].to_pylist(), held["code"].to_numpy().view(np.uint64).copy(), _vectors(held["vector"], kind), keep)
            queries = []

        for batch in it:
            marks = [batch.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                own, part = (int(marks[0][a]), int(marks[1][a])), batch.slice(a, b - a)
                if own != key:
                    begin()
                    meet()
                    if block:
                        yield block.answers(key[0])
                    key, block = own, None
                if marks[2][a] == 0:
                    queries.append(part)
                    continue
                begin()
                for c in range(0, part.num_rows, CHUNK):
                    waiting.append(part.slice(c, CHUNK))
                    rows += waiting[-1].num_rows
                    if rows >= CHUNK:
                        meet()
        begin()
        meet()
        if block:
            yield block.answers(key[0])

    return run


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v: the rows that take part, but for their length."""
    # Checked as they are: what is null or not finite fails.
    numbers = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).where(numbers & F.exists(vector, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"))


def _encoder(model: tuple[np.ndarray, np.ndarray], kind: str):
    def run(it):
        for batch in it:
            if batch.num_rows:
                own = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1) + np.array(0, kind)  # -0.0 is 0.0
                raw = [x.tobytes() for x in own]
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
                codes = codes_of(own.astype(np.float64), *model).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(codes), pa.array(raw, pa.binary())], ["vec_id", "digest", "code", "vector"])

    return run


def build(rows: DataFrame, total: int) -> tuple[DataFrame, int, str]:
    """(the index's entries (vec_id, digest, code, vector), radius, type of the vectors' numbers).  rows: vec_id, v of one length."""
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(total, 1))) < SAMPLE).dropDuplicates(["vec_id"]).limit(2 * SAMPLE)
    drawn = chosen.select("vec_id", "v").toArrow().sort_by("vec_id")
    sample = np.unique(drawn["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(drawn.num_rows, -1), axis=0)
    sample = sample[np.random.default_rng(SEED).permutation(len(sample))]
    model = rotation(sample)
    near = min(NEIGHBOURS, max(1, round(NEIGHBOURS * len(sample) / max(total, 1))))
    radius = learned_radius(sample, codes_of(sample, *model), near)
    return rows.mapInArrow(_encoder(model, kind), "vec_id long, digest binary, code long, vector binary"), radius, kind


def classes(encoded: DataFrame, keep: int) -> DataFrame:
    """digest, code, vector, ids: the distinct vectors, each with its `keep` smallest ids."""
    order = Window.partitionBy("digest").orderBy("vec_id")
    few = encoded.select("digest", "vec_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    ids = few.groupBy("digest").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return encoded.groupBy("digest").agg(F.first("code").alias("code"), F.first("vector").alias("vector")).join(ids, "digest")


def _best(df: DataFrame, keys: list, keep: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, keep).alias("found"))


def nearest(queries: DataFrame, base: DataFrame, n_queries: int, n_base: int, radius: int, kind: str, keep: int) -> DataFrame:
    """digest, found: the best `keep` (far: minus the score, id) of each query class among those within the radius."""
    strips, blocks = -(-n_base // STRIP), -(-n_queries // BLOCK)
    deal = lambda n, salt: F.pmod(F.xxhash64("digest", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(every(strips).alias("strip"), deal(blocks, 1).alias("block"), F.lit(0).alias("kind"), "digest", "code", "vector", F.lit(None).cast("array<long>").alias("ids"))
    held = base.select(deal(strips, 2).alias("strip"), every(blocks).alias("block"), F.lit(1).alias("kind"), "digest", "code", "vector", "ids")
    both = asked.union(held).repartition(min(strips * blocks, 20_000), "strip", "block").sortWithinPartitions("strip", "block", "kind")
    found = both.select(*[c.split()[0] for c in _ROWS.split(", ")]).mapInArrow(_searcher(radius, kind, keep), _FOUND)
    if strips > 64:  # a query's answers are merged in groups of about as many as there are groups
        found = _best(found, ["digest", F.pmod("strip", F.lit(math.isqrt(strips))).alias("group")], keep)
    return _best(found, ["digest"], keep)


def search(table: DataFrame, vector: str = "embedding", neighbours: int = NEIGHBOURS, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors of each whose vec_id is divisible by step."""
    spark, keep = table.sparkSession, neighbours + 1
    bound_batches(spark)
    rows = usable(table, vector)
    commonest = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if commonest is None:
        return spark.createDataFrame([], _RESULT)
    encoded, radius, kind = build(rows.where(F.size("v") == commonest["n"]), commonest["count"])
    encoded = materialize(encoded, "codes")
    base = materialize(classes(encoded, keep), "classes")
    queries = materialize(encoded.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("digest").alias("digest")), "queries")
    discard(encoded)
    n_base, n_ids = base.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    asked = base.join(queries.select("digest").distinct(), "digest", "left_semi").select("digest", "code", "vector")
    n_queries = queries.select("digest").distinct().count()
    if not n_queries:
        return spark.createDataFrame([], _RESULT)
    found = materialize(nearest(asked, base, n_queries, n_base, radius, kind, keep), "found")
    short = found.where(F.size("found") < min(keep, n_ids))
    if n_short := short.count():
        again = asked.join(short.select("digest"), "digest", "left_semi")
        whole = nearest(again, base, n_short, n_base, BITS, kind, keep)
        done = materialize(found.where(F.size("found") >= min(keep, n_ids)).unionByName(whole), "found")
        discard(found)
        found = done
    discard(base)
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("vec_id")), 1, neighbours)
    ranked = queries.join(found, "digest").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "near"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("near.id").alias("vec_id"), (-F.col("near.far")).alias("score"))
