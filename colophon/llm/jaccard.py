"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles (64-bit hashes).  Documents with equal sets are one class; links are
sought between classes.  Sizes fall into bands; a pair that links has both sizes in a band's reach, and its symmetric
difference is at most the band's D.  Each shingle flips one bit of a sketch of D + 1 + slack blocks, so sketches' Hamming
distance is a lower bound of the symmetric difference, and by the pigeonhole principle a pair that links has more than
slack equal blocks.  A block has 2**64 bits and is kept as the XOR of random words, one for each bit that is set: the
join's key is that word, and a second sketch, folded to about as many bits as the set has shingles, tests the pairs that it
gives.  Blocks without shingles are
equal by chance only; a class leaves them out unless it has more than slack of them, so one equal block with shingles is
left to find each link.

Candidates come in two rounds.  First each block's classes are paired with the block's least class alone, pairs that pass
the Hamming test are joined to components, and blocks whose classes are all of one component are done with.  What is left
are blocks that hold several components; there all pairs of different components are tested.  Components come from
min-label passes, in Spark.

Links are exact.  `deduplicate` verifies the near pairs first; where that leaves a component of candidates in several parts,
classes outside the largest part are compared with all of the component.  `classes` also counts links, so it computes all
intersections within each component of candidates.

Skew: equal texts collapse to a class within each task.  A block that many classes of a task share sends one of them to
the exchange, and the others go around it.  Blocks of several components with more than SMALL classes are cut into chunks
that are compared in separate tasks, each of which gives a spanning forest of its near pairs and not the pairs.  A large
component is cut into chunks likewise: a task gives a forest of its links and each class's number of links.  Counting
links is quadratic in the number of different texts of one component.

Edge cases: null and empty texts have no shingles and link with nothing; fewer words than a shingle are one shingle;
very long texts are read whole, one at a time; null doc_ids keep rows (with a null component unless an equal or linked
document has an id); repeated rows are equal documents; an empty table gives an empty result; extra columns are ignored
by `classes` and kept by `deduplicate`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_WORDS, batches, discard, materialize, mix, settle, word_hashes

#: Classes of a block that are paired at once, members of a chunk of larger blocks, and of a large component.
SMALL, CHUNK, TILE = 6, 384, 512
#: Shingles of the sets in a chunk of a component, those of the components that share a task, and columns of an incidence matrix.
BUNDLE, PACK, WIDE = 1_000_000, 250_000, 4096
#: Keys that a task of the exchange handles, those that a task gathers before it sends them, and classes of one block there that go around.
PART, GATHER, HOT = 600_000, 600_000, 64
#: Ids of candidates that may be broadcast (32 bytes each at most); more are joined by a shuffle.
BROADCAST_IDS = 500_000
FOLD = 16  # 64-bit words of a folded sketch, at least


def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(smallest size, blocks, slack) of each band up to a size; slack is above the number of empty blocks to expect."""
    out, low = [], 1
    while low <= largest:
        high = max(low + 1, -(-4 * low // 3))
        most = high - 1
        least = (most + 100 * most // percent) * (100 - percent) // (100 + percent) + 1
        slack = 1 + math.ceil(1.3 * least * math.exp(-low * percent / 100 / least))
        out.append((low, least + slack, slack))
        low = high
    return out


def shingle_sets(column, k: int):
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    h, starts = word_hashes(column, SPACE_WORDS)
    n = np.diff(starts)
    width = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    ends = np.cumsum(width)
    begins = np.append(0, ends)
    owner = np.repeat(np.arange(len(n)), width)
    at = starts[:-1][owner] + np.arange(begins[-1]) - begins[:-1][owner]
    size = np.minimum(n, k)[owner]
    out = size.astype(np.uint64)
    for j in range(k):
        live = size > j
        out[live] = out[live] * np.uint64(0x9E3779B97F4A7C15) + h[at[live] + j]
    out = mix(out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[fresh], owner[fresh]
    return out, np.searchsorted(owner, np.arange(len(n) + 1))


def set_ids(shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One 64-bit id of each set."""
    total = np.append(np.uint64(0), np.cumsum(mix(shingles * np.uint64(0xD1342543DE82EF95) + np.uint64(1))))
    n = np.diff(begins).astype(np.uint64)
    return mix(total[begins[1:]] - total[begins[:-1]] + n * np.uint64(0xAF251AF3B0F025B5)).view(np.int64)


def block_keys(own: np.ndarray, percent: int, scheme: list[tuple[int, int, int]]) -> np.ndarray:
    """A 64-bit key of each block of a set's sketches, in the bands that it takes part in."""
    n = len(own)
    k = int(np.searchsorted([low for low, _, _ in scheme], n, "right")) - 1
    bits, out = mix(own + np.uint64(0x9E3779B97F4A7C15)), []
    for band in range(k, -1, -1):
        if band < k and n * percent > 100 * (scheme[band + 1][0] - 1):
            break
        _, blocks, slack = scheme[band]
        block = ((own >> np.uint64(8)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        held, at = np.unique(block[order], return_index=True)
        value = np.bitwise_xor.reduceat(bits[order], at)
        if blocks - len(held) > slack:
            empty = np.setdiff1d(np.arange(blocks), held, assume_unique=True)
            held, value = np.append(held, empty), np.append(value, np.zeros(len(empty), np.uint64))
        out.append(mix(mix(value + np.uint64(band + 1)) + held.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)))
    return np.concatenate(out)


def folded(shingles: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded sketch of each set, of a power of two words and as many bits as it has shingles at least; where each begins."""
    n = np.diff(begins)
    words = np.maximum(FOLD, 1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).clip(0).astype(np.int64))
    at = np.append(0, np.cumsum(words))
    out = np.zeros(at[-1], np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    place = at[owner] + ((shingles >> np.uint64(40)) & (words[owner] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, place, np.uint64(1) << ((shingles >> np.uint64(32)) & np.uint64(63)))
    return out.view(np.int64), at


def narrow(folds: np.ndarray, words: int) -> np.ndarray:
    """Sketches (one a row) folded to fewer words: their Hamming distances stay lower bounds."""
    while folds.shape[1] > words:
        half = folds.shape[1] // 2
        folds = folds[:, :half] ^ folds[:, half:]
    return folds


def stacked(folds: pa.ChunkedArray) -> np.ndarray:
    """Sketches as rows, folded to the narrowest of them."""
    folds = folds.combine_chunks()
    flat, at = folds.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(folds.value_lengths().to_numpy()))
    size = np.diff(at)
    out = np.empty((len(size), int(size.min()) if len(size) else FOLD), np.uint64)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        out[rows] = narrow(flat[at[rows][:, None] + np.arange(n)], out.shape[1])
    return out


class Seen:
    """The classes that a task has met of late."""

    def __init__(self):
        self.ids: set[int] = set()

    def fresh(self, ids: np.ndarray, sizes: np.ndarray) -> list[int]:
        """Numbers of the sets, not empty, that are the first of their class."""
        if len(self.ids) > 500_000:
            self.ids.clear()
        out = []
        for i in np.flatnonzero(sizes).tolist():
            if (c := int(ids[i])) not in self.ids:
                self.ids.add(c)
                out.append(i)
        return out


def _read(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, class of each row; the folded sketch in the first row of a class in each task."""

    def run(it):
        seen = Seen()
        for batch in batches(it):
            shingles, begins = shingle_sets(batch.column("text"), k)
            sizes, ids = np.diff(begins), set_ids(shingles, begins)
            (sketch, at), first = folded(shingles, begins), np.zeros(batch.num_rows, bool)
            first[seen.fresh(ids, sizes)] = True
            width = np.where(first, np.diff(at), 0)
            ends = pa.array(np.append(0, np.cumsum(width)), pa.int32(), mask=np.append(~first, False))
            fold = pa.ListArray.from_arrays(ends, pa.array(sketch[np.repeat(first, np.diff(at))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids), fold], ["doc_id", "n", "class", "fold"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, class long, fold array<long>")


def _runs(block: np.ndarray, owners: np.ndarray):
    """Distinct (block, owner) in order, the number of each block's owners, and its least owner."""
    order = np.lexsort((owners, block))
    block, owners = block[order], owners[order]
    fresh = np.ones(len(block), bool)
    fresh[1:] = (block[1:] != block[:-1]) | (owners[1:] != owners[:-1])
    block, owners = block[fresh], owners[fresh]
    head = np.ones(len(block), bool)
    head[1:] = block[1:] != block[:-1]
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(block)))
    return block, owners, np.repeat(size, size), np.repeat(owners[first], size)


def _packed(docs: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """Blocks and their classes, packed by part; those of blocks that are hot in a task with a number of their own in sub."""

    def send(keys: list, owners: list, number: int):
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        block = ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.int64) << 32 | (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        block, owners, size, least = _runs(block, owners)
        hot = size > HOT
        some = ~hot | (owners == least)
        part = block[some] >> 32
        found, at = np.unique(part, return_index=True)
        ends = np.append(at[1:], len(part))
        low, own = (block[some] & 0xFFFFFFFF).astype("<u4"), owners[some].astype("<i8")
        out = [(int(p), 0, low[a:b].tobytes(), own[a:b].tobytes()) for p, a, b in zip(found, at, ends, strict=True)]
        if hot.any():
            out.append((-1, number, block[hot].astype("<i8").tobytes(), owners[hot].astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "sub", "keys", "classes"])

    def run(it):
        from pyspark import TaskContext

        seen, scheme, keys, owners, held = Seen(), bands(percent, 1 << 10), [], [], 0
        number = TaskContext.get().partitionId() << 20
        for batch in batches(it):
            shingles, begins = shingle_sets(batch.column("text"), k)
            sizes, ids = np.diff(begins), set_ids(shingles, begins)
            for i in seen.fresh(ids, sizes):
                while scheme[-1][0] <= sizes[i]:
                    scheme = bands(percent, 2 * int(sizes[i]))
                own = block_keys(shingles[begins[i] : begins[i + 1]], percent, scheme)
                keys.append(own)
                owners.append(np.full(len(own), ids[i]))
                held += len(own)
                if held >= GATHER:
                    number += 1
                    yield send(keys, owners, number)
                    keys, owners, held = [], [], 0
        if held:
            yield send(keys, owners, number + 1)

    return docs.select("text").mapInArrow(run, "part int, sub long, keys binary, classes binary")


def _shared(packed: DataFrame) -> DataFrame:
    """block, class, center (the block's least class, or that of a task) of blocks that two classes or more share."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), "<i8" if part < 0 else "<u4").astype(np.int64)
        owners = np.frombuffer(b"".join(rows.column("classes").to_pylist()), "<i8")
        block, owners, size, least = _runs(keys if part < 0 else part << 32 | keys, owners)
        many = size > 1
        return pa.table({"block": block[many], "class": owners[many], "center": least[many]})

    return packed.groupBy("part", "sub").applyInArrow(run, "block long, class long, center long")


def _close(n_a, n_b, apart, percent: int) -> np.ndarray:
    """Whether sizes and the distance of folded sketches leave a link possible."""
    fits = (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (n_a > 0)
    return fits & (apart * (100 + percent) <= (n_a + n_b) * (100 - percent))


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """block, class, root, members of the blocks that hold classes of several components."""
    root = labels.select(F.col("class").alias("_class"), "root")
    rows = shared.select("block", "class").join(root, F.col("class") == F.col("_class"), "left").select("block", "class", F.coalesce("root", "class").alias("root"))
    several = rows.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("block").alias("_block"))
    rows = settle(rows.join(several, F.col("block") == F.col("_block")).select("block", "class", "root").distinct(), "open")
    members = rows.groupBy("block").agg(F.count("*").alias("members")).withColumnRenamed("block", "_block")
    return rows.join(members, F.col("block") == F.col("_block")).drop("_block")


def _small_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of classes of different components that share a small block."""
    sets = rows.where(F.col("members") <= SMALL).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("class", "root"))).alias("c"))
    first = sets.select("c").distinct().select("c", F.posexplode("c").alias("i", "x"))
    pairs = first.select("x", F.explode(F.slice("c", F.col("i") + 2, SMALL)).alias("y")).where("x.root <> y.root")
    return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = i = root[root[i]]
    return i


def _hot_near(rows: DataFrame, folds: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the near pairs of different components in each large block, chunk against chunk."""
    n = F.ceil(F.col("members") / CHUNK).cast("int")
    rows = rows.where(F.col("members") > SMALL).withColumns({"chunks": n, "chunk": F.pmod(F.xxhash64("class"), n).cast("int")}).join(folds, "class")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rows = rows.select("block", "class", "root", "n", "fold", "chunk", other)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        ids, n, chunk, root = (rows.column(c).to_numpy() for c in ("class", "n", "chunk", "root"))
        fold = stacked(rows.column("fold"))
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        label, forest = np.unique(root, return_inverse=True)[1], []
        for at, i in enumerate(left.tolist()):
            # Classes that are already in i's tree need no test.
            js = right[at + 1 :] if low == high else right
            js = js[label[js] != label[i]]
            apart = np.bitwise_count(fold[i] ^ fold[js]).sum(axis=1, dtype=np.int64)
            for j in js[_close(np.full(len(js), n[i]), n[js], apart, percent)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    forest.append((i, j))
        ends = ids[np.array(forest, np.int64).reshape(-1, 2)]
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    pair = {"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}
    return rows.withColumns(pair).groupBy("block", "low", "high").applyInArrow(run, "a long, b long")


def _near(pairs: DataFrame, folds: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and folded sketches leave possible."""
    a = folds.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("fold").alias("fold_a"))
    b = folds.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("fold").alias("fold_b"))
    x, y = F.col("fold_a"), F.col("fold_b")
    words, both = F.least(F.size(x), F.size(y)), F.col("n_a") + F.col("n_b")

    def half(f):
        w = F.shiftright(F.size(f), 1)
        return F.when(F.size(f) > words, F.zip_with(F.slice(f, F.lit(1), w), F.slice(f, w + 1, w), lambda p, q: p.bitwiseXOR(q))).otherwise(f)

    # Sizes that fit are at most 100 / percent apart, so are the sketches' widths, but for the step to a power of two.
    for _ in range(1 + math.ceil(math.log2(100 / percent))):
        x, y = half(x), half(y)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(a, "a").join(b, "b").where(F.when(fits, apart * (100 + percent) <= both * (100 - percent)).otherwise(False)).select("a", "b")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of different sets, from products of incidence matrices of bounded width."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    found, code = np.unique(code[shared], return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[shared][order]
    total = np.zeros((m, m), np.float32)
    for a in range(0, len(found), WIDE):
        low, high = np.searchsorted(code, [a, a + WIDE])
        held = np.zeros((m, min(WIDE, len(found) - a)), np.float32)
        held[owner[low:high], code[low:high] - a] = 1
        total += held @ held.T
    return total.astype(np.int32)


def _sets(docs: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """_class, set: the sets of the classes in heads (class, doc_id), read again from the documents that have the doc_ids."""
    few = heads.count() <= BROADCAST_IDS
    small = lambda df: F.broadcast(df) if few else df
    ids = heads.select(F.col("doc_id").alias("head")).distinct()
    own = docs.select("doc_id", "text").join(small(ids), F.col("doc_id").eqNullSafe(F.col("head")), "left_semi")

    def run(it):
        seen = Seen()
        for batch in batches(it):
            shingles, begins = shingle_sets(batch.column("text"), k)
            ids = set_ids(shingles, begins)
            rows = seen.fresh(ids, np.diff(begins))
            sets = [shingles[begins[i] : begins[i + 1]].astype("<u8").tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(sets, pa.binary())], ["_class", "set"])

    return own.mapInArrow(run, "_class long, set binary")


def _with_sets(work: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The rows of work (class, doc_id and others) with their classes' sets; a class may come from two tasks."""
    few = work.count() <= BROADCAST_IDS
    found = _sets(docs, work.select("class", "doc_id").distinct(), k)
    return found.join(F.broadcast(work) if few else work, F.col("_class") == F.col("class")).drop("_class", "doc_id")


def _true_pairs(edges: DataFrame, of: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: the pairs among edges that link.  Pairs are gathered by a, in parts of about PACK shingles."""
    own = of.select("class", "doc_id", "n")
    right = edges.join(own, F.col("b") == F.col("class")).select("a", "class", "doc_id", "n")
    parts = right.groupBy("a").agg(F.ceil(F.sum("n") / PACK).cast("int").alias("parts"), F.sum("n").alias("total")).withColumnRenamed("a", "_a")
    parts = settle(parts, "parts")
    bins = int((parts.where("parts = 1").agg(F.sum("total")).first()[0] or 0) // PACK) + 1
    part = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("a"), F.lit(bins)))
    right = right.join(parts, F.col("a") == F.col("_a"))
    right = right.select("a", "class", "doc_id", F.coalesce(part, F.col("a")).alias("place"), F.when(F.col("parts") > 1, F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).otherwise(-1).alias("part"), F.lit(False).alias("center"))
    left = own.join(parts, F.col("class") == F.col("_a")).select(F.col("class").alias("a"), "class", "doc_id", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    left = left.select("a", "class", "doc_id", F.coalesce(part, F.col("a")).alias("place"), F.when(F.col("parts") > 1, F.col("i")).otherwise(-1).alias("part"), F.lit(True).alias("center"))
    work = settle(left.union(right), "work")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, ids, center = (rows.column(c).to_numpy() for c in ("a", "class", "center"))
        sets = [np.frombuffer(x, "<u8") for x in rows.column("set").to_pylist()]
        at, out = {int(a[i]): sets[i] for i in np.flatnonzero(center)}, []
        order = np.argsort(a, kind="stable")
        order = order[~center[order]]
        for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(order) else []:
            mine, own = at[int(a[part[0]])], [sets[i] for i in part]
            size = np.array([len(x) for x in own])
            every = np.concatenate(own)
            hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
            out += [(int(a[i]), int(ids[i])) for i in part[100 * both >= percent * (size + len(mine) - both)]]
        return pa.table([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    return _with_sets(work, docs, k).select("place", "part", "a", "class", "center", "set").groupBy("place", "part").applyInArrow(run, "a long, b long")


def _members(groups: DataFrame, of: DataFrame, links: DataFrame | None) -> DataFrame:
    """class, root, doc_id, copies, n, own, chunks, first: who is to be compared within each component.

    links None: all with all, own is the class.  Else own is the class's component by links (class, root); components of one
    own have nothing left to compare, and in others the classes of the largest own are compared with the others alone: these
    are in the chunks up to first, the others of the largest one behind them.
    """
    rows = groups.join(of.select("class", "doc_id", "n", "copies"), "class")
    if links is None:
        rows = rows.withColumns({"own": F.col("class"), "main": F.lit(False)})
    else:
        found = links.select(F.col("class").alias("_class"), F.col("root").alias("own"))
        rows = rows.join(found, F.col("class") == F.col("_class"), "left").withColumn("own", F.coalesce("own", "class")).drop("_class")
        sizes = rows.groupBy("root", "own").agg(F.sum("n").alias("total"))
        sizes = sizes.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("owns"), F.max(F.struct("total", "own"))["own"].alias("_own"))
        rows = rows.join(sizes.where("owns > 1").select("_root", "_own"), F.col("root") == F.col("_root")).withColumn("main", F.col("own") == F.col("_own")).drop("_root", "_own")
    parts = lambda which: F.greatest(F.ceil(F.count_if(which) / TILE), F.ceil(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / BUNDLE)).cast("int")
    sizes = rows.groupBy(F.col("root").alias("_root")).agg(parts(~F.col("main")).alias("first"), parts(F.col("main")).alias("behind"), F.count("*").alias("all"), F.sum("n").alias("total"))
    rows = rows.join(sizes, F.col("root") == F.col("_root"))
    whole = (F.col("all") <= TILE) & (F.col("total") <= BUNDLE)
    at = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    chunk = F.when(whole, 0).when(F.col("main"), F.col("first") + at(F.greatest(F.col("behind"), F.lit(1)))).otherwise(at(F.greatest(F.col("first"), F.lit(1))))
    return rows.select("class", "root", "doc_id", "copies", "n", "own", whole.alias("whole"), chunk.alias("chunk"), F.when(F.col("main"), F.col("first")).otherwise(F.col("first") + F.col("behind")).alias("others"))


def _verify(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links within each component of candidates, as rows of class, root, others, a, b.

    others counts the documents that a class links with.  A component that fits a task gives each linked class's root;
    of one that is cut into chunks, a task gives (a, b), a spanning forest of its links.  Classes of one own need no test.
    """
    bins = int((members.where("whole").agg(F.sum("n")).first()[0] or 0) // PACK) + 1
    whole = F.col("whole")
    rows = members.withColumn("other", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("others") - 1))))
    rows = settle(rows.select(
        "class", "doc_id", "root", "own", "copies", "chunk", F.when(whole, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("place"),
        F.when(whole, -1).otherwise(F.least("chunk", "other")).alias("low"), F.when(whole, -1).otherwise(F.greatest("chunk", "other")).alias("high"),
    ), "work")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        # Rows of one class that two tasks have read are one.
        _, once = np.unique(rows.column("class").to_numpy(), return_index=True)
        rows = rows.take(pa.array(once))
        ids, roots, own, copies, chunk = (rows.column(c).to_numpy() for c in ("class", "root", "own", "copies", "chunk"))
        sets = [np.frombuffer(x, "<u8") for x in rows.column("set").to_pylist()]
        order = np.lexsort((ids, roots))
        parts = np.split(order, np.flatnonzero(np.diff(roots[order])) + 1) if len(order) else []
        out = []
        for part in parts:
            both, size = overlaps([sets[i] for i in part]), np.array([len(sets[i]) for i in part], np.int32)
            link = np.triu(100 * both >= percent * (size[:, None] + size - both), 1)
            link &= own[part][:, None] != own[part]
            if low != high:
                link &= chunk[part][:, None] != chunk[part]
            x, y = np.nonzero(link)
            others = np.zeros(len(part), np.int64)
            np.add.at(others, x, copies[part[y]])
            np.add.at(others, y, copies[part[x]])
            tree = list(range(len(part)))
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                a, b = _find(tree, i), _find(tree, j)
                if a != b:
                    tree[max(a, b)] = min(a, b)
                    if low >= 0:
                        out.append((None, None, None, int(ids[part[i]]), int(ids[part[j]])))
            for i in np.flatnonzero(others).tolist():
                out.append((int(ids[part[i]]), int(ids[part[_find(tree, i)]]) if low < 0 else None, int(others[i]), None, None))
        of = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(x, pa.int64()) for x in of], ["class", "root", "others", "a", "b"])

    rows = _with_sets(rows, docs, k).select("place", "low", "high", "root", "own", "class", "set", "copies", "chunk")
    return rows.groupBy("place", "low", "high").applyInArrow(run, "class long, root long, others long, a long, b long")


def forest(links: DataFrame) -> DataFrame:
    """a, b: a spanning forest of each task's links, which joins the same classes."""

    def run(it):
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (j := root.setdefault(i, i)) != i:
                root[i] = i = root[j]
            return i

        for batch in it:
            kept = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """class, root for every class with a link: min-label passes with jumps, each written to the shared folder."""
    once = forest(links).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    both = settle(once.select("x.a", "x.b"), "edges")
    labels = settle(both.groupBy(F.col("a").alias("class")).agg(F.least(F.col("class"), F.min("b")).alias("root")), "labels")
    while True:
        root = labels.select(F.col("class").alias("b"), F.col("root").alias("near"))
        lower = both.join(root, "b").groupBy(F.col("a").alias("class")).agg(F.min("near").alias("near"))
        stepped = labels.join(lower, "class").select("class", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = stepped.select(F.col("class").alias("root"), F.col("root").alias("next"))
        moved = settle(stepped.join(jump, "root", "left").select("class", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        discard(labels)
        labels = moved.select("class", "root")
        labels.table = moved.table
        if moved.where("old <> root").isEmpty():
            discard(both)
            return labels


def _candidates(shared: DataFrame, folds: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """class, root: components of near classes, in two rounds; a, b: the near pairs that joined them."""
    star = shared.where("class <> center").select(F.col("center").alias("a"), F.col("class").alias("b")).distinct()
    near = settle(_near(star, folds, percent), "near")
    labels = components(near)
    rest = _open(shared, labels)
    more = settle(_near(_small_pairs(rest), folds, percent).union(_hot_near(rest, folds, percent)), "near")
    if more.isEmpty():
        return labels, near
    groups = components(labels.select(F.col("class").alias("a"), F.col("root").alias("b")).where("a <> b").union(more))
    both = settle(near.union(more).distinct(), "near")
    discard(labels, near, more)
    return groups, both


def _roots(groups: DataFrame, edges: DataFrame, of: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """class, root of the classes that link, without counts: near pairs are verified first, then what they leave apart."""
    links = settle(_true_pairs(edges, of, docs, k, percent), "links")
    labels = components(links)
    members = settle(_members(groups, of, labels), "members")
    if members.isEmpty():
        return labels
    found = settle(_verify(members, docs, k, percent), "links")
    more = found.where("root is not null and root <> class").select(F.col("class").alias("a"), F.col("root").alias("b")).union(found.where("a is not null").select("a", "b"))
    out = components(links.union(more))
    discard(links, labels, members, found)
    return out


def _resolve(docs: DataFrame, k: int, percent: int, counts: bool) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, class of each row; class, component_id, n_links (if counts), head of each class with shingles.

    head: whether the class has its component's smallest doc_id; one class of each component has it.
    """
    read = materialize(_read(docs, k), "read")
    rows = read.select("doc_id", "n", "class")
    sets_of = read.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("fold").alias("fold"))
    sets_of = materialize(sets_of, "sets")
    keys = (sets_of.agg(F.sum("n")).first()[0] or 0) * 4 * (100 - percent) / (100 + percent)
    shared = materialize(_shared(_packed(docs, k, percent, max(1, int(keys / PART)))), "shared")
    groups, edges = _candidates(shared, sets_of.select("class", "n", "fold"), percent)
    discard(shared)
    others = F.lit(0)
    if counts:
        members = settle(_members(groups, sets_of, None), "members")
        found = settle(_verify(members, docs, k, percent), "links")
        discard(members)
        roots = found.where("root is not null").select("class", "root").union(components(found.where("a is not null").select("a", "b")))
        degree = found.where("class is not null").groupBy("class").agg(F.sum("others").alias("others"))
        of, others = sets_of.join(roots, "class", "left").join(degree, "class", "left"), F.col("others")
    else:
        of = sets_of.join(_roots(groups, edges, sets_of, docs, k, percent), "class", "left")
    discard(groups, edges)
    of = of.select("class", "doc_id", F.coalesce("root", "class").alias("root"), (F.col("copies") - 1 + F.coalesce(others, F.lit(0))).alias("n_links"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("first")
    least = of.groupBy("root").agg(first).select("root", F.col("first.doc_id").alias("component_id"), F.col("first.class").alias("_first"))
    of = of.join(least, "root").select("class", "component_id", "n_links", (F.col("class") == F.col("_first")).alias("head"))
    return rows, materialize(of, "classes")


def classes(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links per row of docs."""
    rows, of = _resolve(docs, k, percent, counts=True)
    linked = rows.where("n > 0").join(of, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.union(alone)


def _with_class(docs: DataFrame, k: int) -> DataFrame:
    """docs and the class of each row in _class."""

    def run(it):
        for batch in batches(it):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(set_ids(*shingle_sets(batch.column("text"), k)))], [*batch.schema.names, "_class"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_class", T.LongType())]))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, one of the smallest doc_id; rows without words all stay."""
    names = docs.columns
    # Columns of any name may come along: here they have names that nothing else has.
    docs = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_x{i}") for i, c in enumerate(names)])
    rows, of = _resolve(docs, k, percent, counts=False)
    # A doc_id that one row has names that row; of others, and of null, a row is told by its class too.
    repeats = rows.groupBy("doc_id").agg((F.col("doc_id").isNull() | (F.count("*") > 1)).alias("_again"))
    heads = of.where("head").select(F.col("component_id").alias("_head"), F.col("class").alias("_own"))
    heads = settle(heads.join(repeats, F.col("_head").eqNullSafe(F.col("doc_id"))).drop("doc_id"), "heads")
    few = heads.count() <= BROADCAST_IDS
    small = lambda df: F.broadcast(df) if few else df
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    bare, docs = docs.where(~worded), docs.where(worded)
    kept = docs.join(small(heads.where("not _again").select("_head")), F.col("doc_id") == F.col("_head"), "left_semi").union(bare)
    again = heads.where("_again")
    if again.isEmpty():
        return kept.toDF(*names)
    # Only rows whose doc_id repeats are gathered, by their class.
    own = docs.join(small(again.select("_head").distinct()), F.col("doc_id").eqNullSafe(F.col("_head")), "left_semi")
    own = _with_class(own, k).join(small(again), (F.col("_class") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_head")), "left_semi")
    return kept.union(own.dropDuplicates(["_class"]).drop("_class")).toDF(*names)
