"""Masked pseudo-likelihood: a bidirectional window network in numpy predicts every token from both sides.

Tokens are lower-cased words.  Their counts over all documents give the vocabulary: words with a count of at least
sqrt(all tokens) / OWN are named, so their number grows with the corpus.  The CLASSES / 2 most frequent words have a class
each; the other named words are leaves of the remaining classes, by hash, and every class has one leaf for its words
without a name, which share the leaf's probability by their counts.  The network sees the embeddings of the SIDE words
before and after a place and gives a distribution over the classes, and one over the leaves of the masked word's class,
so a place's probabilities of all words of the corpus sum to 1.  A document's score is the sum of its tokens' conditional
log-probabilities, and the mean per token.

Training: the texts' leaves are dealt by a hash of their words to copies of the network, one for each COPY tokens of the
corpus.  A copy takes its texts in order of that hash, equal texts once with their number as weight, in one pass of Adam
steps from the same start; the copies' weights are averaged in Spark, weighted by their tokens.  All of it depends on the
texts alone, not on the files or tasks that hold them.

What is gathered grows with the corpus: word counts, the named words and one set of weights per copy.  The named words go
to the executors; counts of the others are joined to the places that hold them.

Edge cases: null and empty texts have no tokens, a sum of 0 and a null mean; very long texts are read whole; repeated
rows and null doc_ids keep their rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, batches, materialize, mix, word_hashes

CLASSES, WIDTH, SIDE, STEP, RATE = 64, 16, 2, 32768, 0.02
STEPS = 240
#: Places whose class distributions are computed at once, so that they stay in the cache.
CACHED = 1024
#: Tokens of the corpus for each copy that is trained.
COPY = 8_000_000
SLICE = 2 << 20
#: The square root of all tokens over this is the least count of a named word.
OWN = 8
#: Words that a task counts before it sends them.
HELD = 2_000_000
#: Weights that travel in one row.
BLOCK = 4096


def initial(vocabulary: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    base, lean = np.log(vocabulary.total + 1.0), np.log(np.maximum(vocabulary.count, 1e-9))
    return {
        "in": r.normal(0, 0.1, (2 * SIDE, vocabulary.leaves + 1, WIDTH)).astype(np.float32),
        "out": np.zeros((WIDTH, vocabulary.n), np.float32), "base": (base - base.mean()).astype(np.float32),
        "leaf": np.zeros((vocabulary.leaves, WIDTH), np.float32), "lean": lean.astype(np.float32),
    }


def word_counts(docs: DataFrame) -> DataFrame:
    """word (64-bit hash), n over all documents; summed within each task before the exchange."""

    def send(parts: list):
        words, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(words)
        words, n = words[order], n[order]
        first = np.flatnonzero(np.append(len(words) > 0, words[1:] != words[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(words[first]), pa.array(np.add.reduceat(n, first) if len(first) else n)], ["word", "n"])

    def run(it):
        parts, held = [], 0
        for batch in batches(it, 4 * SLICE):
            parts.append(np.unique(word_hashes(batch.column("text"), SPACE_WORDS)[0].view(np.int64), return_counts=True))
            held += len(parts[-1][0])
            if held > HELD:
                yield send(parts)
                parts, held = [], 0
        if parts:
            yield send(parts)

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Leaves of words, classes of leaves, and the counts of both.

    Leaves first[c] to first[c + 1] are of class c; the first one of a class with many is for its words without a name.
    """

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("n")).first()[0] or 0
        floor = max(2, math.ceil(math.sqrt(total) / OWN))
        found = {r.word: r.n for r in counts.where(F.col("n") >= floor).collect()} | {r.word: r.n for r in counts.orderBy(F.desc("n"), "word").limit(CLASSES // 2).collect()}
        ranked = sorted(found, key=lambda w: (-found[w], w))
        heads, others = ranked[: CLASSES // 2], np.array(ranked[CLASSES // 2 :], np.int64)
        self.heads = len(heads)
        self.buckets = max(CLASSES - self.heads, math.ceil(math.sqrt(len(others))))
        self.n = self.heads + self.buckets
        named = counts.sparkSession.createDataFrame([(w,) for w in found], "word long")
        rest = counts.join(F.broadcast(named), "word", "left_anti").groupBy(F.pmod("word", F.lit(self.buckets)).alias("c")).agg(F.sum("n").alias("n"))
        own = others % self.buckets
        others = others[order := np.argsort(own, kind="stable")]
        width = np.append(np.ones(self.heads, np.int64), 1 + np.bincount(own, minlength=self.buckets))
        self.first = np.append(0, np.cumsum(width))
        self.leaves = int(self.first[-1])
        self.of = np.repeat(np.arange(self.n), width)
        spare = self.first[self.heads : -1]
        leaf = np.append(np.arange(self.heads), np.setdiff1d(np.arange(self.heads, self.leaves), spare))
        words = np.append(np.array(heads, np.int64), others)
        self.count = np.zeros(self.leaves)
        self.count[leaf] = [found[int(w)] for w in words]
        for r in rest.collect():
            self.count[spare[r.c]] = r.n
        self.total = np.add.reduceat(self.count, self.first[:-1])
        self.spare = np.zeros(self.leaves, bool)
        self.spare[spare] = True
        self.words, self.leaf = words[order := np.argsort(words)], leaf[order]
        self._index()

    def find(self, words: np.ndarray) -> np.ndarray:
        """The leaf of each word: the named word in its slot, or one of those that share a slot, or its class's spare leaf."""
        words = words.view(np.int64)
        out = self.first[self.heads + words % self.buckets]
        slot = words & self.mask
        own = self.slots[slot]
        hit = self.words[own] == words
        out[hit] = self.leaf[own[hit]]
        if len(self.crowded):
            left = np.flatnonzero(~hit & self.shared[slot])
            at = np.minimum(np.searchsorted(self.crowded, words[left]), len(self.crowded) - 1)
            right = self.crowded[at] == words[left]
            out[left[right]] = self.crowded_leaf[at[right]]
        return out

    def _index(self) -> None:
        """Slots of the named words by their low bits; words whose slot another one has are kept apart, sorted."""
        size = 8 << max(4, len(self.words).bit_length())
        self.mask = size - 1
        slot = self.words & self.mask
        self.slots = np.zeros(size, np.int64)
        self.slots[slot] = np.arange(len(self.words))
        late = self.slots[slot] != np.arange(len(self.words))
        self.shared = np.zeros(size, bool)
        self.shared[slot[late]] = True
        self.crowded, self.crowded_leaf = self.words[late], self.leaf[late]
        if not len(self.words):
            self.words, self.leaf = np.zeros(1, np.int64), np.full(1, self.first[self.heads + 0 % self.buckets])


def contexts(leaves: np.ndarray, starts: np.ndarray, beyond: int) -> np.ndarray:
    """The leaves around each place, one row for each side and distance, and a number for what is beyond a text's ends."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.arange(len(leaves)) + SIDE * (owner + 1)
    padded = np.full(len(leaves) + SIDE * len(starts), beyond, np.int64)
    padded[at] = leaves
    return np.stack([padded[at + d] for d in range(-SIDE, SIDE + 1) if d])


def hidden_of(w: dict, around: np.ndarray) -> np.ndarray:
    hidden = w["in"][0].take(around[0], 0)
    for j in range(1, 2 * SIDE):
        hidden += w["in"][j].take(around[j], 0)
    return np.tanh(hidden, out=hidden)


def class_logits(w: dict, hidden: np.ndarray):
    """Parts of the places: from, to, and their logits over the classes, each place's less a number so that exp is safe.

    Hidden values are at most 1, so all logits have a bound, and a place's largest is near it while the weights are small.
    """
    size = np.abs(w["out"]).sum(0)
    base = w["base"] - (size + w["base"]).max()
    for a in range(0, len(hidden), CACHED):
        logits = hidden[a : a + CACHED] @ w["out"]
        logits += base
        if size.max() > 30:
            logits -= logits.max(1, keepdims=True)
        yield a, a + len(logits), logits


def split(w: dict, hidden: np.ndarray, y: np.ndarray, vocabulary: Vocabulary):
    """For each class of many leaves among the leaves y: its places, leaves from and to, and logits over these."""
    own = vocabulary.of[y]
    order = np.argsort(own.astype(np.uint16) if vocabulary.n < 1 << 16 else own, kind="stable")
    found, at = np.unique(own[order], return_index=True)
    sorted_hidden = hidden[order]
    for c, low, high in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(y)], strict=True):
        a, b = int(vocabulary.first[c]), int(vocabulary.first[c + 1])
        if b - a > 1:
            logits = sorted_hidden[low:high] @ w["leaf"][a:b].T
            logits += w["lean"][a:b]
            logits -= logits.max(1, keepdims=True)
            yield order[low:high], a, b, logits, sorted_hidden[low:high]


def log_probabilities(w: dict, around: np.ndarray, y: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Of the leaf at each place."""
    hidden, out, own = hidden_of(w, around), np.empty(len(y)), vocabulary.of[y]
    for a, b, logits in class_logits(w, hidden):
        out[a:b] = logits[np.arange(b - a), own[a:b]]
        out[a:b] -= np.log(np.exp(logits, out=logits).sum(1))
    for rows, a, _, logits, _ in split(w, hidden, y, vocabulary):
        own = logits[np.arange(len(rows)), y[rows] - a]
        out[rows] += own - np.log(np.exp(logits, out=logits).sum(1))
    return out


def gradient(w: dict, around: np.ndarray, y: np.ndarray, weight: np.ndarray, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Of the weighted mean of minus log_probabilities."""
    g = {k: np.zeros_like(v) for k, v in w.items()}
    hidden = hidden_of(w, around)
    share, own = (weight / weight.sum()).astype(hidden.dtype), vocabulary.of[y]
    d = np.empty_like(hidden)
    for a, b, p in class_logits(w, hidden):
        np.exp(p, out=p)
        part = share[a:b] / p.sum(1)
        d[a:b] = p @ w["out"].T
        d[a:b] *= part[:, None]
        g["out"] += (hidden[a:b] * part[:, None]).T @ p
        g["base"] += part @ p
    # The places' own classes, taken off.
    d -= w["out"].T.take(own, 0) * share[:, None]
    order = np.argsort(own.astype(np.uint16) if vocabulary.n < 1 << 16 else own, kind="stable")
    at = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
    g["out"][:, own[order][at]] -= np.add.reduceat((hidden * share[:, None])[order], at, axis=0).T
    g["base"] -= np.bincount(own, share, vocabulary.n).astype(g["base"].dtype)
    for rows, low, high, q, own in split(w, hidden, y, vocabulary):
        np.exp(q, out=q)
        q *= (share[rows] / q.sum(1))[:, None]
        q[np.arange(len(rows)), y[rows] - low] -= share[rows]
        d[rows] += q @ w["leaf"][low:high]
        g["leaf"][low:high] = q.T @ own
        g["lean"][low:high] = q.sum(0)
    d *= 1 - hidden**2
    for j in range(2 * SIDE):
        order = np.argsort(around[j].astype(np.uint16) if vocabulary.leaves < 1 << 16 else around[j], kind="stable")
        near = around[j][order]
        at = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
        g["in"][j][near[at]] = np.add.reduceat(d[order], at, axis=0)
    return g


class Trainer:
    """One pass of about STEPS Adam steps, of STEP places at most each."""

    def __init__(self, start: dict, vocabulary: Vocabulary, places: int):
        self.size = max(256, min(STEP, places // STEPS))
        self.w, self.vocabulary, self.steps = {k: v.copy() for k, v in start.items()}, vocabulary, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in start.items()} for _ in range(2))

    def learn(self, around: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        for a in range(0, len(y), self.size):
            b = a + self.size
            g = gradient(self.w, around[:, a:b], y[a:b], weight[a:b], self.vocabulary)
            self.steps += 1
            rate = RATE * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps) / (1 + self.steps / 200)
            for k, x in g.items():
                m, v = self.mean[k], self.square[k]
                m *= 0.9
                m += 0.1 * x
                v *= 0.99
                x *= x
                v += 0.01 * x
                self.w[k] -= (rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)


def text_keys(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each text's words."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(starts[:-1].astype(np.uint64), np.diff(starts))
    total = np.append(np.uint64(0), np.cumsum(mix(words + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))))
    return mix(total[starts[1:]] - total[starts[:-1]] + np.diff(starts).astype(np.uint64))


def train(docs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Copies trained on the texts that are dealt to them, averaged by their tokens."""
    start = initial(vocabulary)
    copies = max(1, math.ceil(vocabulary.total.sum() / COPY))
    kind = "<u2" if vocabulary.leaves < 1 << 16 else "<u4"

    def deal(it):
        more: dict[int, int] = {}

        def rest():
            again = [k for k, n in more.items() if n]
            return pa.RecordBatch.from_arrays(
                [pa.array([k % copies for k in again], pa.int64()), pa.array(np.array(again, np.uint64).view(np.int64)), pa.array([more[k] for k in again], pa.int64()), pa.nulls(len(again), pa.binary())],
                ["copy", "key", "times", "leaves"],
            )

        for batch in batches(it, SLICE):
            words, starts = word_hashes(batch.column("text"), SPACE_WORDS)
            y, keys = vocabulary.find(words).astype(kind), text_keys(words, starts).tolist()
            out = []
            for i in np.flatnonzero(np.diff(starts)).tolist():
                if (key := keys[i]) in more:
                    more[key] += 1
                else:
                    more[key] = 0
                    out.append((key % copies, key, 1, y[starts[i] : starts[i + 1]].tobytes()))
            own = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.int64()), pa.array(np.array(own[1], np.uint64).view(np.int64)), pa.array(own[2], pa.int64()), pa.array(own[3], pa.binary())], ["copy", "key", "times", "leaves"])
            if len(more) > 200_000:
                yield rest()
                more.clear()
        yield rest()

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("leaves", "ascending")])  # nulls come last
        keys, times, found = rows.column("key").to_numpy(), rows.column("times").to_numpy(), rows.column("leaves").combine_chunks()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.add.reduceat(times, first)
        sizes = np.array([len(found[i].as_buffer()) for i in first.tolist()]) // np.dtype(kind).itemsize
        trainer = Trainer(start, vocabulary, int(sizes.sum()))
        part = (np.cumsum(sizes) - sizes) // (8 * trainer.size)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            y = np.concatenate([np.frombuffer(found[i].as_buffer(), kind) for i in first[own].tolist()]).astype(np.int64)
            starts = np.append(0, np.cumsum(sizes[own]))
            trainer.learn(contexts(y, starts, vocabulary.leaves), y, np.repeat(times[own], sizes[own]).astype(np.float64))
        flat = np.concatenate([v.ravel() for v in trainer.w.values()])
        at = list(range(0, len(flat), BLOCK))
        n = [float((times * sizes).sum())] * len(at)
        return pa.table({"at": pa.array(at, pa.int64()), "copy": pa.array([key[0].as_py()] * len(at), pa.int64()), "x": pa.array([flat[a : a + BLOCK].tobytes() for a in at], pa.binary()), "n": pa.array(n)})

    def mean(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("copy")
        n = rows.column("n").to_numpy()
        x = sum(np.frombuffer(x, np.float32) * k for x, k in zip(rows.column("x").to_pylist(), n, strict=True)) / n.sum()
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "x": pa.array([x.astype(np.float32).tobytes()], pa.binary())})

    out = np.concatenate([v.ravel() for v in start.values()])
    dealt = docs.select("text").mapInArrow(deal, "copy long, key long, times long, leaves binary")
    # Few copies share a task: training takes longer than its bytes tell.
    trained = dealt.repartition(4 * copies, "copy").groupBy("copy").applyInArrow(fit, "at long, copy long, x binary, n double")
    for r in trained.groupBy("at").applyInArrow(mean, "at long, x binary").collect():
        own = np.frombuffer(r.x, np.float32)
        out[r.at : r.at + len(own)] = own
    parts, at = {}, 0
    for k, v in start.items():
        parts[k] = out[at : at + v.size].reshape(v.shape)
        at += v.size
    return parts


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (natural), mean_log_likelihood."""
    counts = materialize(word_counts(docs), "words")
    vocabulary = Vocabulary(counts)
    weights = train(docs, vocabulary)
    spread = np.where(vocabulary.spare, np.log(np.maximum(vocabulary.count, 1)), 0)

    def run(it):
        for batch in batches(it, SLICE):
            words, starts = word_hashes(batch.column("text"), SPACE_WORDS)
            y = vocabulary.find(words)
            around, value = contexts(y, starts, vocabulary.leaves), np.zeros(len(y) + 1)
            for a in range(0, len(y), 4 * STEP):
                own = y[a : a + 4 * STEP]
                value[a + 1 : a + 1 + len(own)] = log_probabilities(weights, around[:, a : a + 4 * STEP], own, vocabulary) - spread[own]
            total, n = np.cumsum(value), np.diff(starts)
            spare = vocabulary.spare[y]
            ends = np.append(0, np.cumsum(spare))[starts]
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[spare].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(total[starts[1:]] - total[starts[:-1]]), rest],
                ["doc_id", "n_tokens", "value", "rest"],
            )

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, value double, rest array<long>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # A word without a name has its count's share of its leaf.
    more = scored.select("row", F.explode("rest").alias("word")).join(counts, "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    out = scored.drop("rest").join(more, "row", "left").select("doc_id", "n_tokens", (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.nullif(F.col("n_tokens"), F.lit(0)))
