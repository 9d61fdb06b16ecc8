"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes at every STRIDE-th byte read the whole text; each overlapping chunk of a text max-pools them, a
dense layer makes a chunk's features, their mean over all chunks gives one probability.  The filters' response to a byte
at a place is a table look-up, so scoring costs a few additions per byte.

The network is fitted on a bounded sample of labelled rows (SAMPLE rows of at most SAMPLE_BYTES bytes, in hash order of
doc_id, outside the held-out fold); its few thousand weights travel to the executors.  Only the text is an input.

Edge cases: null and empty texts are one chunk of padding and get that score; null doc_ids are not held out; repeated
rows keep their rows; without labelled rows every score is 0.5; extra columns are ignored by `score`, kept by `apply`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bound_batches, text_buffers

WIDTH, STRIDE, FILTERS, HIDDEN = 8, 4, 16, 16
HALF = 128  # positions; a chunk is two halves, and the next chunk shares one
PAD = 256
SAMPLE, SAMPLE_BYTES, EPOCHS, FOLDS = 3000, 16_384, 12, 5
THRESHOLD = 0.3


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def lay_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, padded so that each begins at a position; positions at which each begins.

    A text's last position is a gap, so that no filter's bytes are of the next text.
    """
    sizes = np.diff(offsets)
    begins = np.append(0, np.cumsum(np.maximum(1, -(-sizes // STRIDE)) + 1))
    out = np.full(STRIDE * (begins[-1] + 1) + WIDTH, PAD, np.int64)
    n = int(offsets[-1] - offsets[0])
    out[np.repeat(STRIDE * begins[:-1] - (offsets[:-1] - offsets[0]), sizes) + np.arange(n)] = data[offsets[0] : offsets[-1]]
    return out, begins


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w = {
            "taps": (r.normal(0, 0.25, (WIDTH, PAD + 1, FILTERS))).astype(np.float32), "shift": np.zeros(FILTERS, np.float32),
            "dense": r.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32), "lean": np.zeros(HIDDEN, np.float32),
            "out": np.zeros(HIDDEN, np.float32), "base": np.zeros(1, np.float32),
        }

    def filters(self, laid: np.ndarray, n: int) -> np.ndarray:
        total = np.empty((n, FILTERS), np.float32)
        for a in range(0, n, 1 << 15):
            b = min(n, a + (1 << 15))
            part = self.w["taps"][0][laid[STRIDE * a : STRIDE * b : STRIDE]]
            for j in range(1, WIDTH):
                part += self.w["taps"][j][laid[STRIDE * a + j : STRIDE * b + j : STRIDE][: b - a]]
            total[a:b] = part
        return total

    def pool(self, laid: np.ndarray, begins: np.ndarray):
        """Max of each chunk, its text, and the first positions of its halves."""
        sizes = np.diff(begins) - 1
        halves = -(-sizes // HALF)
        ends = np.cumsum(halves)
        owner = np.repeat(np.arange(len(sizes)), halves)
        start = begins[:-1][owner] + HALF * (np.arange(ends[-1]) - (ends - halves)[owner])
        response = self.filters(laid, int(begins[-1]))
        response[begins[1:] - 1] = -np.inf  # the gaps
        top = np.maximum.reduceat(response, start, axis=0)
        # A text's last half is a chunk of its own only if it is the single one.
        head = np.flatnonzero((np.arange(len(owner)) != (ends - 1)[owner]) | (halves[owner] == 1))
        pair = np.where(halves[owner[head]] == 1, head, head + 1)
        return np.maximum(top[head], top[pair]), owner[head], start[head], response

    def forward(self, laid, begins):
        pooled, owner, start, response = self.pool(laid, begins)
        seen = np.maximum(pooled + self.w["shift"], 0)
        hidden = np.tanh(seen @ self.w["dense"] + self.w["lean"])
        count = np.bincount(owner, minlength=len(begins) - 1).astype(np.float32)
        mean = np.add.reduceat(hidden, np.searchsorted(owner, np.arange(len(begins) - 1)), axis=0) / count[:, None]
        p = 1 / (1 + np.exp(-(mean @ self.w["out"] + self.w["base"][0])))
        return p, (pooled, owner, start, response, seen, hidden, count, mean)

    def gradient(self, laid, begins, y):
        p, (pooled, owner, start, response, seen, hidden, count, mean) = self.forward(laid, begins)
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"out": mean.T @ d, "base": d.sum(keepdims=True)}
        dh = (d / count)[owner][:, None] * self.w["out"] * (1 - hidden**2)
        g |= {"dense": seen.T @ dh, "lean": dh.sum(0)}
        dp = (dh @ self.w["dense"].T) * (seen > 0)
        g["shift"] = dp.sum(0)
        # The gradient reaches only the window that won each chunk's max.
        ends = np.minimum(start + 2 * HALF, begins[1:][owner])
        index = np.minimum(start[:, None] + np.arange(2 * HALF), ends[:, None] - 1)
        won = start[:, None] + response[index].argmax(1)
        taps = np.zeros_like(self.w["taps"])
        column = np.broadcast_to(np.arange(FILTERS), won.shape)
        for j in range(WIDTH):
            cell = laid[STRIDE * won + j] * FILTERS + column
            taps[j] = np.bincount(cell.ravel(), dp.ravel(), (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
        return g | {"taps": taps}, p

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> "Network":
        r, step, m, v = np.random.default_rng(seed), 0, {}, {}
        self.w["base"][:] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), 32):
                rows = order[a : a + 32]
                own = [texts[i] for i in rows]
                laid, begins = lay_out(np.frombuffer(b"".join(own), np.uint8), np.append(0, np.cumsum([len(t) for t in own])))
                g, _ = self.gradient(laid, begins, y[rows])
                step += 1
                rate = 0.01 * (1 - epoch / epochs) + 0.001
                for k, x in g.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * x * x
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network fitted on a bounded sample of the labelled rows outside the held-out fold."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").where(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample).select("text", "quality").collect()
    network = Network()
    if rows:
        network.fit([(r[0] or "").encode() for r in rows], np.array([float(r[1] > 0) for r in rows], np.float32))
    return network


def _probabilities(network: Network, batch) -> np.ndarray:
    data, offsets = text_buffers(batch.column("text"))
    return network.forward(*lay_out(data, offsets))[0]


def score(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    bound_batches(docs.sparkSession)

    def run(it):
        for batch in batches(it, 1 << 20):
            p = _probabilities(network, batch).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def apply(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the network accepts, whole and unchanged."""
    bound_batches(docs.sparkSession)

    def run(it):
        for batch in batches(it, 1 << 20):
            yield batch.filter(pa.array(_probabilities(network, batch) >= threshold))

    return docs.mapInArrow(run, docs.schema)
