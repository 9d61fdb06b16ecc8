"""Lexical retrieval packing: documents that share rare terms fill the same training windows.

Pass 1 tokenises every text once and cuts each document's ids into full windows and one rest; per piece it keeps the
length and the ids' crc32, per document its term counts.  Terms' document frequencies are counted over all documents.
Documents are dealt to shards by content: each has a few min-hashes of its terms, weighted by their rarity, so that the
first of them is equal for two documents as often as their weighted Jaccard similarity says.  Rows are ordered by these
and cut into shards of SHARD rows, so that documents with much in common meet in a shard however many shards there are.
Each shard holds a BM25 inverted index over its documents.  The longest unused rest seeds a window, the index returns its
unused neighbours in order of score, and those that fit go in; what room is left then takes the longest unused rests that
fit.  A neighbour in another shard is not found.

Tokens: a text may be cut at any single space between two visible characters without changing its byte-level BPE, so the
distinct cuttings of a batch are encoded once and their ids put together again.  The vocabulary's special tokens are single
ids where a text holds them, as in `tokenizers` without further settings.

Edge cases: a null or empty text has the id 0 alone; very long texts are read whole; null doc_ids and repeated rows are
packed like others (pieces of equal rows are told apart by their places); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _STATE, batches, materialize, span_hashes, text_buffers

WINDOW, SHARD, BUCKETS = 1024, 2048, 1 << 18
K1, B = 1.2, 0.75
#: Min-hashes that order the documents, shards of a task, and terms whose counts travel in one row.
HASHES, TASK, BLOCK = 3, 4, 4096
#: Special tokens of the vocabulary.
SPECIALS = {b"<|endoftext|>": 50256}
#: Distinct cuttings whose ids a worker keeps.
CACHE = 600_000
_TOKENS = "doc_id long, doc_tokens long, crcs array<long>, terms binary, counts binary, salt long"
_KEYED = _TOKENS + "".join(f", h{j} int" for j in range(HASHES))
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, rank in ranks.items():
            self.sizes[rank] = len(word)
        self.values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        visible = np.zeros(256, bool)
        visible[0x21:0x7F] = True
        self.before, self.after = visible.copy(), visible.copy()
        self.after[0xC3] = True  # the first byte of an accented Latin letter
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def _add(self, keys: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Encode new cuttings: those that start with a space all at once, the rest one by one."""
        size = last - first
        joined = (data[first] == 0x20) & (size > 1)
        joined &= self.after[data[np.minimum(first + 1, len(data) - 1)]] & (self.before[data[last - 1]] | (size > 2) & (data[last - 2] == 0xC3))
        own, n, at = np.flatnonzero(joined), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        ends = np.cumsum(size[own])
        total = int(ends[-1]) if len(own) else 0
        raw = data[np.arange(total) + np.repeat(first[own] - (ends - size[own]), size[own])].tobytes()
        ids = np.array(self.bpe.encode_ordinary(raw.decode()), np.int64)
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1
        if len(own):
            at[own] = np.concatenate([[0], cuts[:-1]])
            n[own] = np.diff(np.concatenate([[0], cuts]))
        more, held = [ids.astype(np.uint16)], len(ids)
        for i in np.flatnonzero(~joined).tolist():
            piece = data[first[i] : last[i]].tobytes()
            special = SPECIALS.get(piece)
            found = np.array(self.bpe.encode_ordinary(piece.decode()) if special is None else [special], np.uint16)
            at[i], n[i] = held, len(found)
            held += len(found)
            more.append(found)
        at += len(self.flat)
        self.flat = np.concatenate([self.flat, *more])
        place = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.n, place, n)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, each text's first id; all cuttings' hashes, each text's first cutting."""
        data, offsets = text_buffers(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            left = self.before[data]
            left[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3)
            cut[1 : n - 1] = (data[1:-1] == 0x20) & left[:-2] & self.after[data[2:]]
        cut[offsets] = True
        raw = data.tobytes()
        for special in SPECIALS:
            # Rare; cut out where it lies within one text.
            at = raw.find(special)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(special) - 1, "right"):
                    cut[[at, at + len(special)]] = True
                at = raw.find(special, at + len(special))
        cut[n] = False
        first = np.flatnonzero(cut[:n])
        last = np.append(first[1:], n)[: len(first)]
        hashes = span_hashes(data, first, last, self.values)
        order = np.argsort(hashes)
        ranked = hashes[order]
        fresh = np.flatnonzero(np.append(len(ranked) > 0, ranked[1:] != ranked[:-1])[: len(ranked)])
        every, where = ranked[fresh], order[fresh]
        inverse = np.empty(len(hashes), np.int64)
        inverse[order] = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(ranked))))
        new = np.ones(len(every), bool)
        if len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, every), len(self.keys) - 1)
            new = self.keys[slot] != every
            if new.any() and len(self.keys) + new.sum() > CACHE:
                self.clear()
                new[:] = True
        if new.any():
            self._add(every[new], data, first[where[new]], last[where[new]])
        slot = np.searchsorted(self.keys, every)
        sizes = self.n[slot][inverse]
        begins = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(self.at[slot][inverse] - begins[:-1], sizes) + np.arange(begins[-1])]
        texts = np.searchsorted(first, offsets)
        return ids, begins[texts], hashes, texts


def tokenise(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_tokens, the crc32 of each piece, and the term counts."""
    path = vocabulary or default_vocabulary()

    def run(it):
        encoder = _STATE.get(("encoder", path)) or _STATE.setdefault(("encoder", path), Encoder(path))
        for batch in batches(it):
            ids, starts, hashes, cuts = encoder.encode(batch.column("text"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            ranked = np.sort(owner * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64))
            fresh = np.flatnonzero(np.append(len(ranked) > 0, ranked[1:] != ranked[:-1])[: len(ranked)])
            count, ranked = np.diff(np.append(fresh, len(ranked))), ranked[fresh]
            ends = np.searchsorted(ranked, np.arange(batch.num_rows + 1) * BUCKETS)
            term, small = (ranked % BUCKETS).astype("<u4"), np.minimum(count, 255).astype("u1")
            totals, crcs, terms, counts = [], [], [], []
            for k in range(batch.num_rows):
                own = np.append(ids[starts[k] : starts[k + 1]], 0).astype("<u4")
                totals.append(len(own))
                crcs.append([zlib.crc32(own[i : i + WINDOW].tobytes()) for i in range(0, len(own), WINDOW)])
                a, b = ends[k], ends[k + 1]
                terms.append(term[a:b].tobytes())
                large = count[a:b][small[a:b] == 255]
                counts.append(small[a:b].tobytes() + large.astype("<u4").tobytes())
            salt = np.random.default_rng(len(ids)).integers(0, 1 << 40, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(terms, pa.binary()), pa.array(counts, pa.binary()), pa.array(salt)],
                ["doc_id", "doc_tokens", "crcs", "terms", "counts", "salt"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _TOKENS)


def counts_of(raw: bytes, n: int) -> np.ndarray:
    """Term counts: one byte each, and four more bytes for each one from 255."""
    out = np.frombuffer(raw, "u1", n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u4", offset=n)
    return out


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Documents that hold each term, over all documents: BUCKETS numbers, whatever the input."""

    def run(it):
        total = np.zeros(BUCKETS, "<i8")
        for batch in it:
            raw = b"".join(x for x in batch.column("terms").to_pylist() if x)
            total += np.bincount(np.frombuffer(raw, "<u4"), minlength=BUCKETS)
        parts = [(a // BLOCK, total[a : a + BLOCK].tobytes()) for a in range(0, BUCKETS, BLOCK) if total[a : a + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["block", "n"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in rows.column("n").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(BUCKETS)
    for block, n in tokens.select("terms").mapInArrow(run, "block int, n binary").groupBy("block").applyInArrow(add, "block int, n binary").collect():
        out[BLOCK * block : BLOCK * (block + 1)] = np.frombuffer(n, "<i8")
    return out


def orders(idf: np.ndarray) -> list[np.ndarray]:
    """For each min-hash the terms' ranks: exponential times whose rates are the weights, so rare terms come early."""
    r = np.random.default_rng(29)
    out = []
    for _ in range(HASHES):
        rank = np.empty(BUCKETS, np.int32)
        rank[np.argsort(r.exponential(1, BUCKETS) / np.maximum(idf, 1e-6))] = np.arange(BUCKETS)
        out.append(rank)
    return out


def keyed(tokens: DataFrame, idf: np.ndarray) -> DataFrame:
    """tokens with the min-hashes of each row's terms in h0, h1, ...; a row without terms has -1."""
    ranks = orders(idf)

    def run(it):
        for batch in it:
            raw = batch.column("terms").to_pylist()
            terms = np.frombuffer(b"".join(raw), "<u4")
            ends = np.cumsum([len(x) // 4 for x in raw])
            some = np.flatnonzero([len(x) > 0 for x in raw])
            keys = []
            for rank in ranks:
                key = np.full(len(raw), -1, np.int32)
                if len(some):
                    key[some] = np.minimum.reduceat(rank[terms], np.append(0, ends)[some])
                keys.append(pa.array(key))
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], [*batch.schema.names, *(f"h{j}" for j in range(HASHES))])

    return tokens.mapInArrow(run, _KEYED)


def fill(sizes: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray) -> list[list[int]]:
    """Windows of the rests, as lists of their numbers."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), [len(t) for t in terms])
    term = np.concatenate(terms) if n else np.zeros(0, np.uint16)
    tf = np.concatenate(counts).astype(np.float32) if n else np.zeros(0, np.float32)
    lengths = np.bincount(owner, tf, n)
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (lengths / max(1e-9, lengths.mean() if n else 1))[owner]))
    # Each term's postings are in order of size, so a seed reads only those that still fit.
    growing = np.argsort(sizes, kind="stable")
    small, ordered = np.empty(n, np.int64), sizes[growing]
    small[growing] = np.arange(n)
    found, term = np.unique(term, return_inverse=True)
    posting = term.astype(np.int64) * (n + 1) + small[owner]
    order = np.argsort(posting)
    posting, docs, weight = posting[order], owner[order], weight[order].astype(np.float32)
    first, own = np.searchsorted(posting, np.arange(len(found)) * (n + 1)), np.split(term, np.cumsum([len(t) for t in terms])[:-1]) if n else []
    by_size = np.argsort(-sizes, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_size] = np.arange(n)
    ascending = -sizes[by_size]
    unused = np.ones(n, bool)
    free = np.arange(n + 1)  # next unused place of by_size, with path halving

    def seek(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return int(i)

    windows = []
    while (top := seek(0)) < n:
        seed = int(by_size[top])
        window, room = [seed], WINDOW - int(sizes[seed])
        unused[seed] = False
        free[top] = top + 1
        if room > 0 and len(terms[seed]):
            t = own[seed]
            low = first[t]
            count = np.searchsorted(posting, t * (n + 1) + np.searchsorted(ordered, room, "right")) - low
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) + np.repeat(low - ends + count, count)
            score = np.bincount(docs[at], weight[at], n) if len(at) else np.zeros(n)
            near = np.flatnonzero((score > 0) & unused)
            near = near[np.lexsort((near, -score[near]))]
            while len(near):
                d = int(near[0])
                window.append(d)
                room -= int(sizes[d])
                unused[d] = False
                free[rank[d]] = rank[d] + 1
                near = near[1:][sizes[near[1:]] <= room]
        while room > 0:
            i = seek(int(np.searchsorted(ascending, -room, "left")))
            if i >= n:
                break
            d = int(by_size[i])
            window.append(d)
            room -= int(sizes[d])
            unused[d] = False
            free[i] = i + 1
        windows.append(window)
    return windows


def place(rows: list[tuple], idf: np.ndarray, first: int) -> tuple[list[tuple], int]:
    """The pieces of one shard's rows (doc_id, doc_tokens, crcs, terms, counts), and the next sequence's number."""
    lengths = np.array([r[1] for r in rows], np.int64)
    rest = np.flatnonzero(lengths % WINDOW)
    terms = [np.frombuffer(rows[i][3], "<u4") for i in rest]
    counts = [counts_of(rows[i][4], len(t)) for i, t in zip(rest, terms, strict=True)]
    windows = fill(lengths[rest] % WINDOW, terms, counts, idf)
    at: dict[int, tuple[int, int]] = {}
    for number, window in enumerate(windows, first):
        offset = 0
        for d in window:
            at[int(rest[d])] = number, offset
            offset += int(lengths[rest[d]] % WINDOW)
    number, out = first + len(windows), []
    for i, (doc, n, crcs, _, _) in enumerate(rows):
        for j, crc in enumerate(crcs):
            size = min(WINDOW, n - j * WINDOW)
            if size == WINDOW:
                sequence, offset = number, 0
                number += 1
            else:
                sequence, offset = at[i]
            out.append((doc, j * WINDOW, size, crc, n, sequence, offset))
    return out, number


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = materialize(tokenise(docs, vocabulary), "tokens")
    df = frequencies(tokens)
    total = tokens.count()
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5)).astype(np.float32)
    names = ["doc_id", "doc_tokens", "crcs", "terms", "counts"]

    def shards(it):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, []

        def pieces(rows):
            nonlocal number
            out, number = place(rows, idf, number)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

        for batch in it:
            held += zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            while len(held) >= SHARD:
                yield pieces(held[:SHARD])
                held = held[SHARD:]
        if held:
            yield pieces(held)

    order = [*(f"h{j}" for j in range(HASHES)), "salt"]
    tasks = max(1, -(-total // (SHARD * TASK)))
    ranged = keyed(tokens, idf).repartitionByRange(tasks, *order).sortWithinPartitions(*order, "doc_id")
    return ranged.select(*names).mapInArrow(shards, _PIECES)
