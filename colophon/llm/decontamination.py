"""Benchmark decontamination by suffix arrays over the training text.

Every Arrow slice of documents becomes one shard: its words are hashed, and its suffix array holds all positions in
lexicographic order of their next words, by prefix doubling up to a window's length.  Every test suffix is binary-searched in
every shard, which gives the range of training suffixes that share at least a window with it; matches are extended to their
longest verbatim length.  One pass, no shuffle: the test suffixes travel to the shards.  A benchmark of more than MAX_CHARS is
cut into parts, each with a pass of its own: `scan` merges the parts' hits of each row, `remove` hands the rows that are left
to the next part.

Edge cases: a null or empty text has no words and no hits; an item without words is never found; an item of fewer than
`window` words is one window; very long texts are a shard of their own; repeated rows and repeated or null doc_ids each
keep a row of their own; an empty table of documents gives an empty result, an empty benchmark no hits; columns of the
input other than doc_id and text are ignored by `scan` and kept by `remove`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, batches, bound_batches, materialize, word_hashes

#: The most characters of test items that one pass sends to the executors, at most four bytes for each (one item that is longer
#: has a pass alone).
MAX_CHARS = 10_000_000
#: Windows whose words are searched for at once.
BLOCK = 100_000
_MATCHES = "array<struct<start:long,item_id:string,item_start:long,length:long>>"
_SCHEMA = f"doc_id long, n_words long, n_hit long, items array<string>, longest long, matches {_MATCHES}"


class TestSuffixes:
    """All windows of the items, in groups of equal length, each with the item that holds it.

    Only the items' word hashes travel to the tasks (eight bytes a word); the windows are places among them, and their words are
    laid out BLOCK windows at a time.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        hashes, starts = word_hashes(pa.array([t or "" for _, t in items], pa.string()), ALNUM_WORDS)
        self.__setstate__((window, [str(i) for i, _ in items], hashes, np.asarray(starts)))

    def __getstate__(self):
        return self.window, self.names, self.tokens, self.starts

    def __setstate__(self, state):
        self.window, self.names, self.tokens, self.starts = state
        self.begins, self.ends = self.starts[:-1], self.starts[1:]
        own = np.repeat(np.arange(len(self.names), dtype=np.int32), self.ends - self.begins)
        sizes = np.minimum(self.window, self.ends - self.begins)
        whole = np.flatnonzero(np.arange(len(own)) + sizes[own] <= self.ends[own])
        size_of = sizes[own[whole]]
        self.groups = [(int(size), whole[size_of == size]) for size in np.unique(size_of)]
        self.item_of = own

    def blocks(self):
        """(size, item, place, words) of all windows."""
        for size, places in self.groups:
            for k in range(0, len(places), BLOCK):
                at = places[k : k + BLOCK]
                yield size, self.item_of[at], at, self.tokens[at[:, None] + np.arange(size)]


def suffix_array(h: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """All positions, in order of their next words, at least `depth` of them; a text's end comes before any word.

    ends: where the text of each position ends.
    """
    n, k = len(h), 1
    order = np.argsort(h)
    rank = _ranks(h[order], order)
    while k < depth:
        here = np.arange(k, n + k)
        second = np.where(here < ends, rank[np.minimum(here, n - 1)], 0)
        key = rank * (n + 1) + second
        order = np.argsort(key)
        rank = _ranks(key[order], order)
        k *= 2
    return order


def _ranks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank from 1 of each place, from sorted values and the places in that order; equal values share one."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(True, values[1:] != values[:-1])) if len(order) else 0
    return out


def ranges(h: np.ndarray, ends: np.ndarray, array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the suffix array has suffixes that begin with each row of keys: a binary search of them all at once."""
    n, first = len(array), h[array]
    low, high = np.searchsorted(first, keys[:, 0], "left"), np.searchsorted(first, keys[:, 0], "right")

    def bound(some: np.ndarray, j: int, after: bool) -> np.ndarray:
        a, b, want = low[some], high[some], keys[some, j]
        while len(live := np.flatnonzero(a < b)):
            mid = (a[live] + b[live]) >> 1
            at = array[mid] + j
            word = h[np.minimum(at, n - 1)]
            less = (at >= ends[array[mid]]) | (word < want[live]) | (after & (word == want[live]))
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
        return a

    for j in range(1, keys.shape[1]):
        # Within a range all suffixes begin alike, so they are in order of their next word.
        some = np.flatnonzero(low < high)
        if not len(some):
            break
        low[some], high[some] = bound(some, j, False), bound(some, j, True)
    return low, high


def search(h: np.ndarray, starts: np.ndarray, suffixes: TestSuffixes, places_too: bool = False):
    """Hit words, items and the longest match of each document of a shard; (document, word, item, item's word, length) of its matches.

    A match is as long as it can be, to the right and to the left; matches are left out unless places_too.
    """
    n_docs = len(starts) - 1
    hit = np.zeros(len(h) + 1, np.int64)
    matches = []
    items: list[set] = [set() for _ in range(n_docs)]
    longest = np.zeros(n_docs, np.int64)
    if not len(h):
        return np.zeros(n_docs, np.int64), items, longest, matches
    doc_of = np.repeat(np.arange(n_docs), np.diff(starts))
    ends = starts[1:][doc_of]
    room = ends - np.arange(len(h))
    array = suffix_array(h, ends, max((g[0] for g in suffixes.groups), default=1))
    for size, item, at, keys in suffixes.blocks():
        low, high = ranges(h, ends, array, keys)
        for i in np.flatnonzero(high > low):
            places = array[low[i] : high[i]]
            np.add.at(hit, places, 1)
            np.add.at(hit, places + size, -1)
            docs = np.unique(doc_of[places])
            for d in docs:
                items[d].add(int(item[i]))
            most = np.full(len(places), size)
            live = np.arange(len(places))
            limit = int(suffixes.ends[item[i]] - at[i])
            for j in range(size, limit):
                live = live[room[places[live]] > j]
                live = live[h[places[live] + j] == suffixes.tokens[at[i] + j]]
                if not len(live):
                    break
                most[live] = j + 1
            np.maximum.at(longest, doc_of[places], most)
            if places_too:
                own, first = int(item[i]), int(at[i] - suffixes.begins[item[i]])
                # A match that could begin a word earlier is part of that one.
                late = np.zeros(len(places), bool)
                if first and size == suffixes.window:
                    before = np.maximum(places - 1, 0)
                    late = (places > starts[:-1][doc_of[places]]) & (h[before] == suffixes.tokens[at[i] - 1])
                matches.extend((int(doc_of[p]), int(p - starts[doc_of[p]]), own, first, int(n)) for p, n in zip(places[~late], most[~late], strict=True))
    covered = np.cumsum(hit[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[starts[1:]] - total[starts[:-1]], items, longest, matches


def _parts(benchmark: DataFrame, window: int):
    """The test suffixes, in parts of items with at most MAX_CHARS together: one part is what every task holds."""
    items, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len(r[1] or "")
        if items and size + n > MAX_CHARS:
            yield TestSuffixes(items, window)
            items, size = [], 0
        items.append((r[0], r[1]))
        size += n
    yield TestSuffixes(items, window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), longest (words of the longest verbatim match), matches per row of docs.

    matches: start (word of the document), item_id, item_start (word of the item), length (words), sorted.
    """

    def part(suffixes: TestSuffixes):
        def shard(it):
            for batch in batches(it):
                h, starts = word_hashes(batch.column("text"), ALNUM_WORDS)
                n_hit, found, longest, places = search(h, starts, suffixes, places_too=True)
                names = [sorted({suffixes.names[k] for k in x}) for x in found]
                own: list[list] = [[] for _ in names]
                for d, start, item, first, n in places:
                    own[d].append({"start": start, "item_id": suffixes.names[item], "item_start": first, "length": n})
                own = [sorted(x, key=lambda m: (m["start"], m["item_id"], m["item_start"])) for x in own]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts)), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int64()), pa.array(own, kind)],
                    ["doc_id", "n_words", "n_hit", "items", "longest", "matches"],
                )

        return shard

    bound_batches(docs.sparkSession)
    docs, parts = docs.select("doc_id", "text"), _parts(benchmark, window)
    first, second = next(parts), next(parts, None)
    if second is None:
        return docs.mapInArrow(part(first), _SCHEMA)
    # Each part's pass ends before the next part is made; a row has the same number in all of them.
    docs, found = materialize(docs, "docs"), []
    while first:
        hits = docs.mapInArrow(part(first), _SCHEMA).withColumn("_row", F.monotonically_increasing_id())
        found.append(materialize(hits if not found else hits.where("n_hit > 0"), "hits"))
        first, second = second, next(parts, None)
    rows = found[0].select("_row", "doc_id", "n_words")
    both = reduce(DataFrame.union, [x.where("n_hit > 0").select("_row", "matches") for x in found])
    # A row's matches cover its hit words, and no others.
    both = both.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    rows = rows.join(both, "_row", "left").withColumn("matches", F.coalesce("matches", F.array().cast(_MATCHES)))
    step = lambda x, m: F.struct((x["n"] + F.greatest(m["start"] + m["length"] - F.greatest(m["start"], x["end"]), F.lit(0))).alias("n"), F.greatest(x["end"], m["start"] + m["length"]).alias("end"))
    zero = F.lit(0).cast("long")
    n_hit = F.aggregate("matches", F.struct(zero.alias("n"), zero.alias("end")), step, lambda x: x["n"])
    names, longest = F.transform("matches", lambda m: m["item_id"]), F.array_max(F.transform("matches", lambda m: m["length"]))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct(names)).alias("items"), F.coalesce(longest, zero).alias("longest"), "matches")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns; with the longest match, the number of matches, and where the longest stands (the first of equals)."""
    best = F.get(F.filter("matches", lambda m: m["length"] == F.col("longest")), F.lit(0))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "longest", F.size("matches").cast("long").alias("n_matches"), best["start"].alias("longest_start"), best["item_id"].alias("longest_item"), best["item_start"].alias("longest_item_start"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; the flag is made in the same pass as the rows."""

    def part(suffixes: TestSuffixes):
        def keep(it):
            for batch in batches(it):
                h, starts = word_hashes(batch.column("text"), ALNUM_WORDS)
                bad = search(h, starts, suffixes)[0] > 0
                yield batch.filter(pa.array(~bad))

        return keep

    bound_batches(docs.sparkSession)
    schema, parts = docs.schema, _parts(benchmark, window)
    suffixes, more = next(parts), next(parts, None)
    while suffixes:
        docs = docs.mapInArrow(part(suffixes), schema)
        if more:
            docs = materialize(docs, "left")
        suffixes, more = more, next(parts, None)
    return docs
