"""URL filters by a Bloom filter cascade, in DataFrame expressions.

A rule is a host and a path prefix, and fits the host and its subdomains.  A url's candidate keys are its host suffixes
times its path prefixes of the lengths that rules have.  Level 1 of a cascade encodes the listed keys; level 2 encodes
those keys of the corpus's universe that level 1 passes wrongly; level 3 encodes the listed keys that level 2 passes,
and so on until no level passes wrongly.  Over that universe membership is exact, and asking needs no join: each level's
bits reach the expression as a scalar.  Level 1 has bits in proportion to the listed keys and to the logarithm of the
universe over them, so the false positives, and with them all other levels, keep the size of the list.

Edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and gets the default verdict;
repeated rows keep their rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

HASHES = 6
#: The rules that the query applies, and hosts that it blocks besides.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
SPAM_HOSTS = ["casino-win.example.com", "casino-win.example.net", "casino-win.example.org", "free-pills.example.com", "free-pills.example.net", "free-pills.example.org"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that may be listed, longest first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.flatten(F.transform(suffixes, lambda s: F.array(*[F.when(F.length(path) >= n, F.concat(s, F.substring(path, 1, n))) for n in lengths])))
    keys = F.filter(keys, lambda k: k.isNotNull() & ~k.startswith("/") & (k != ""))
    return F.array_sort(F.array_distinct(keys), lambda a, b: F.length(b) - F.length(a))


def _bit(key: Column, level: int, j: int, n_bits: int) -> Column:
    """Double hashing: the j-th of a key's bits."""
    first, step = (F.xxhash64(F.lit(2 * level + i), key).bitwiseAND((1 << 40) - 1) for i in (0, 1))
    return F.pmod(first + F.lit(j) * step, F.lit(n_bits))



class Cascade:
    """Exact membership of a universe's keys in a list, as an expression."""

    def __init__(self, universe: DataFrame, listed: list[str]):
        """universe: one column `key` without repeats; listed: the listed keys, whose number is the caller's bound."""
        spark = universe.sparkSession
        inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
        outside = universe.join(F.broadcast(inside), "key", "left_anti")
        n = n_in = len(set(listed))
        n_all = n_in + universe.count()
        self.levels: list[tuple[Column, int]] = []
        per_key = 1.44 * max(HASHES, math.log2(max(2.0, n_all / max(1, n_in))))
        while n:
            n_bits = 64 * max(1, math.ceil(n * per_key / 64))
            self.levels.append((self._encode(inside, len(self.levels), n_bits), n_bits))
            inside, outside = outside.where(self._passes(F.col("key"), len(self.levels) - 1)), inside
            n = inside.count()
            per_key = 1.44 * HASHES

    @staticmethod
    def _encode(keys: DataFrame, level: int, n_bits: int) -> Column:
        bits = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, j, n_bits) for j in range(HASHES)])).alias("bit"))
        words = bits.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
        every = keys.sparkSession.range(n_bits // 64).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
        packed = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")))).alias("words"))
        return packed.select(F.col("words.mask")).first()[0]

    def _passes(self, key: Column, level: int) -> Column:
        words, n_bits = self.levels[level]
        table, out = F.lit(words), F.lit(True)
        for j in range(HASHES):
            bit = _bit(key, level, j, n_bits)
            out = out & (F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", F.get(table, F.floor(bit / 64).cast("int")), (bit % 64).cast("int"))) == 1)
        return out

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self._passes(key, level), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, blocked_hosts: list[str] | None = None) -> DataFrame:
    """page_id, host, path, rule (of `rules`), verdict.  Without a rule, pages of blocked hosts are blocked."""
    rules = RULES if rules is None else rules
    blocked_hosts = SPAM_HOSTS if blocked_hosts is None else blocked_hosts
    lengths = sorted({len(r) - r.index("/") for r, _ in rules}, reverse=True)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    hosts = F.transform(F.filter(candidates(F.col("host"), F.lit(""), [0]), lambda k: k != ""), lambda k: F.concat(F.lit("*."), k))
    urls = urls.withColumn("hosts", hosts)
    # One universe for all cascades, gathered once.
    universe = materialize(urls.select(F.explode(F.concat("keys", "hosts")).alias("key")).distinct(), "universe")
    verdicts = {}
    for verdict in ("allow", "block"):
        verdicts[verdict] = Cascade(universe, [r for r, v in rules if v == verdict])
    spam = Cascade(universe, [f"*.{h}" for h in blocked_hosts])
    allow, block = verdicts["allow"].contains, verdicts["block"].contains
    found = urls.withColumn("rule", F.get(F.filter("keys", lambda k: allow(k) | block(k)), F.lit(0)))
    default = F.when(F.exists("hosts", lambda k: spam.contains(k)), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNull(), default).when(allow(F.col("rule")), "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
