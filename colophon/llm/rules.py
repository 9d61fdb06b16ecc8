"""Quality rules, line first, in DataFrame expressions.

Each line is judged on its own; a line fails if it is navigation (many bars for its words), heaped punctuation or
shouting, symbols, a boilerplate phrase, a short line that ends without punctuation, or one word said over and over.
Failing lines are taken out; a document that loses too much of its text, or that fails the base rules over the whole
text, is rejected.  Everything is computed within the row: no shuffle.  Counts over the whole text tell first which rules
can fail a line at all, so that most lines are read once.

Words repeated in windows: the 64-bit hashes of a text's word windows are sorted with their positions in the low bits, so
equal windows are neighbours; a position counts once for all repeated windows over it.  Texts without a repeated window,
which a hash set tells, are not sorted.

Edge cases: a null or empty text has no words, fails the base rules and is rejected; very long texts are read whole;
repeated rows and null doc_ids keep their rows; an empty table gives an empty result; extra columns are ignored by
`evaluate` and kept by `apply`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Share of the text's letters that its clean lines must hold.
MIN_KEPT = 0.5
#: Characters of navigation and of shouting, symbols that are no part of a sentence, and those that end one.
BARS, SHOUTS, MARKS, ENDS = "|>»", "!?", "#*$%&|<>", ".!?…。:;,\"'»”’)]"
#: Least numbers in a line that fails, and the words for each: more than one for so many words fails.
MIN_BARS, MIN_SHOUTS, MIN_MARKS, BARS_IN, SHOUTS_IN, MARKS_IN = 2, 4, 6, 4, 3, 2
#: Words under which a line must end with punctuation.
MIN_SENTENCE = 12
#: Phrases of page furniture; a line of fewer characters with one fails.
BOILERPLATE = ["all rights reserved", "cookie policy", "privacy policy", "terms of service", "click here", "sign in", "subscribe now", "javascript is disabled", "share this"]
SHORT = 200
#: A line of this many words or more of which one makes up half or more says it over and over.
MIN_SAID = 6


def number(text: Column, chars: str) -> Column:
    """How many of these characters a text has."""
    left = reduce(lambda x, c: F.replace(x, F.lit(c)), chars, text)
    return F.length(text) - F.length(left)


def letters(text: Column) -> Column:
    return F.length(text) - number(text, BLANK)


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def let(value: Column, then) -> Column:
    """then(value), with the value computed once: expressions in lambdas are not shared."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def says_over(line: Column) -> Column:
    """Whether one word is said over and over: it makes up half of a line of MIN_SAID words or more."""

    def judge(words: Column) -> Column:
        ranked, n = F.array_sort(words), F.size(words)
        # Equal words are neighbours: one that makes up half of the line is also half a line further on.
        apart = F.zip_with(ranked, F.slice(ranked, F.floor((n + 1) / 2).cast("int"), F.greatest(n, F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
        # With one word half of the time, there are few different ones; only such lines are sorted.
        return F.when(n < MIN_SAID, False).when(2 * F.size(F.array_distinct(words)) <= n + 2, F.exists(apart, lambda x: x)).otherwise(False)

    return F.when(F.length(line) < 2 * MIN_SAID - 1, False).otherwise(let(words_of(F.lower(line)), judge))


def boilerplate(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda x, p: x | low.contains(p), BOILERPLATE[1:], low.contains(BOILERPLATE[0]))


def line_fails(line: Column, bars: Column, shouts: Column, marks: Column, phrases: Column) -> Column:
    """Whether a line with words fails a rule; the other arguments tell whether its text has enough of each at all."""
    spaces = number(line, " ")
    over = lambda some, chars, least, words: some & (number(line, chars) >= least) & (number(line, chars) * words > spaces)
    ended = F.instr(F.lit(ENDS), F.right(F.btrim(line, F.lit(BLANK)), F.lit(1))) > 0
    return (
        over(bars, BARS, MIN_BARS, BARS_IN) | over(shouts, SHOUTS, MIN_SHOUTS, SHOUTS_IN) | over(marks, MARKS, MIN_MARKS, MARKS_IN)
        | (phrases & (F.length(line) < SHORT) & boilerplate(line)) | ((spaces < MIN_SENTENCE - 1) & ~ended) | says_over(line)
    )


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep, each in `_in` under its name, and the counts."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_in"), text.alias("_text"))
    lines = F.split("_text", "\n", -1)
    df = df.select(
        "_in", "_text", words_of(F.col("_text")).alias("_words"), F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).alias("n_symbols"), (number(F.col("_text"), BARS) >= MIN_BARS).alias("_bars"),
        (number(F.col("_text"), SHOUTS) >= MIN_SHOUTS).alias("_shouts"), boilerplate(F.col("_text")).alias("_phrases"),
    )
    goes = lambda x: line_fails(x, F.col("_bars"), F.col("_shouts"), F.col("n_symbols") >= MIN_MARKS, F.col("_phrases"))
    n = F.size("_words")
    # Windows that would run over the end are cut off.
    windows = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.select(
        "_in", "_text", F.length(F.array_join("_words", "")).alias("word_chars"), "n_symbols", n.alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.filter("_lines", goes).alias("_failed"), F.slice(windows, 1, F.greatest(n - 2, F.lit(0))).alias("_w"),
    )
    # High bits of the hash, low bits the position: a primitive sort brings equal windows together.
    bits = F.length(F.bin(F.col("n_words").cast("long")))
    again = F.size(F.array_distinct("_w")) < F.size("_w")
    packed = F.transform("_w", lambda w, i: F.call_function("shiftleft", F.call_function("shiftright", w, F.col("_bits")), F.col("_bits")).bitwiseOR(i.cast("long")))
    df = df.select("_in", "_text", "word_chars", "n_symbols", "n_words", "n_dup_lines", "_failed", bits.alias("_bits"), F.when(again, F.col("_w")).otherwise(F.array().cast("array<bigint>")).alias("_w"))
    df = df.withColumn("_s", F.sort_array(packed)).drop("_w")
    place = lambda x: F.pmod(x, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits"))).cast("int")
    same = lambda a, b: F.call_function("shiftright", a.bitwiseXOR(b), F.col("_bits")) == 0
    pairs = F.filter(F.zip_with("_s", F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), lambda a, b: F.when(same(a, b), F.array(place(a), place(b)))), lambda x: x.isNotNull())
    df = df.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(pairs)))).drop("_s")
    steps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda p, q: F.least(F.coalesce(q - p, F.lit(3)), F.lit(3)))
    lost = F.aggregate("_failed", F.lit(0), lambda a, x: a + letters(x))
    return df.select("_in", "_text", "word_chars", "n_symbols", "n_words", "n_dup_lines", F.aggregate(steps, F.lit(0), lambda a, x: a + x).alias("n_repeat_words"), "_failed", lost.alias("_lost"))


def verdicts(measured: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words").cast("long") > MAX_REPEATED_PERCENT * F.col("n_words").cast("long"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("word_chars") - F.col("_lost") >= MIN_KEPT * F.col("word_chars")))


def evaluate(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and n_failed_lines."""
    out = verdicts(measure(docs, "doc_id"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("_in.doc_id", *[F.col(c).cast("long").alias(c) for c in counts], "base_failed", "kept", F.size("_failed").cast("long").alias("n_failed_lines"))


def apply(docs: DataFrame) -> DataFrame:
    """The documents that `evaluate` keeps, without their failing lines; lines without words stay.

    n_chars, where there is one, counts what is left.  The row number is a fence: without it the optimizer moves the
    filter down and expands every expression in it.
    """
    judged = verdicts(measure(docs, *docs.columns)).withColumn("_row", F.monotonically_increasing_id())
    kept = judged.where("kept and _row >= 0")
    left = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x: ~F.array_contains("_failed", x)), "\n")
    text = F.when(F.size("_failed") == 0, F.col("_text")).otherwise(left)
    kept = kept.select("_in", text.alias("_clean"))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_clean").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new.get(c, F.col("_in")[c]).alias(c) for c in docs.columns])
