"""License scans by diagonal voting, in DataFrame expressions.

Each position of a text gives its two-word gram; the grams' hashes join the positions of the templates' grams (a table
fixed in this module, so its broadcast has a fixed size), and the join compares the words themselves, with up to two
words more for long templates.  A hit votes for the diagonal `position - template position`.  Diagonals of a template
that lie close together are one occurrence with small insertions or losses; their votes are merged.  The merged span is
verified: each of the template's grams counts once, however often it occurs, SHARE of them must be there, and the span must
not be longer than the template by more than half of its words.  Passages of at most SHORT grams need all of them, phrases
need every gram on one diagonal.  The templates are the openings of licences, which a notice cites, and the paragraphs of
their bodies, by which a licence without its opening is found.

Edge cases: a null or empty text has no words, no places and score 0; texts are read whole; every input row gives a row,
also repeated ones and those with a null doc_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Places of these phrases are the base result.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of public licences, and the labels that they give.
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "licensed under the apache license version 2 0": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license version": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc",
    "licensed under cc by": "cc",
    "released under the mit license": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "has waived all copyright and related or neighboring rights to this work": "cc0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "licensed under the european union public licence": "eupl",
    "this font software is licensed under the sil open font license": "ofl",
    "this package is free software you may copy and distribute it under the terms of the artistic license": "artistic",
    # Paragraphs of whole licences.
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required": "zlib",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that a passage's gram compares, the neighbouring diagonals that merge, and the share of grams that makes an occurrence.
GRAM, SLACK, SHARE = 4, 3, 0.5
#: Passages of so few grams hold only with all of them: a few words alike are no licence.
SHORT = 8


def templates() -> list[tuple]:
    rows = []
    for k, (text, label, phrase) in enumerate([*((t, v, True) for t, v in PHRASES.items()), *((t, v, False) for t, v in PASSAGES.items())]):
        words, n = text.split(), 2 if phrase else GRAM
        for i in range(len(words) - n + 1):
            gram = [*words[i : i + n], None, None][:4]
            rows.append((k, label, phrase, i, len(words) - n + 1, *gram))
    return rows


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = [(-1, None, True, 0, 1, "", "", None, None), *templates()]
    grams = spark.createDataFrame(rows, "template int, label string, phrase boolean, tpos int, n_grams int, t1 string, t2 string, t3 string, t4 string")
    grams = grams.withColumn("gram", F.xxhash64("t1", "t2"))
    text = F.coalesce("text", F.lit(""))
    # Only A-Z become lower case; lower() does that faster where there are no other letters.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    words = F.filter(F.split(low, SEPARATORS), lambda w: w != "")
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words")).withColumn("n_words", F.size("words"))
    # The first element stands for the row itself and always joins, so that rows without hits stay.
    end, none = F.greatest(F.size("words"), F.lit(1)), F.array(F.lit(""))
    shifted = [F.concat(none, F.slice("words", j, end)).alias(f"w{j}") for j in (1, 2, 3, 4)]
    at = base.select("row", "doc_id", "n_words", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    at = at.select("row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), *[F.col(f"w.w{j}").alias(f"w{j}") for j in (1, 2, 3, 4)])
    same = (F.xxhash64("w1", "w2") == F.col("gram")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    for j in (3, 4):
        same = same & (F.col(f"t{j}").isNull() | (F.col(f"w{j}") == F.col(f"t{j}")))
    hits = at.join(F.broadcast(grams), same).select("row", "doc_id", "n_words", "template", "label", "phrase", "n_grams", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    keys = ["row", "doc_id", "n_words", "template", "label", "phrase", "n_grams"]
    votes = hits.repartition("row").groupBy(*keys, "diagonal").agg(F.collect_set("tpos").alias("grams"), F.min("tpos").alias("first"), F.max("tpos").alias("last"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.when(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK), 1).otherwise(0)
    merged = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order))
    spans = merged.groupBy(*keys, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("grams")))).alias("votes"), F.min("diagonal").alias("start"),
        (F.max(F.col("diagonal") + F.col("last")) - F.min(F.col("diagonal") + F.col("first")) + 1).alias("length"),
    )
    fits = 2 * F.col("length") <= 3 * (F.col("n_grams") + GRAM - 1)
    spans = spans.withColumn("share", F.when(fits, F.col("votes") / F.col("n_grams")).otherwise(0.0)).withColumn("place", F.col("phrase") & (F.col("template") >= 0) & (F.col("votes") == F.col("n_grams")))
    needed = F.when(F.col("n_grams") <= SHORT, F.lit(1.0)).otherwise(SHARE)
    real, holds = F.col("template") >= 0, F.col("place") | (~F.col("phrase") & (F.col("share") >= needed))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    start = F.when(F.col("place"), F.col("start"))
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if("place").alias("n_base"), F.min(start).cast("long").alias("first_word"), F.max(start).cast("long").alias("last_word"),
        names(F.col("place")).alias("base_labels"), names(real & holds).alias("labels"),
        F.coalesce(F.max(F.when(real & holds, F.col("share"))), F.lit(0.0)).alias("score"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
