"""The thin queries over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from itertools import permutations

from . import ann, classifier, decontamination, filter_audit, html, infill, jaccard, licenses, likelihood, packing, rules, sharding, urls
from .common import read_table as _t


def op1_license_scan(spark, sf_dir):
    return licenses.scan(_t(spark, sf_dir, "documents"))


def op2_feistel_sharding(spark, sf_dir):
    return sharding.assign(_t(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, _t(spark, sf_dir, "labels")))


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.classes(_t(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return urls.judge(_t(spark, sf_dir, "pages"))


def op6_quality_rules(spark, sf_dir):
    return rules.evaluate(_t(spark, sf_dir, "documents"))


def op7_html_consensus(spark, sf_dir):
    return html.extract(_t(spark, sf_dir, "pages"))


def op8_decontamination(spark, sf_dir):
    return decontamination.digest(decontamination.scan(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")))


def op9_pseudo_likelihood(spark, sf_dir):
    return likelihood.score(_t(spark, sf_dir, "documents"))


def op10_retrieval_packing(spark, sf_dir):
    return packing.pack(_t(spark, sf_dir, "documents"))


def op11_multi_index_hashing(spark, sf_dir):
    return ann.search(_t(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark, sf_dir):
    return infill.digest(infill.transform(_t(spark, sf_dir, "documents")))


QUERIES = {k: v for k, v in globals().items() if k.startswith("op")}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
_RULES = ", ".join(f"('{r}', '{v}')" for r, v in urls.RULES)
_SPAM = " OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in urls.SPAM_HOSTS)
_less = lambda chars: f"(length(x) - length(translate(x, '{chars.replace(chr(39), chr(39) * 2)}', '')))"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FURNITURE = " OR ".join(f"contains(lower(x), '{p}')" for p in rules.BOILERPLATE)
_ENDS = rules.ENDS.replace("'", "''")


def _over(chars: str, least: int, words: int) -> str:
    return f"({_less(chars)} >= {least} AND {_less(chars)} * {words} > {_less(' ')})"


#: Whether line x fails, and the words of it that are said most often.
_FAILS = f"""{_over(rules.BARS, rules.MIN_BARS, rules.BARS_IN)} OR {_over(rules.SHOUTS, rules.MIN_SHOUTS, rules.SHOUTS_IN)} OR {_over(rules.MARKS, rules.MIN_MARKS, rules.MARKS_IN)}
  OR (length(x) < {rules.SHORT} AND ({_FURNITURE})) OR ({_less(' ')} < {rules.MIN_SENTENCE - 1} AND NOT contains('{_ENDS}', right(trim(x, {_BLANK}), 1)))
  OR (len(lw) >= {rules.MIN_SAID} AND 2 * list_max(map_values(list_histogram(lw))) >= len(lw))"""

ORACLES: dict[str, str] = {
    "op5_url_filter": rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT rule, v, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM (VALUES {_RULES}) t(rule, v)),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(v, CASE WHEN {_SPAM} THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id""",
    "op6_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g) WHERE times > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d),
f AS (SELECT doc_id, x, regexp_extract_all(lower(x), '{_SPACED}') AS lw FROM l WHERE regexp_matches(x, '{_SPACED}')),
j AS (SELECT doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS n, {_FAILS} AS fails FROM f),
k AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost, count(*) FILTER (fails) AS n_failed_lines FROM j GROUP BY doc_id),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost, CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - lost >= {rules.MIN_KEPT} * word_chars AS kept, n_failed_lines FROM o""",
    "op8_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM benchmark)),
v AS (SELECT item_id, i AS j, k, w[i:i+k-1] AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b WHERE k > 0)),
s AS (SELECT DISTINCT k FROM v),
p AS (SELECT doc_id, i, k, w[i:i+k-1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, s)),
h AS (SELECT doc_id, i, j, p.k, CAST(item_id AS VARCHAR) AS item FROM p JOIN v ON p.k = v.k AND p.g = v.g),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, item, min(i) - 1 AS s, min(j) - 1 AS js, count(*) + k - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS run FROM h) GROUP BY doc_id, item, k, i - j, run),
x AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_matches FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s, item, js) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(x.n, 0) AS BIGINT) AS longest, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, CAST(s AS BIGINT) AS longest_start, x.item AS longest_item, CAST(js AS BIGINT) AS longest_item_start
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)""",
    "op12_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_SPACED}') AS w, min(doc_id) OVER (PARTITION BY text) AS earliest FROM d),
f AS (SELECT doc_id, part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS C,
  regexp_matches(text, '[#$%&*|]') AS D, earliest < doc_id AS E FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [A, B, C, D, coalesce(E, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
o AS (SELECT [{", ".join(f"['{''.join(p)}']" for p in permutations("ABCDE"))}] AS o),
p AS (SELECT x[1] AS filter_order FROM (SELECT unnest(o) AS x FROM o)),
s AS (SELECT part, filter_order, n, good, toxic, list_transform([1, 2, 3, 4, 5], lambda i: fails[ascii(filter_order[i]) - 64]) AS q, len(list_filter(fails, lambda x: x)) AS n_fails FROM c, p),
r AS (SELECT *, coalesce(list_position(q, true), 6) AS hit, unnest([1, 2, 3, 4, 5]) AS step FROM s),
g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, CAST(coalesce(sum(n) FILTER (hit > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit = step), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (q[step] AND hit < step), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (q[step] AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (hit = step AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (hit = step AND toxic), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g""",
    "op13_fill_in_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
n AS (SELECT *, len(t) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(x, i, 8) AS BIGINT)) AS h FROM h),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(t[1:i], '') AS prefix, array_to_string(t[i+1:j], '') AS middle, array_to_string(t[j+1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
