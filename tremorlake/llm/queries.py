"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fingerprints, langid, mixing, ngram_join, packing, quality_fm, quality_rules, secrets, substring_dedup, url_filter


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs, mixing.cycle_1_2_3())
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality_fm.train(docs, common.table(spark, sf_dir, "labels"), ~held_out)
    return quality_fm.score(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(k))).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.concat("base", "linked")).alias("spans"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, ends=True, lone=substring_dedup.LONE_WORDS).select("doc_id", "n_sentences", "n_removed", "removed", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.remainder() == 2, F.lit(False))
    languages, network = langid.train(docs, ~held_out)
    labelled = langid.predict(docs, languages, network, ["doc_id"])
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = (op1_mixing, op2_fingerprints, op3_packing, op4_quality_rules, op5_quality_classifier, op6_ngram_join, op7_secret_scan, op8_url_filter, op9_substring_dedup, op10_language_id)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = f"translate(text, '{common.UPPER}', '{common.LOWER}')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s),
w AS (SELECT *, (rank % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM r),
l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS remaining, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left
  FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * weight_left > weight * remaining AS part FROM l),
t AS (
  SELECT *, first_value(CASE WHEN part THEN remaining END IGNORE NULLS) OVER b AS level, first_value(CASE WHEN part THEN weight_left END IGNORE NULLS) OVER b AS level_weight
  FROM f WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE (weight * level)::DOUBLE / level_weight::DOUBLE END AS target FROM t),
h AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + (('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate))::INT) * size)::BIGINT AS taken
FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source
"""

OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM documents),
win AS (SELECT row, i, array_to_string(words[i:i + 7], ' ') AS gram FROM d, unnest(range(1, len(words) - 6)) AS t(i)),
rep AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS k FROM win) WHERE k > 1),
cov AS (SELECT row, count(DISTINCT i + j)::BIGINT AS n FROM rep, range(8) AS t(j) GROUP BY row),
m AS (
  SELECT d.row, doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (row)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (
  SELECT source, 1 AS rule, base_failed AS bad FROM b UNION ALL SELECT source, 2, 10 * n_symbols > word_chars FROM b
  UNION ALL SELECT source, 3, 10 * n_dup_lines > 5 * n_lines FROM b UNION ALL SELECT source, 4, word_chars > 15 * n_words OR word_chars < 2 * n_words FROM b),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (WHERE bad)::DOUBLE AS k FROM f GROUP BY source, rule),
p AS (SELECT rule, count(*) AS j, sum(n) AS n, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) AS square FROM h GROUP BY rule),
q AS (SELECT *, mean * (1 - mean) AS noise, square - mean * mean - j * mean * (1 - mean) / n AS between_hosts FROM p),
s AS (SELECT rule, mean, CASE WHEN between_hosts > 0 THEN least(greatest(noise / between_hosts - 1, 2), 200) ELSE 200 END AS strength FROM q),
v AS (SELECT source, rule, mean, (k + strength * mean) / (n + strength) AS rate, n + strength AS total FROM h JOIN s USING (rule)),
y AS (
  SELECT source, rule, rate - {quality_rules.Z} * sqrt(rate * (1 - rate) / (total + 1)) > {quality_rules.REJECT_ODDS} * mean / (1 - mean + {quality_rules.REJECT_ODDS} * mean) AS rejected,
    rate + {quality_rules.Z} * sqrt(rate * (1 - rate) / (total + 1)) < {quality_rules.TRUST_ODDS} * mean / (1 - mean + {quality_rules.TRUST_ODDS} * mean) AS trusted FROM v),
x AS (SELECT source, bool_or(rejected) AS rejected, bool_or(trusted AND rule = 2) AS t2, bool_or(trusted AND rule = 3) AS t3, bool_or(trusted AND rule = 4) AS t4 FROM y GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AND NOT (10 * n_symbols > word_chars AND NOT t2)
  AND NOT (10 * n_dup_lines > 5 * n_lines AND NOT t3) AND NOT ((word_chars > 15 * n_words OR word_chars < 2 * n_words) AND NOT t4) AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""

OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS.replace("coalesce(text, '')", f"coalesce({_LOWER}, '')")} AS words FROM documents),
s AS (
  SELECT DISTINCT row, array_to_string(words[i:i + 4], ' ') AS shingle FROM d, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0),
n AS (SELECT row, count(*)::BIGINT AS n FROM s GROUP BY row),
o AS (SELECT a.row AS x, b.row AS y, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.row < b.row GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.row = x JOIN n q ON q.row = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT row AS x, row AS y FROM d UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM r JOIN d ON d.row = r.x JOIN d o ON o.row = r.y LEFT JOIN n ON n.row = r.x GROUP BY d.row, d.doc_id
"""

OP8_SQL = rf"""
WITH t AS (SELECT *, regexp_replace(html, '{url_filter.HIDDEN}', ' ', 'g') AS shown FROM pages),
u AS (SELECT page_id, shown, list_filter(regexp_split_to_array(shown, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS shown_words, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM t),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{common.UPPER}', '{common.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    len(shown_words) < 20 OR 10 * (length(shown) - length(regexp_replace(shown, '[#*$%&|<>]', '', 'g'))) > length(array_to_string(shown_words, '')) OR 5 * len(list_distinct(shown_words)) < len(shown_words) AS bad FROM u),
l AS (SELECT *, string_split(host, '.') AS labels FROM p),
x AS (
  SELECT *, CASE WHEN len(labels) >= 3 AND length(labels[-1]) = 2 AND labels[-2] IN ({", ".join(f"'{x}'" for x in url_filter.SECOND_LEVEL)}) THEN 2 ELSE 1 END AS deep FROM l),
g AS (
  SELECT host, array_to_string(any_value(labels)[-any_value(deep):], '.') AS suffix,
    CASE WHEN regexp_full_match(host, '[0-9.]+') THEN host ELSE array_to_string(any_value(labels)[-any_value(deep) - 1:], '.') END AS domain,
    count(bad)::DOUBLE AS n, count(*) FILTER (WHERE bad)::DOUBLE AS k FROM x GROUP BY host),
dom AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM g GROUP BY ALL),
suf AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM g GROUP BY ALL),
lev AS (SELECT 1 AS level, n, k FROM g UNION ALL SELECT 2, n, k FROM dom UNION ALL SELECT 3, n, k FROM suf),
mo AS (SELECT level, count(*) AS j, sum(n) AS n, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) AS square FROM lev WHERE n > 0 GROUP BY level),
be AS (SELECT *, mean * (1 - mean) AS noise, square - mean * mean - j * mean * (1 - mean) / n AS between_groups FROM mo),
st AS (SELECT level, mean, CASE WHEN between_groups > 0 THEN least(greatest(noise / between_groups - 1, 2), 200) ELSE 200 END AS s FROM be),
k AS (SELECT (SELECT mean FROM st WHERE level = 3) AS mean, (SELECT s FROM st WHERE level = 1) AS s1, (SELECT s FROM st WHERE level = 2) AS s2, (SELECT s FROM st WHERE level = 3) AS s3),
r AS (
  SELECT host, (g.k + s1 * dr) / (g.n + s1) AS rate, g.n + s1 AS total FROM g, k, LATERAL (
    SELECT (dom.k + s2 * (suf.k + s3 * mean) / (suf.n + s3)) / (dom.n + s2) AS dr FROM dom JOIN suf USING (suffix) WHERE dom.suffix = g.suffix AND dom.domain = g.domain) t),
v AS (SELECT host, rate - {url_filter.Z} * sqrt(rate * (1 - rate) / (total + 1)) > {url_filter.BLOCK_ODDS} * mean / (1 - mean + {url_filter.BLOCK_ODDS} * mean) AS blocked FROM r, k),
f AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR blocked THEN 'block' ELSE 'allow' END AS verdict
FROM f LEFT JOIN v USING (host)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op4_quality_rules": OP4_SQL, "op6_ngram_join": OP6_SQL, "op8_url_filter": OP8_SQL}
