"""The registered query of each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    exact_dedup,
    html_text,
    license_scan,
    minhash_dedup,
    quality_classifier,
    quality_rules,
    ranked_search,
    secret_scan,
    source_mixing,
    spelling_variants,
    url_filter,
    warc,
)
from .common import table
from .oracles import OP2_SQL, OP6_SQL, OP7_SQL, OP8_SQL, OP11_SQL, OP12_SQL, OP13_SQL


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    scored = quality_classifier.score_documents(docs, quality_classifier.train(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.scan_documents(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents"))


# the patterns' regular expressions are worked out here from the lists alone
_SEP = "([^a-z0-9]|^|$)"
_BLOCK = [
    f"{_SEP}({'|'.join(url_filter.UNWANTED)}){_SEP}",
    f"{_SEP}({'|'.join(url_filter.FIRST)}){_SEP}({'|'.join(url_filter.SECOND)}){_SEP}",
    f"{_SEP}({'|'.join(p.replace('-', _SEP) for p in url_filter.PAIRS)}){_SEP}",
    f"^([^/]*[.])?({'|'.join(url_filter.AD_LABELS)})[.].*/",
    f"/({'|'.join(p.replace('.', '[.]') for p in url_filter.NO_PAGES)})$",
    f"{_SEP}(affiliate|partner|campaign).*{_SEP}redirect{_SEP}.*{_SEP}(click|offer|landing){_SEP}",
]
_ALLOW = f"{_SEP}({'|'.join(w.replace('^', _SEP) for w in url_filter.WANTED)}){_SEP}"
OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
r AS (
  SELECT *, host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(whole, '{_ALLOW}') THEN 'allow'
    WHEN {" OR ".join(f"regexp_matches(whole, '{p}')" for p in _BLOCK)} THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""

OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM d),
g AS (
  SELECT rid, i, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM w
  WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w1, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n >= 2 GROUP BY rid),
l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^[ \t]*[•*-][ \t]')) AS n_bullets,
         count(*) FILTER (regexp_matches(line, '([.][.][.]|…)[\x20\x09\x0B-\x0D]*$')) AS n_ellipses
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses,
         len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words, (length(t) - length(replace(t, '!!', ''))) // 2 AS n_shouts
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN l USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_shouts > 3 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_letter_words < 8 * n_words OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines) AS kept
FROM f
"""


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.mark_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
per AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM d GROUP BY source),
tot AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n FROM per WHERE tokens > 0),
live AS (SELECT list(tokens / total ORDER BY tokens) AS p FROM per, tot WHERE tokens > 0),
own AS (SELECT p, -list_sum(list_transform(p, lambda x: x * ln(x))) AS h FROM live),
t AS (SELECT p, h, h + 0.5 * (ln(n) - h) - 1e-9 AS target FROM own, tot),
b1 AS (
  SELECT 0 AS step, 0 AS lo, 1048576 AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT step, lo, hi, mid, ln(s) - l / s >= target AS ok
        FROM (SELECT step, lo, hi, (lo + hi) // 2 AS mid, target, list_sum(list_transform(p, lambda x: pow(x, ((lo + hi) // 2) / 1048576.0::DOUBLE))) AS s,
                     list_sum(list_transform(p, lambda x: pow(x, ((lo + hi) // 2) / 1048576.0::DOUBLE) * ln(pow(x, ((lo + hi) // 2) / 1048576.0::DOUBLE)))) AS l
              FROM b1, t WHERE step < 20))),
e AS (SELECT CASE WHEN h >= target THEN 1048576 ELSE lo END AS j FROM b1, t WHERE step = 20),
b2 AS (
  SELECT 0 AS step, 0 AS lo, 1048576 AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN often THEN mid ELSE lo END, CASE WHEN often THEN hi ELSE mid END
  FROM (SELECT step, lo, hi, (lo + hi) // 2 AS mid,
               list_max(list_transform(p, lambda x: pow(x, ((lo + hi) // 2) / 1048576.0::DOUBLE) / x)) / list_sum(list_transform(p, lambda x: pow(x, ((lo + hi) // 2) / 1048576.0::DOUBLE))) > 4 AS often
        FROM b2, t WHERE step < 20)),
a AS (
  SELECT CASE WHEN list_max(list_transform(p, lambda x: pow(x, e.j / 1048576.0::DOUBLE) / x)) / list_sum(list_transform(p, lambda x: pow(x, e.j / 1048576.0::DOUBLE))) > 4
         THEN least(1048576, b2.lo + 1) ELSE e.j END / 1048576.0::DOUBLE AS a FROM e, t, b2 WHERE b2.step = 20),
w AS (
  SELECT source, tokens, total, CASE WHEN tokens > 0 THEN round(pow(tokens / total, a) / list_sum(list_transform(p, lambda x: pow(x, a))), 9) ELSE 0 END AS source_weight,
         CAST(ceil(docs / 1000) AS BIGINT) AS n_blocks FROM per, tot, t, a),
plan AS (
  SELECT source, source_weight, n_blocks, CASE WHEN tokens > 0 THEN CAST(floor(source_weight * total) AS BIGINT) // tokens ELSE 0 END AS passes,
         CASE WHEN tokens > 0 THEN CAST(floor(source_weight * total) AS BIGINT) % tokens ELSE 0 END AS rest FROM w),
x AS (
  SELECT d.*, source_weight, passes, rest, CAST('0x' || substr(key, 1, 8) AS BIGINT) % n_blocks AS block
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
bl AS (
  SELECT source, block, coalesce(sum(bt) OVER (PARTITION BY source ORDER BY md5('mix-1:b' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, block, sum(n_tokens) AS bt FROM x GROUP BY source, block))
SELECT doc_id, x.source, n_tokens, source_weight, x.block,
       CASE WHEN n_tokens > 0 THEN passes + CASE WHEN before + sum(n_tokens) OVER (PARTITION BY x.source, x.block ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END ELSE 0 END AS copies
FROM x JOIN bl ON x.source IS NOT DISTINCT FROM bl.source AND x.block = bl.block
"""

OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item, n, array_to_string(ws[s:s + n - 1], ' ') AS w
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS s FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT rid, s, n, array_to_string(ws[s:s + n - 1], ' ') AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT rid, s, dw.n, item FROM dw JOIN win ON dw.w = win.w AND dw.n = win.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_license_scans,
        op3_url_filters,
        op4_secret_scans,
        op5_quality_rules,
        op6_html_extraction,
        op7_minhash_near_dedup,
        op8_warc,
        op9_source_mixing,
        op10_benchmark_decontamination,
        op11_spelling_variants,
        op12_ranked_search,
        op13_exact_dedup,
    )
}
SQL: dict[str, str] = {
    "op2_license_scans": OP2_SQL,
    "op3_url_filters": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_html_extraction": OP6_SQL,
    "op7_minhash_near_dedup": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op9_source_mixing": OP9_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
