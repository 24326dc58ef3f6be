"""The registered query of each operator, over its whole table, and SQL where it can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import classifier, decontam, hpylm, lines, mixing, nearjoin, quality, tokens, toxicity, urls

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
NEAR_WORDS, NEAR_PERCENT = 4, 85


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.contamination(docs, _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("_edits").isNotNull().alias("contaminated"), F.col("_items").alias("item_ids"), F.col("_edits").alias("edits"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urls.apply_rules(pages, urls.rules_table(spark, URL_RULES), "page_id")


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_join(_read(spark, sf_dir, "documents"), k=NEAR_WORDS, percent=NEAR_PERCENT)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_texts(_read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(quality.measures(_read(spark, sf_dir, "documents"), "doc_id"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_decontaminate, op3_line_dedup, op4_url_filter, op5_near_join, op6_token_counts, op7_lm_score, op8_quality_rules, op9_quality_classifier, op10_toxicity)}

_URL_SQL = """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages
), r AS (
  SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM r
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h
), rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(rh, rp, rv)
), fit AS (
  SELECT p.page_id, p.host, p.path, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh) DESC, length(rp) DESC) AS n
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM fit WHERE n = 1
"""

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
_FAILED = " OR ".join(f"{r.measure} {op} {bound}" for r in quality.RULES for op, bound in (("<", r.low), (">", r.high)) if bound is not None)
_QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
wl AS (SELECT doc_id, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM wl),
v AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE w = p) AS stutters, count(*) FILTER (WHERE lower(w) IN ({_STOPS})) AS stops FROM v GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM wl WHERE len(ws) > 7)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 8) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
b AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (WHERE regexp_matches(ltrim(l), '^[-*•·] ')) AS bullets, count(*) FILTER (WHERE ends_with(rtrim(l), '...') OR ends_with(rtrim(l), '…')) AS dots FROM l GROUP BY doc_id),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(x) - length(regexp_replace(x, '[!?]', '', 'g')) AS n_marks, length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS upper_chars,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(stutters, 0) AS stutters, coalesce(stops, 0) AS stops, coalesce(bullets, 0) AS bullets, coalesce(dots, 0) AS dots
  FROM d LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)),
q AS (SELECT *, coalesce(word_chars / nullif(n_words, 0)::double, 0) AS mean_word_length, coalesce(n_symbols / nullif(n_words, 0)::double, 0) AS symbols_per_word, coalesce(n_marks / nullif(n_words, 0)::double, 0) AS marks_per_word,
  coalesce(100.0::double * n_repeat_words / nullif(n_words, 0), 0) AS repeat_percent, coalesce(n_dup_lines / nullif(n_lines, 0)::double, 0) AS dup_line_share, coalesce(bullets / nullif(n_lines, 0)::double, 0) AS bullet_line_share,
  coalesce(dots / nullif(n_lines, 0)::double, 0) AS ellipsis_line_share, coalesce(upper_chars / nullif(word_chars, 0)::double, 0) AS upper_share, coalesce(stutters / nullif(n_words, 0)::double, 0) AS stutter_share, coalesce(stops / nullif(n_words, 0)::double, 0) AS stop_word_share,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words, base_failed, NOT base_failed AND NOT ({_FAILED}) AS kept FROM q
"""

ORACLE = {"op4_url_filter": _URL_SQL, "op8_quality_rules": _QUALITY_SQL}
