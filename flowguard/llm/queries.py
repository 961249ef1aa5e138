"""The registered queries of this package: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm import conversations, decontamination, html_text, language_id, mixing, ngram_join, quality_rules, secret_scan, simhash, token_alignment, token_counts, toxicity, url_filter
from flowguard.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), one_text=True)


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


ORACLE["op7_url_filter"] = r"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), links AS (
  SELECT url, unnest([regexp_extract(regexp_extract(html, '(?is)<link\s[^>]*rel\s*=\s*["'']?canonical[^>]*>'), '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1),
                      regexp_extract(regexp_extract(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>'), '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1)]) AS t
  FROM pages WHERE contains(url, '://')
), targets AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN starts_with(t, '/') THEN 'http://' || regexp_extract(url, '://([^/?#]*)', 1) || t
    ELSE 'http://' || regexp_extract(url, '://([^/?#]*)', 1) || coalesce(nullif(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') || t END AS target
  FROM links WHERE t <> ''
), urls AS (
  SELECT url FROM pages UNION SELECT target FROM targets
), parsed AS (
  SELECT url, CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '://([^/?#]*)', 1)) ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^?#]*(\?[^#]*)', 1) ELSE '' END AS query
  FROM urls WHERE url IS NOT NULL
), ruled AS (
  SELECT url, host, path, CASE WHEN contains(url, '://') THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node,
         (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
         (SELECT max_by(verdict, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS said
  FROM parsed
), edges AS (
  SELECT a.node AS a, b.node AS b FROM targets t JOIN ruled a ON a.url = t.url JOIN ruled b ON b.url = t.target
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reached AS (
  SELECT node FROM ruled JOIN both_ways ON node = a WHERE said = 'block' UNION SELECT e.b FROM reached r JOIN both_ways e ON e.a = r.node
)
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule,
       coalesce(r.said, CASE WHEN r.node IN (SELECT node FROM reached) THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN ruled r ON r.url = p.url
"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language_id.fold(F.col("doc_id"), 5) == 0
    model = toxicity.learn(docs.where(~held_out), labels.where(~held_out), all_docs=docs)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.fold(F.col("doc_id"), 4) == 2
    found = language_id.predict(docs, language_id.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE["op10_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS room,
         ((SELECT sum(source_size) FROM by_source) - coalesce(sum(3 * source_size) OVER before, 0))::BIGINT
           / ((SELECT sum(weight) FROM by_source) - coalesce(sum(weight) OVER before, 0))::BIGINT AS level
  FROM by_source WINDOW before AS (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, CASE WHEN level > room THEN cap::DOUBLE
           ELSE (SELECT arg_min(level, (room, source IS NULL, source)) FROM levels WHERE level <= room) * weight END AS target
  FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goals
), placed AS (
  SELECT s.*, source_size, target, epochs, target - epochs * source_size AS rest,
         (sum(size) OVER (PARTITION BY s.source ORDER BY key, size RANGE UNBOUNDED PRECEDING))::BIGINT AS upto,
         (sum(size) OVER (PARTITION BY s.source, key, size))::BIGINT AS alike
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target,
       size * epochs + CASE WHEN upto <= rest THEN size WHEN upto - alike < rest THEN floor((rest - (upto - alike)) * size / alike)::BIGINT ELSE 0 END AS taken
FROM placed
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(table(spark, sf_dir, "documents"), a, b, keep_groups=False)


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), all_ids=rows, texts=False)
