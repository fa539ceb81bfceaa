"""Queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import decontaminate, html_extract, language_id, line_crf, line_dedup, mixing, sharding, simhash, subword_classifier, suffix_dedup
from kgspark.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op5_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_html_extraction, op2_decontamination, op3_language_id, op4_line_dedup, op5_line_crf_quality,
        op6_simhash_trie, op7_jump_sharding, op8_subword_classifier, op9_mixing, op10_suffix_dedup,
    )
    return {f.__name__: f for f in found}


OP7_SQL = f"""
WITH RECURSIVE keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS k FROM documents),
walk AS (
  SELECT k, ('0x' || substr(md5(k), 1, 16))::UBIGINT::HUGEINT AS key, 0::BIGINT AS bucket, 0::BIGINT AS jumped FROM keys
  UNION ALL
  SELECT k, nxt, jumped, floor((jumped + 1) * (2147483648.0::DOUBLE / ((nxt // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT k, jumped, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nxt FROM walk WHERE jumped < {sharding.N_SHARDS})
), last AS (SELECT k, max(bucket) AS shard FROM walk GROUP BY k)
SELECT d.*, l.shard::INTEGER AS shard FROM documents d JOIN last l ON l.k = coalesce(d.doc_id::VARCHAR, '')
"""

OP9_SQL = f"""
WITH sizes AS (SELECT coalesce(source, '') AS source, sum(coalesce(length(text), 0))::HUGEINT AS size FROM documents GROUP BY 1),
sized AS (SELECT *, floor(sqrt(size::DOUBLE))::HUGEINT AS weight FROM sizes),
budget AS (SELECT coalesce(sum(size), 0)::HUGEINT AS budget FROM sized),
live AS (SELECT *, (size * {mixing.MAX_EPOCHS})::DOUBLE / weight::DOUBLE AS level FROM sized, budget WHERE size > 0 AND weight > 0),
filled AS (
  SELECT *, coalesce(sum(size * {mixing.MAX_EPOCHS}) OVER (ORDER BY level, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(weight) OVER (ORDER BY level, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM live),
feasible AS (SELECT * FROM filled WHERE (budget - clamped) * weight <= size * {mixing.MAX_EPOCHS} * left_weight),
knee AS (SELECT level AS l, source AS s, greatest(budget - clamped, 0) AS rest, left_weight AS w FROM feasible ORDER BY level, source LIMIT 1),
rates AS (
  SELECT f.source, least(CASE WHEN f.level > knee.l OR (f.level = knee.l AND f.source >= knee.s)
    THEN (knee.rest * f.weight * {mixing.UNIT}) // (f.size * knee.w) ELSE {mixing.MAX_EPOCHS * mixing.UNIT} END, {mixing.MAX_EPOCHS * mixing.UNIT})::BIGINT AS rate
  FROM filled f LEFT JOIN knee ON true),
drawn AS (
  SELECT d.*, (r.rate // {mixing.UNIT} + CASE WHEN ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT % {mixing.UNIT} < r.rate % {mixing.UNIT}
    THEN 1 ELSE 0 END)::INTEGER AS n
  FROM documents d JOIN rates r ON r.source = coalesce(d.source, ''))
SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INTEGER AS "copy" FROM drawn WHERE n > 0
"""

OP4_SQL = f"""
WITH rows_ AS (SELECT *, row_number() OVER () AS rid FROM documents),
pieces AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows_),
keyed AS (SELECT *, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS key FROM pieces),
counted AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM keyed),
kept AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key = '' OR n <= {line_dedup.MAX_COUNT}) AS text,
                count(*) FILTER (WHERE key <> '' AND n > {line_dedup.MAX_COUNT}) AS lost FROM counted GROUP BY rid)
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, r.lang, r.source, r.n_chars,
       coalesce(k.lost, 0)::INTEGER AS removed_lines
FROM rows_ r LEFT JOIN kept k USING (rid)
"""

ORACLE_SQL = {"op4_line_dedup": OP4_SQL, "op7_jump_sharding": OP7_SQL, "op9_mixing": OP9_SQL}
