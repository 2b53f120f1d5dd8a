"""One query for each operator over the whole documents table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.llm import (
    alignment, fingerprints, language_id, mixing, near_dedup, neighbours, packing, periodic_runs, quality, substring_dedup,
    suffix_dedup, token_counts, topk_search)
from cohortspark.llm.common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all documents whose id is divisible by 20, with all terms of their whole texts, against all documents."""
    docs = documents(spark, sf_dir)
    return topk_search.search(docs, docs.where("doc_id % 20 = 0"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(documents(spark, sf_dir)).drop("kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_passages(documents(spark, sf_dir)).drop("kept")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).withColumn("target", F.round("target", 4))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all texts, a tenth of which repeat a stretch of theirs by a rule on their id."""
    found = periodic_runs.find_runs(documents(spark, sf_dir), periodic_runs.repeated_from_id, kept=False)
    return periodic_runs.longest_run(found)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all rows whose id is divisible by 20, against all rows."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_topk_search, op3_suffix_array_dedup, op4_substring_dedup, op5_source_mixing, op6_token_counts,
    op7_quality_classifier, op8_best_fit_packing, op9_minhash_near_dedup, op10_fingerprints, op11_periodic_runs, op12_tokenizer_alignment, op13_nearest_neighbours,
    pipeline)}

_SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d WHERE len(ws) > 0),
s AS (SELECT *, CASE WHEN i + 12 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS win FROM w),
r AS (SELECT doc_id, word, i, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM s),
c AS (SELECT doc_id, word, i, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM r),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

_MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source),
o AS (SELECT *, 3.0 * source_size AS cap, sum(source_size) OVER ()
    - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s),
l AS (SELECT arg_min(rest / open, cap / weight) AS level FROM o WHERE rest / open <= cap / weight),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight)::DOUBLE AS target FROM o, l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3)::BIGINT END AS whole FROM t),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, round(target, 4) AS target,
  (size * (whole + CASE WHEN target - whole * source_size > 0 AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
"""

ORACLE: dict[str, str] = {
    "op2_topk_search": topk_search.SQL, "op4_substring_dedup": _SUBSTRING_SQL,
    "op5_source_mixing": _MIXING_SQL, "op13_nearest_neighbours": neighbours.SQL}
