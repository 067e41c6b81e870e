"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, leakage, personal, similar, token_ids


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar.similar_pairs(table(spark, folder, "rag_chunks"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    near = similar.most_similar(table(spark, folder, "rag_chunks"))
    return near.select("id", "other", "rank", F.round(F.col("similarity").cast("double"), 4).alias("similarity"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.wrong_labels(table(spark, folder, "documents"), language.model_for(spark, folder))


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.segments(table(spark, folder, "documents"), language.model_for(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids.token_ids(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leak_report(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_found(table(spark, folder, "documents"))


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redacted(table(spark, folder, "documents"))


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_segments": p4_segments, "p6_ids": p6_ids, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_redacted": p8_redacted}

_USABLE = """WITH p AS (SELECT id, any_value(vector::DOUBLE[]) AS v FROM rag_chunks WHERE id IS NOT NULL AND len(vector) = 384 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 384
  AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id),
s AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS similarity FROM p a JOIN p b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 6) DESC, other) AS rank FROM s)
"""

ORACLES: dict[str, str] = {
    # Brute force, which small tables allow.
    "p3_found": _USABLE + "SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE rank <= 5 AND similarity >= 0.8",
}
