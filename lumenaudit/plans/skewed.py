"""Queries on keys of very uneven load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.functions.labels import label_key, label_key_sql
from lumenaudit.functions.runtime import table
from lumenaudit.operators.skew import fragment_replicate_join, heavy_keys
from lumenaudit.plans.registry import query

#: Fixed value: a label key is heavy from this share of all rows on.
HEAVY = 0.03

_KEYED = f"(SELECT *, {label_key_sql('label')} AS k FROM quality_scores)"


@query(f"""
    SELECT k AS label FROM {_KEYED} WHERE k IS NOT NULL GROUP BY k
    HAVING count(*) >= {HEAVY} * (SELECT count(*) FROM quality_scores)
""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Label keys with three percent or more of all rows."""
    rows = table(spark, d, "quality_scores").select(label_key("label").alias("label"))
    return heavy_keys(rows, "label", HEAVY).where("key is not null").select(F.col("key").alias("label"))


def _exact_mean(c: Column) -> Column:
    """Mean by a decimal sum, the same in any order of rows."""
    return F.sum(c.cast("decimal(18,5)")).cast("double") / F.count(c)


@query(f"""
    SELECT q.k AS label, count(*) AS n_rows, count(DISTINCT q.measure_id) AS n_measures,
           sum(CAST(CASE WHEN isnan(quality_score) THEN NULL ELSE quality_score END AS DECIMAL(18, 5)))::DOUBLE / count(CASE WHEN isnan(quality_score) THEN NULL ELSE quality_score END) AS mean_score,
           sum(CAST(brightness AS DECIMAL(18, 5)))::DOUBLE / count(brightness) AS mean_brightness, max(t.target_share) AS target_share, max(t.min_rows) AS min_rows
    FROM {_KEYED} q JOIN sample_targets t ON q.k = t.label GROUP BY q.k
""")
def p7_label_report(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of each label that has a target, with its wanted share, joined without hot tasks. ``p7_labels`` has all labels."""
    return _report(spark, d, "inner")


@query(f"""
    SELECT q.k AS label, count(*) AS n_rows, count(DISTINCT q.measure_id) AS n_measures,
           sum(CAST(CASE WHEN isnan(quality_score) THEN NULL ELSE quality_score END AS DECIMAL(18, 5)))::DOUBLE / count(CASE WHEN isnan(quality_score) THEN NULL ELSE quality_score END) AS mean_score,
           sum(CAST(brightness AS DECIMAL(18, 5)))::DOUBLE / count(brightness) AS mean_brightness, max(t.target_share) AS target_share, max(t.min_rows) AS min_rows
    FROM {_KEYED} q LEFT JOIN sample_targets t ON q.k = t.label GROUP BY q.k
""")
def p7_labels(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of every label, with a target or without; rows without a label are a group of their own."""
    return _report(spark, d, "left")


def _report(spark: SparkSession, d: str, how: str) -> DataFrame:
    rows = table(spark, d, "quality_scores").select(label_key("label").alias("label"), "measure_id", "quality_score", "brightness")
    joined = fragment_replicate_join(rows, table(spark, d, "sample_targets"), "label", how, spread_by=["measure_id"])
    score = F.when(F.isnan("quality_score"), None).otherwise(F.col("quality_score"))
    return joined.groupBy("label").agg(
        F.count("*").alias("n_rows"), F.count_distinct("measure_id").alias("n_measures"), _exact_mean(score).alias("mean_score"),
        _exact_mean(F.col("brightness")).alias("mean_brightness"), F.max("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"),
    )
