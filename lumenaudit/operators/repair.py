"""Repair suggestions from a diagnostics report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Explicit schema of a diagnostics report in JSON.
REPORT = (
    "metrics struct<class_distribution: map<string, bigint>, high_influence_count: bigint, "
    "group_analysis: struct<available: boolean, label_distribution_parity: double, robustness_flag: boolean>>"
)

#: Thresholds of the rules.
CLASS_RATIO, PARITY = 1.5, 0.2


def repair_suggestions(reports: DataFrame, report: str = "report") -> DataFrame:
    """Adds ``suggestions``: texts, most urgent first; a balanced dataset gets one saying so, an unreadable report an error.

    Classes: largest over smallest count above 1.5. Groups, when available: parity above
    0.2; without groups the robustness flag. Influence: any sample counted as high.
    """
    r = F.from_json(report, REPORT)
    m = r["metrics"]
    counts = F.map_values(m["class_distribution"])
    ratio = F.array_max(counts) / F.nullif(F.array_min(counts), F.lit(0))
    group = m["group_analysis"]
    has = F.coalesce(group["available"], F.lit(False))
    rules = F.array_compact(
        F.array(
            F.when(ratio > CLASS_RATIO, F.concat(F.lit("Balance classes: the largest is "), F.format_number(ratio, 2), F.lit(" times the smallest."))),
            F.when(has & (group["label_distribution_parity"] > PARITY), F.concat(F.lit("Review groups: label shares differ by "), F.format_number(group["label_distribution_parity"], 2), F.lit("."))),
            F.when(~has & F.coalesce(group["robustness_flag"], F.lit(False)), F.lit("Improve low-quality images: results differ between quality tiers.")),
            F.when(m["high_influence_count"] > 0, F.concat(F.lit("Review "), m["high_influence_count"].cast("string"), F.lit(" samples of high influence."))),
        )
    )
    none = F.array(F.lit("The dataset looks balanced."))
    return reports.withColumn("suggestions", F.when(r.isNull() | m.isNull(), F.array(F.lit("error: no readable report"))).otherwise(F.when(F.size(rules) == 0, none).otherwise(rules)))


def to_report(metrics: DataFrame) -> DataFrame:
    """``report``: the JSON text of one row with ``class_distribution, high_influence_count, group_analysis``."""
    return metrics.select(F.to_json(F.struct(F.struct("class_distribution", "high_influence_count", "group_analysis").alias("metrics"))).alias("report"))
