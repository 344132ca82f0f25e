"""A sample whose share of each category follows given targets.

Records are counted by category and a second property; only these counts, at most
categories times property values, reach the driver. Quotas come from a minimum-cost flow:
each category asks for its share or its minimum, whichever is larger, arcs through the
cells carry what is available, the second property's margins should follow what is
available, one arc carries the size of the sample, and slack arcs of high cost expose what
cannot be met. The size is kept where records allow it: what some categories lack is drawn
from the others in proportion to their shares. Cells get their rounded share first; which
cells get the remaining single rows is drawn at random. The rows of a cell are drawn by a
hash of their id.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.functions.labels import label_key
from lumenaudit.functions.runtime import cut
from lumenaudit.llm.flow import Network

SLACK_COST, TRIM_COST, OVER_COST, REST_COST = 1e6, 1e3, 10.0, 1.0


def latest_records(records: DataFrame, cross: Column, id_col: str = "vec_id", label_col: str = "label", time_col: str = "scanned_at", late_col: str = "arrived_at") -> DataFrame:
    """``vec_id, label, cross``: each record as its row with the latest time has it (ties: latest arrival, then the larger values)."""
    # null keys are dropped; a null time is the earliest
    row = F.max(F.struct(F.col(time_col).alias("t"), F.col(late_col).alias("a"), label_key(label_col).alias("label"), cross.alias("cross")))
    return records.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("vec_id")).agg(row.alias("r")).select("vec_id", "r.label", "r.cross")


def level_quotas(have: dict[str, int], targets: dict[str, tuple[float, int]], size: float) -> dict[str, float]:
    """Fractional quotas that add to ``size`` (or to all there is): each category its floor or its share times one common factor, as far as it is available.

    Where floors take more than their share the factor is below 1, where categories fall
    short it is above, so the shares of all others keep their proportions.
    """
    floor = {c: min(have[c], least) for c, (_, least) in targets.items()}
    at = lambda x: {c: min(have[c], max(floor[c], x * share * size)) for c, (share, _) in targets.items()}
    low, high = 0.0, 1.0
    most = max((have[c] / (share * size) for c, (share, _) in targets.items() if share * size > 0), default=0.0)
    while sum(at(high).values()) < size and high < most:
        high = min(most, 2 * high)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(at(mid).values()) < size else (low, mid)
    return at(high)


def cell_quotas(cells: dict[tuple[str, str], int], targets: dict[str, tuple[float, int]], size: float, seed: int) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """(quota of each cell, shortfall of each category) for ``targets`` of (share, least rows).

    Arcs: source to category (what it asks for), category to its quota (the integers around
    its level), quota to second property through the cells (what is available), property to
    sample (its margin), sample to sink (the size). What a category asks for and does not
    have leaves by its slack arc; what it has but the size has no room for leaves by a
    cheaper arc.
    """
    rng = random.Random(seed)
    want = {c: max(0, math.ceil(max(least, share * size))) for c, (share, least) in targets.items()}
    kinds = sorted({k for _, k in cells})
    have = {c: sum(n for (a, _), n in cells.items() if a == c) for c in targets}
    level = level_quotas(have, targets, size)
    # the size, but never less than the floors that exist and never more than there is
    room = round(sum(level.values()))
    total = sum(have.values())
    net, arcs, slack = Network(), {}, {}
    for c in sorted(targets):
        low, high = math.floor(level[c] + 1e-9), math.ceil(level[c] - 1e-9)
        net.arc("source", ("category", c), max(want[c], high))
        slack[c] = net.arc(("category", c), "sink", max(0, want[c] - have[c]), SLACK_COST)
        held = max(min(want[c], have[c]), high)
        net.arc(("category", c), ("held", c), held)
        net.arc(("held", c), "sink", held - low, TRIM_COST)
        net.arc(("held", c), ("quota", c), high)
        for k in kinds:
            n = cells.get((c, k), 0)
            if not n:
                continue
            even = level[c] * n / have[c]
            base = min(n, math.floor(even))
            parts = [net.arc(("quota", c), ("kind", k), base)]
            # the single rows left over by rounding are drawn: a larger remainder makes a lower cost likely
            part = even - base
            if n > base:
                parts.append(net.arc(("quota", c), ("kind", k), 1, rng.expovariate(max(part, 1e-3)) / 1e4))
            if n > base + 1:
                parts.append(net.arc(("quota", c), ("kind", k), n - base - 1, REST_COST))
            arcs[c, k] = parts
    for k in kinds:
        margin = round(room * sum(n for (_, j), n in cells.items() if j == k) / total) if total else 0
        net.arc(("kind", k), "sample", margin)
        net.arc(("kind", k), "sample", sum(want.values()) + room, OVER_COST)
    net.arc("sample", "sink", room)
    net.send("source", "sink")
    return {cell: sum(net.flow(a) for a in parts) for cell, parts in arcs.items()}, {c: net.flow(a) for c, a in slack.items()}


def plan_sample(latest: DataFrame, targets: DataFrame, fraction: float, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(quotas ``label, cross, quota``; report) of a sample of ``fraction`` of all records.

    Report, one row per target: ``label, available, wanted, drawn, shortfall, target_share,
    drawn_share``. ``wanted`` is the larger of minimum and share of the size, rounded up;
    ``drawn`` may be below it by what other minimums take, and above it by what other labels
    lack. The size counts records without a label or target too. A target of
    label null is ignored; of repeated targets the largest counts; a label of no record
    falls short of everything it asks for.
    """
    spark = latest.sparkSession
    size = fraction * latest.count()
    # the table of targets is the caller's list of categories
    rows = targets.where("label is not null").groupBy("label").agg(F.max("target_share").alias("s"), F.max("min_rows").alias("m")).collect()
    wish = {r["label"]: (float(r["s"] or 0), int(r["m"] or 0)) for r in rows}
    counted = latest.join(targets.select("label").distinct(), "label", "left_semi").groupBy("label", "cross").agg(F.count("*").alias("n")).collect()
    cells = {(r["label"], r["cross"] or ""): r["n"] for r in counted}
    quota, short = cell_quotas(cells, wish, size, seed)
    drawn = {c: sum(q for (a, _), q in quota.items() if a == c) for c in wish}
    total = sum(drawn.values())
    report = [(c, sum(n for (a, _), n in cells.items() if a == c), max(0, math.ceil(max(wish[c][1], wish[c][0] * size))), drawn[c], short[c], wish[c][0], drawn[c] / total if total else 0.0) for c in sorted(wish)]
    quotas = spark.createDataFrame([(a, b, q) for (a, b), q in sorted(quota.items()) if q], "label string, cross string, quota long")
    return quotas, spark.createDataFrame(report, "label string, available long, wanted long, drawn long, shortfall long, target_share double, drawn_share double")


def draw(latest: DataFrame, quotas: DataFrame, seed: int = 7, buckets: int = 1024) -> DataFrame:
    """``vec_id, label, cross``: of each cell the ``quota`` records with the smallest hash.

    Cells are divided in ``buckets`` ranges of the hash; running counts tell which ranges
    are taken whole and in which the quota ends, so no cell is ordered in one task.
    """
    rows = latest.select("vec_id", "label", F.coalesce("cross", F.lit("")).alias("cross"), F.xxhash64("vec_id", F.lit(seed)).alias("h"))
    rows = rows.withColumn("b", F.shiftrightunsigned("h", 64 - (buckets - 1).bit_length())).join(quotas, ["label", "cross"])
    per = rows.groupBy("label", "cross", "b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label", "cross").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("label", "cross", "b", F.coalesce(before, F.lit(0)).alias("before"), "n")
    near = rows.join(per, ["label", "cross", "b"]).where(F.col("before") < F.col("quota"))
    order = Window.partitionBy("label", "cross", "b").orderBy("h", "vec_id")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("before") + F.col("r") <= F.col("quota")).select("vec_id", "label", "cross")


def sample_by_targets(records: DataFrame, targets: DataFrame, cross: Column, fraction: float = 0.4, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for a table of records and one of targets; see the functions above."""
    latest = cut(latest_records(records, cross), "latest")
    quotas, report = plan_sample(latest, targets, fraction, seed)
    return draw(latest, quotas, seed), report
