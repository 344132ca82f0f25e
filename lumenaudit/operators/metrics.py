"""Class counts, balance, group parity and quality tiers.

All operators are aggregates and joins on aggregates; a window without partitions only
ever runs over rows that are already one per class, group or tier.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.operators.order_statistics import percentiles_of


def _all():  # noqa: ANN202
    """All rows; only used over tables of one row per class, group or tier."""
    return Window.partitionBy()


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """``class, count, proportion`` of labelled rows, most frequent first (ties by class). Null labels are left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("count"))
    return counts.withColumn("proportion", F.col("count") / F.sum("count").over(_all())).orderBy(F.desc("count"), "class")


def diversity_metrics(df: DataFrame, label: str) -> DataFrame:
    """One row ``shannon_entropy, gini_index, effective_classes``, rounded to 4, 4 and 2 places. No labelled rows: nulls."""
    p = F.col("proportion")
    one = class_distribution(df, label).agg(F.sum(-p * F.log2(p)).alias("h"), (1 - F.sum(p * p)).alias("g"))
    return one.select(F.round("h", 4).alias("shannon_entropy"), F.round("g", 4).alias("gini_index"), F.round(F.pow(F.lit(2.0), F.col("h")), 2).alias("effective_classes"))


def flag_imbalance(df: DataFrame, label: str, mean_ratio: float = 0.5) -> DataFrame:
    """Classes with fewer than ``mean_ratio`` times the mean count, strictly."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("count"))
    return counts.withColumn("mean", F.avg("count").over(_all())).where(F.col("count") < mean_ratio * F.col("mean")).select("class", "count").orderBy("class")


def summarize_imbalance(df: DataFrame, label: str, mean_ratio: float = 0.5) -> DataFrame:
    """Distribution, diversity and flags in one table, a row per class."""
    flags = flag_imbalance(df, label, mean_ratio).select("class", F.lit(True).alias("flagged"))
    # the metrics are one row, the flags one per class
    return class_distribution(df, label).join(flags, "class", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False))).crossJoin(F.broadcast(diversity_metrics(df, label)))


def balance_status(df: DataFrame, label: str, bound: float = 0.15) -> DataFrame:
    """One row ``n_classes, ratio, balanced``: spread of the class counts over their mean."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("c"))
    ratio = F.stddev_pop("c") / (F.avg("c") + 1e-9)
    return counts.agg(F.count("*").alias("n_classes"), ratio.alias("ratio")).withColumn("balanced", F.col("ratio") < bound)


def dataset_summary(df: DataFrame, label: str, width: str, height: str, corrupt: str) -> DataFrame:
    """One row of counts and of mean and median sizes; sizes of 0 or null are left out."""

    def size(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c))

    counts = df.agg(
        F.count("*").alias("total"), F.count(label).alias("labeled"), F.count_if(F.col(label).isNull()).alias("unlabeled"), F.count_distinct(label).alias("n_classes"),
        F.count_if(F.col(corrupt)).alias("corrupt"), F.avg(size(width)).alias("mean_width"), F.avg(size(height)).alias("mean_height"),
    )
    # both medians in one sort: a group for widths, one for heights
    sides = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("side"), size(c).cast("double").alias("v")) for i, c in enumerate((width, height))])).alias("s")).select("s.side", "s.v")
    middle = percentiles_of(sides, ["side"], "v", [0.5]).agg(*[F.max(F.when(F.col("side") == i, F.col("p0"))).alias(f"median_{c}") for i, c in enumerate(("width", "height"))])
    return counts.crossJoin(F.broadcast(middle)).select("total", "labeled", "unlabeled", "n_classes", "corrupt", "mean_width", "median_width", "mean_height", "median_height")


def resolution_summary(df: DataFrame, width: str, height: str) -> DataFrame:
    """``width, height, count, is_uniform`` of known sizes, most frequent first."""
    sizes = df.where(F.col(width).isNotNull() & F.col(height).isNotNull()).groupBy(F.col(width).alias("width"), F.col(height).alias("height")).agg(F.count("*").alias("count"))
    return sizes.withColumn("is_uniform", F.count("*").over(_all()) <= 1).orderBy(F.desc("count"), "width", "height")


def corruption_summary(df: DataFrame, corrupt: str, path: str, show: int = 20) -> DataFrame:
    """One row ``total, corrupt, examples``: the first ``show`` corrupt paths, joined by commas."""
    counts = df.agg(F.count("*").alias("total"), F.count_if(F.col(corrupt)).alias("corrupt"))
    first = df.where(F.col(corrupt)).select(path).distinct().orderBy(path).limit(show).agg(F.array_join(F.array_sort(F.collect_list(path)), ",").alias("examples"))
    return counts.crossJoin(F.broadcast(first))


def value_histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """``bin, low, high, count`` of equal widths from least to greatest value; the last bin is closed; empty bins count 0. Null and NaN are left out."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") == F.col("a"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1))).cast("int")
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    grid = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def group_quantiles(df: DataFrame, group: str, value: str, fractions: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per group ``n, mean`` and exact quantiles ``q25`` and so on."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    means = rows.groupBy("_g").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    # one row per group on both sides
    q = percentiles_of(rows, ["_g"], "_v", fractions)
    return means.join(q, "_g", "left").select(F.col("_g").alias(group), "n", "mean", *[F.col(f"p{i}").alias(f"q{round(f * 100)}") for i, f in enumerate(fractions)])


def label_gallery(df: DataFrame, label: str, item: str, per_label: int = 8, labels: int = 6) -> DataFrame:
    """The first items of the first labels: ``label, item, position``."""
    first = df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(labels)
    order = Window.partitionBy(label).orderBy(item)
    rows = df.select(label, item).join(F.broadcast(first), label, "left_semi")
    # the window keeps few rows per label, so Spark limits groups before the shuffle
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_label)


def group_distribution(df: DataFrame, group: str, label: str) -> DataFrame:
    """``group, class, proportion`` for every group and class, 0 where a class is absent."""
    rows = df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(F.col(group).alias("group"), F.col(label).alias("class")).agg(F.count("*").alias("c"))
    # counts hold one row per group and class; the list of classes is one row, laid beside every group
    classes = counts.agg(F.collect_set("class").alias("_all"))
    grid = counts.select("group").distinct().crossJoin(F.broadcast(classes)).select("group", F.explode("_all").alias("class"))
    totals = counts.groupBy("group").agg(F.sum("c").alias("n"))
    return grid.join(counts, ["group", "class"], "left").join(totals, "group").select("group", "class", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("proportion"))


def group_parity(df: DataFrame, group: str, label: str) -> DataFrame:
    """One row ``label_distribution_parity, group_a, group_b``: the largest total variation distance of two groups.

    Rounded to 4 places; the first pair in order on ties; no pair where all groups agree
    or there is but one.
    """
    d = group_distribution(df, group, label)
    a, b = d.alias("a"), d.alias("b")
    pairs = a.join(b, (F.col("a.class") == F.col("b.class")) & (F.col("a.group") < F.col("b.group")))
    tvd = pairs.groupBy(F.col("a.group").alias("group_a"), F.col("b.group").alias("group_b")).agg((F.sum(F.abs(F.col("a.proportion") - F.col("b.proportion"))) / 2).alias("tvd"))
    key = F.struct(F.round(-F.col("tvd"), 9), "group_a", "group_b")
    best = tvd.agg(F.max("tvd").alias("t"), F.min_by(F.struct("group_a", "group_b"), key).alias("p"))
    some = F.round("t", 9) > 0
    return best.select(F.round(F.coalesce("t", F.lit(0.0)), 4).alias("label_distribution_parity"), F.when(some, F.col("p.group_a")).alias("group_a"), F.when(some, F.col("p.group_b")).alias("group_b"))


def group_fairness(df: DataFrame, group: str, label: str) -> DataFrame:
    """Parity with ``available``: false, and null figures, with fewer than two groups."""
    n = df.where(F.col(group).isNotNull()).agg(F.count_distinct(group).alias("n_groups"))
    parity = group_parity(df, group, label)
    ok = F.col("n_groups") >= 2
    return n.crossJoin(parity).select(ok.alias("available"), "n_groups", F.when(ok, F.col("label_distribution_parity")).alias("label_distribution_parity"), F.when(ok, F.col("group_a")).alias("group_a"), F.when(ok, F.col("group_b")).alias("group_b"))


def zscores(df: DataFrame, columns: Sequence[str], sample: bool) -> DataFrame:
    """Adds ``z_<column>``: global z-scores, 0 where the spread is 0 or unknown or the value is null.

    ``sample``: divide by the sample (n-1) instead of the population deviation. Mean and
    deviation are aggregated once, two numbers a column, so no global window is needed and
    every later pass over the rows sees the same scores.
    """
    dev = F.stddev_samp if sample else F.stddev_pop
    stats = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)], *[dev(c).alias(f"_s{i}") for i, c in enumerate(columns)]).first()
    known = lambda x: F.lit(None if x is None else float(x)).cast("double")
    return df.withColumns({f"z_{c}": F.coalesce((F.col(c) - known(stats[f"_m{i}"])) / F.nullif(known(stats[f"_s{i}"]), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(columns)})


PROPERTIES = ("blur", "resolution", "contrast", "noise", "compression", "brightness", "saturation")


def quality_tiers(df: DataFrame, names: Sequence[str] = ("Low", "Medium", "High")) -> DataFrame:
    """Adds ``quality_score`` and ``quality_bucket`` to rows with the quality properties; corrupt rows are left out.

    The score adds the z-scores of blur, resolution and contrast and takes off those of
    noise and compression and the distance of brightness and saturation from their means.
    Buckets end at exact quantiles, right-closed; where two ends agree all rows get the
    middle name.
    """
    rows = df.where(~F.coalesce("is_corrupt", F.lit(False))).drop("quality_score", "quality_bucket")
    z = zscores(rows, PROPERTIES, True)
    plus = reduce(lambda a, b: a + b, [F.col(f"z_{c}") for c in ("blur", "resolution", "contrast")])
    score = plus - F.col("z_noise") - F.col("z_compression") - F.abs("z_brightness") - F.abs("z_saturation")
    scored = z.withColumn("quality_score", score).drop(*[f"z_{c}" for c in PROPERTIES])
    n = len(names)
    edges = percentiles_of(scored, [], "quality_score", [i / n for i in range(n + 1)]).select(F.array(*[f"p{i}" for i in range(n + 1)]).alias("_q"))
    same = reduce(lambda a, b: a | b, [F.col("_q")[i] == F.col("_q")[i + 1] for i in range(n)])
    tier = F.lit(names[-1])
    for i in range(n - 2, -1, -1):
        tier = F.when(F.col("quality_score") <= F.col("_q")[i + 1], names[i]).otherwise(tier)
    return scored.crossJoin(F.broadcast(edges)).withColumn("quality_bucket", F.when(same, names[n // 2]).otherwise(tier)).drop("_q")


def disparity(df: DataFrame, bucket: str, value: str, bound: float = 0.15) -> DataFrame:
    """``bucket, mean, std, count, max_disparity, flag``: does ``value`` differ between buckets by more than ``bound`` of its mean?"""
    per = df.where(F.col(bucket).isNotNull()).groupBy(F.col(bucket).alias("bucket")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    gap = F.max("mean").over(_all()) - F.min("mean").over(_all())
    return per.select("bucket", "mean", "std", "count", gap.alias("max_disparity"), (gap > bound * (F.abs(F.avg("mean").over(_all())) + 1e-9)).alias("flag"))


def dimension_correlation(df: DataFrame, vec: str, group: str) -> DataFrame:
    """``dim, correlation`` of each vector element with the group's code (rank of the sorted group values, from 0)."""
    codes = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_code", F.dense_rank().over(Window.orderBy(group)) - 1)
    rows = df.join(codes, group).select("_code", F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "x"))
    return rows.groupBy("dim").agg(F.corr("x", "_code").alias("correlation"))
