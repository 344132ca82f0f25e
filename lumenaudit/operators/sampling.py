"""Deterministic samples, splits, shuffles and rebalancing: order by the MD5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int, *key: str) -> Column:
    """Text that orders rows as if shuffled, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement."""
    return df.orderBy(hash_key(seed, key), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in an order that looks random (a range sort, no single task)."""
    return df.orderBy(hash_key(seed, key), key)


def shuffle_positions(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``position``, from 0, in the shuffled order: counts of the hash's first three digits give offsets, parts are numbered apart. ``key`` must be unique."""
    rows = df.withColumn("_h", hash_key(seed, key)).withColumn("_b", F.substring("_h", 1, 3))
    # no more than 4096 parts
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", before.alias("_s"))
    order = Window.partitionBy("_b").orderBy("_h", key)
    return rows.withColumn("_r", F.row_number().over(order)).join(F.broadcast(starts), "_b").select(*df.columns, (F.col("_s") + F.col("_r") - 1).alias("position"))


def stratified_split(df: DataFrame, key: str, label: str, fraction: float = 0.1, seed: int = 42, buckets: int = 256) -> DataFrame:
    """Adds ``split``: of each label the ``ceil(fraction * n)`` rows of smallest hash are ``val``; all others, and unlabelled rows, ``train``.

    A label's rows are divided by the first two digits of the hash; running counts tell
    which parts belong to ``val`` and only the part at the edge is ordered, so a label
    that holds most rows is not ordered in one task. ``key`` must be unique.
    """
    rows = df.withColumn("_h", hash_key(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    per = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_l"), "_b").agg(F.count("*").alias("_c"))
    part = Window.partitionBy("_l")
    before = F.coalesce(F.sum("_c").over(part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_l", F.col("_b").alias("_lb"), before.alias("_before"), F.ceil(F.sum("_c").over(part) * fraction).alias("_quota"))
    joined = rows.join(per, (F.col(label) == F.col("_l")) & (F.col("_b") == F.col("_lb")), "left")
    need = F.col("_before") < F.col("_quota")
    order = Window.partitionBy(label, "_b").orderBy("_h", key)
    edge = joined.where(need).withColumn("_r", F.row_number().over(order)).withColumn("split", F.when(F.col("_before") + F.col("_r") <= F.col("_quota"), "val").otherwise("train"))
    rest = joined.where(~F.coalesce(need, F.lit(False))).withColumn("split", F.lit("train"))
    return edge.select(*df.columns, "split").unionByName(rest.select(*df.columns, "split"))


def rebalance(df: DataFrame, key: str, label: str, mode: str = "all", bound: float = 1.5, seed: int = 42) -> DataFrame:
    """Adds rows (``copy`` > 0) until classes are as large as the largest, when counts differ by more than ``bound``.

    ``mode='all'`` raises every class; ``mode='minmax'`` keeps the largest and the smallest
    class only, as two-class repairs do. Copies are dealt evenly: copy ``i`` of a class
    repeats its rows in hash order. Unlabelled rows are kept once in mode ``all``. Balanced
    input comes back unchanged with ``copy`` 0. ``key`` must be unique.
    """
    if mode not in ("all", "minmax"):
        raise ValueError(f"mode={mode!r}: all or minmax")
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_c"))
    ends = counts.agg(F.max("_c").alias("_max"), F.min("_c").alias("_min"), F.min_by("_l", F.struct(-F.col("_c"), "_l")).alias("_big"), F.min_by("_l", F.struct("_c", "_l")).alias("_small"))
    # one row per class, sent to all tasks only as large as the list of classes
    plan = counts.crossJoin(F.broadcast(ends)).withColumn("_act", F.col("_max") > bound * F.col("_min"))
    rows = df.join(plan, F.col(label) == F.col("_l"), "left")
    if mode == "minmax":
        rows = rows.where(~F.coalesce("_act", F.lit(False)) | F.col("_l").isin(F.col("_big"), F.col("_small")))
        rows = rows.where(F.col("_l").isNotNull())
    short = F.coalesce("_act", F.lit(False)) & (F.col("_c") < F.col("_max"))
    same = rows.where(~short).withColumn("copy", F.lit(0))
    # only classes below the largest are numbered, in parts of the hash: counts of the parts before give each part's start
    few = rows.where(short).withColumn("_h", hash_key(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = few.groupBy("_l", "_b").agg(F.count("*").alias("_n")).select("_l", "_b", before.alias("_s"))
    order = Window.partitionBy("_l", "_b").orderBy("_h", key)
    few = few.join(starts, ["_l", "_b"]).withColumn("_r", F.col("_s") + F.row_number().over(order))
    times = (F.floor(F.col("_max") / F.col("_c")) + F.when(F.col("_r") <= F.col("_max") % F.col("_c"), 1).otherwise(0)).cast("int")
    more = few.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    return same.select(*df.columns, "copy").unionByName(more.select(*df.columns, "copy"))
