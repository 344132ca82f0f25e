"""Exact percentiles per group by a full distributed sort.

The input is a table ``*group, value, n``: how often each value occurs, summed partially
before the shuffle. It is sorted by group and value over as many partitions as its rows
need; every sorted partition counts its rows per group, running sums over the partitions
give each group's offsets, the wanted positions are located by offset, and the
neighbouring order statistics are interpolated. A hot group spans many partitions, and no
task holds all values of a group or column, as an aggregate with a list of values would.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import cut, parallelism

#: Rows of the counted table that one sorted partition should hold.
TASK_ROWS = 1_000_000


def value_counts(df: DataFrame, group: Sequence[str], value: Column | str) -> DataFrame:
    """``*group, value, n``: how often each value occurs. Null and NaN values are left out; null group values are groups. Group columns must not be named like the result's own."""
    if {"value", "n"} & set(group):
        raise ValueError("group columns cannot be named value or n")
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    # -0.0 and 0.0 are one value
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*group, (v + F.lit(0.0)).alias("value")).agg(F.count("*").alias("n"))


def group_code(group: Sequence[str]) -> Column:
    """64 bits that tell neighbouring groups apart; where the nulls are counts, so (null, a) and (a, null) differ."""
    return F.xxhash64(F.lit(0), *[x for c in group for x in (F.col(c).isNull(), F.col(c))])


def counted_percentiles(counts: DataFrame, fractions: Sequence[float], partitions: int | None = None) -> DataFrame:
    """``*group, n_values, fraction, percentile`` of a table ``*group, value, n``: linearly interpolated, one row per group and fraction.

    Position ``fraction * (n - 1)`` counted from 0, between its neighbours in proportion.
    Groups without values are absent; an empty table gives an empty result; infinite
    values take their place in the order; null group values are groups like any other.
    """
    names = [c for c in counts.columns if c not in ("value", "n")]
    # group columns may have any name: inside they are numbered
    group = [f"_group{i}" for i in range(len(names))]
    counts = counts.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(names, group)], "value", "n")
    bad = [f for f in fractions if not 0 <= f <= 1]
    if bad:
        raise ValueError(f"fractions must lie in 0..1: {bad}")
    kinds = ", ".join(f"{c} {t}" for c, t in counts.select(*group).dtypes)
    held = cut(counts, "values")
    parts = partitions or max(parallelism(counts.sparkSession), -(-held.count() // TASK_ROWS))
    ordered = held.withColumn("_g", group_code(group)).repartitionByRange(parts, *group, "value").sortWithinPartitions(*group, "value")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds to each row the count of its group up to it within this partition."""
        part = TaskContext.get().partitionId()
        last, had = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, n = b.column(b.num_columns - 1).to_numpy(), b.column(b.num_columns - 2).to_numpy()
            start = np.r_[True, g[1:] != g[:-1]]
            total = np.cumsum(n)
            base = np.where(start, total - n, 0)
            upto = total - np.maximum.accumulate(base)
            if g[0] == last:
                upto[: np.flatnonzero(start)[1] if start.sum() > 1 else len(g)] += had
            last, had = g[-1], int(upto[-1])
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(g), part, np.int32)), pa.array(upto)], names=[*b.schema.names[:-1], "_part", "_upto"])

    # written once: the borders of a range sort must not be drawn twice
    kept = cut(ordered.mapInArrow(running, f"{kinds + ', ' if kinds else ''}value double, n long, _part int, _upto long"), "sorted")
    per = kept.groupBy(*group, "_part").agg(F.max("_upto").alias("_c"))
    key = group or [F.lit(1)]
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*group, "_part", "_c", F.coalesce(F.sum("_c").over(before), F.lit(0).cast("long")).alias("_off"), F.sum("_c").over(Window.partitionBy(*key)).alias("_n"))
    # the order statistics that are wanted, each with the one partition that holds it
    at = [(F.lit(float(f)) * (F.col("_n") - 1)).alias("at") for f in fractions]
    wanted = F.array(*[F.struct(F.lit(float(f)).alias("f"), a) for f, a in zip(fractions, at)])
    asked = offsets.select(*group, "_part", "_c", "_off", "_n", F.explode(wanted).alias("w")).select("*", F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("_i"))
    asked = asked.where((F.col("_off") <= F.col("_i")) & (F.col("_i") < F.col("_off") + F.col("_c")))
    left, right = kept.alias("l"), asked.alias("r")
    same = F.col("l._part") == F.col("r._part")
    for c in group:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    place = F.col("r._i") - F.col("r._off")
    found = left.join(right, same & (F.col("l._upto") - F.col("l.n") <= place) & (place < F.col("l._upto"))).select(*[F.col(f"r.{c}").alias(c) for c in group], "value", "w", "_n", "_i")
    low = F.max(F.when(F.col("_i") == F.floor("w.at"), F.col("value")))
    high = F.max(F.when(F.col("_i") == F.ceil("w.at"), F.col("value")))
    out = found.groupBy(*group, F.col("w.f").alias("fraction")).agg(F.first("_n").alias("n_values"), F.first("w.at").alias("_at"), low.alias("_low"), high.alias("_high"))
    step = F.col("_at") - F.floor("_at")
    value = F.when((step == 0) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * step)
    return out.select(*[F.col(g).alias(c) for c, g in zip(names, group)], "n_values", "fraction", value.alias("percentile"))


def percentiles_of(df: DataFrame, group: Sequence[str], value: Column | str, fractions: Sequence[float]) -> DataFrame:
    """``*group`` and one column ``p0, p1, ...`` per fraction, in their order; one row per group that has values."""
    fractions = list(fractions)
    each = counted_percentiles(value_counts(df, group, value), sorted(set(fractions)))
    return each.groupBy(*group).agg(*[F.max(F.when(F.col("fraction") == float(f), F.col("percentile"))).alias(f"p{i}") for i, f in enumerate(fractions)])
