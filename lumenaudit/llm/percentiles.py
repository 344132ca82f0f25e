"""Exact percentiles per group over very many values, in a form that can be combined.

A state is the exact table ``group, value, n``: partial counts are summed before the
shuffle, states of other days or files are combined by adding their counts. Percentiles
come from a full distributed sort of the state by group and value with per-partition
counts, offsets of each group and interpolation of neighbouring order statistics (the
core's ``order_statistics``, which the quality operators share). The error is zero. A hot
group spans many partitions, a value that a third of all rows repeat is one row of the
state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.operators.order_statistics import counted_percentiles, value_counts


def percentile_state(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``*group, value, n``: how often each value occurs. Null and NaN values are left out; null group values are groups. Group columns must not be named like the state's own."""
    return value_counts(df, group, value)


def combine_states(first: DataFrame, *more: DataFrame) -> DataFrame:
    """The state of all rows behind several states of the same groups."""
    for s in more:
        first = first.unionByName(s)
    group = [c for c in first.columns if c not in ("value", "n")]
    return first.groupBy(*group, "value").agg(F.sum("n").alias("n"))


def regroup_state(state: DataFrame, group: Sequence[str]) -> DataFrame:
    """The state by fewer group columns, as from days to all time."""
    return state.groupBy(*group, "value").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, fractions: Sequence[float], partitions: int | None = None) -> DataFrame:
    """``*group, n_values, fraction, percentile``: linearly interpolated, one row per group and fraction.

    Groups without values are absent; an empty state gives an empty result; infinite
    values take their place in the order; null group values are groups of their own, also
    where several columns hold nulls. ``partitions``: of the sort, by default as many as
    the state's rows need.
    """
    return counted_percentiles(state, fractions, partitions)
