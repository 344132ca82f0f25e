"""Per-key work without imbalance: fragment-replicate by estimated load.

Loads are exact counts per key, summed partially before the shuffle. Keys above half of a
task's fair share are split in proportionate shards, large keys and shards are packed on
tasks (longest first on the least loaded task), the many small keys stay with the hash.
The placement uses Spark's own hash partitioning: the hash is inverted, which gives for
every shard the salt whose hash with the key falls on the wanted task, so joins and
aggregates on ``(key, salt)`` need no special partitioner. Both sides are partitioned
explicitly into ``tasks`` parts, which adaptive execution leaves as they are. Only keys of
notable load enter the plan, and there cannot be more than ``tasks * detail`` of those,
which bounds what is broadcast.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import parallelism

DETAIL = 32
SALT, SHARDS, ROW = "_salt", "_salts", "_row"


def key_loads(df: DataFrame, key: Column | str) -> DataFrame:
    """``key, load``: rows of each key (null keys included as a key of their own)."""
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count("*").alias("load"))


def _hash_int(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Murmur3 (x86, 32 bit) of one int each, as hash partitioning applies it."""
    u = np.uint32
    with np.errstate(over="ignore"):
        k = value.astype(u) * u(0xCC9E2D51)
        k = ((k << u(15)) | (k >> u(17))) * u(0x1B873593)
        h = seed.astype(np.int32).view(u) ^ k
        h = ((h << u(13)) | (h >> u(19))) * u(5) + u(0xE6546B64)
        h ^= u(4)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        return (h ^ (h >> u(16))).view(np.int32)


def _inverse(odd: int) -> np.uint32:
    return np.uint32(pow(odd, -1, 1 << 32))


def salt_for(hashed: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The int whose hash with this seed is ``hashed``: every step of the hash undone, last first."""
    u = np.uint32
    with np.errstate(over="ignore"):
        h = hashed.astype(np.int64).astype(u)
        h ^= h >> u(16)
        h *= _inverse(0xC2B2AE35)
        h ^= (h >> u(13)) ^ (h >> u(26))
        h *= _inverse(0x85EBCA6B)
        h ^= h >> u(16)
        h ^= u(4)
        h = (h - u(0xE6546B64)) * _inverse(5)
        h = (h >> u(13)) | (h << u(19))
        k = (h ^ seed.astype(np.int32).view(u)) * _inverse(0x1B873593)
        k = ((k >> u(15)) | (k << u(17))) * _inverse(0xCC9E2D51)
        return k.view(np.int32)


def plan_shards(loads: DataFrame, tasks: int, detail: int = DETAIL, slack: float = 0.5) -> DataFrame:
    """``key, load, shards, salts``: the keys that are placed, with the salt of each shard.

    A key of more than ``slack * total / tasks`` rows is split in shards of no more; a key of more than
    ``total / (tasks * detail)`` rows is packed; all others are left to the hash with salt 0.
    Empty loads give an empty plan.
    """
    spark = loads.sparkSession
    kind = loads.schema["key"].dataType.simpleString()
    schema = f"key {kind}, load long, shards int, salts array<int>"
    total = loads.agg(F.sum("load")).first()[0] or 0
    fair, least = max(1.0, slack * total / tasks), total / (tasks * detail)
    # at most tasks * detail keys can have that load
    notable = loads.where(F.col("load") > least).select("key", "load", F.hash("key").alias("h")).orderBy(F.desc("load"), "key").collect()
    pieces = []
    for n, row in enumerate(notable):
        shards = math.ceil(row["load"] / fair)
        pieces += [(row["load"] / shards, n)] * shards
    heap = [((total - sum(r["load"] for r in notable)) / tasks, t) for t in range(tasks)]
    heapq.heapify(heap)
    targets: dict[int, list[int]] = {}
    for load, n in sorted(pieces, key=lambda p: -p[0]):
        had, task = heapq.heappop(heap)
        targets.setdefault(n, []).append(task)
        heapq.heappush(heap, (had + load, task))
    plan = []
    for n, row in enumerate(notable):
        # the j-th shard of a key on one task takes the j-th hash that falls there
        used: dict[int, int] = {}
        hashes = []
        for task in targets[n]:
            hashes.append(task + tasks * used.get(task, 0))
            used[task] = used.get(task, 0) + 1
        salts = salt_for(np.array(hashes, np.int64), np.full(len(hashes), row["h"]))
        plan.append((row["key"], row["load"], len(hashes), salts.tolist()))
    return spark.createDataFrame(plan, schema)


def _salted(df: DataFrame, plan: DataFrame, key: str, replicate: bool, spread_by: Sequence[str] = ()) -> DataFrame:
    small = plan.select(F.col("key").alias("_key"), F.col("salts").alias(SHARDS))
    # the plan has at most tasks * detail rows
    out = df.join(F.broadcast(small), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    salts = F.coalesce(SHARDS, F.array(F.lit(0)))
    if replicate:
        return out.withColumn(SALT, F.explode(salts)).drop(SHARDS)
    # hashed: the rows of a key may come at regular distances
    number = F.xxhash64(*(spread_by or [F.monotonically_increasing_id()]))
    return out.withColumn(SALT, F.get(salts, F.pmod(number, F.size(salts)).cast("int"))).drop(SHARDS)


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", tasks: int | None = None, plan: DataFrame | None = None, spread_by: Sequence[str] = ()) -> DataFrame:
    """Equi-join on ``key`` whose left side may hold a few keys with most of the rows.

    The left side's rows of a large key are dealt over its shards, the right side's rows
    of that key are copied to those shards only. ``how`` is ``inner``, ``left``,
    ``left_semi`` or ``left_anti``. Null keys match nothing. Both sides may hold further
    columns of the same name; those of the right side get the suffix ``_right``.

    ``spread_by``: columns of the left side whose hash deals its rows to shards, such as a
    row's id; a task that runs again then deals them alike. Without it rows are dealt by
    their number in their task, and the left side should come from a scan or a written
    table.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how={how!r}: the right side's rows are copied, so only inner and left joins keep their meaning")
    tasks = tasks or parallelism(left.sparkSession)
    plan = plan_shards(key_loads(left, key), tasks) if plan is None else plan
    clash = (set(left.columns) & set(right.columns)) - {key}
    right = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    a = _salted(left, plan, key, False, spread_by).repartition(tasks, key, SALT)
    b = _salted(right, plan, key, True).repartition(tasks, key, SALT)
    return a.join(b, [key, SALT], how).drop(SALT)


def balanced_aggregate(df: DataFrame, key: str, partial: Sequence[Column], final: Sequence[Column], tasks: int | None = None, spread_by: Sequence[str] = ()) -> DataFrame:
    """Per-key aggregates in two steps: per shard with ``partial``, per key with ``final``.

    For aggregates whose partial state Spark cannot shrink before the shuffle, a large
    key's rows are still spread over its shards. Null keys are one group. ``spread_by`` as
    in ``fragment_replicate_join``.
    """
    tasks = tasks or parallelism(df.sparkSession)
    plan = plan_shards(key_loads(df, key), tasks)
    return _salted(df, plan, key, False, spread_by).repartition(tasks, key, SALT).groupBy(key, SALT).agg(*partial).groupBy(key).agg(*final)


def heavy_keys(df: DataFrame, key: str, share: float, tasks: int | None = None) -> DataFrame:
    """``key, load, share, shards``: keys with at least ``share`` of all rows, and how they are split."""
    tasks = tasks or parallelism(df.sparkSession)
    loads = key_loads(df, key)
    plan = plan_shards(loads, tasks, detail=max(DETAIL, math.ceil(1 / (share * tasks)) + 1))
    counted = _salted(df.select(key), plan, key, False).groupBy(key, SALT).agg(F.count("*").alias("n")).groupBy(F.col(key).alias("key")).agg(F.sum("n").alias("load"), F.count("*").alias("shards"))
    total = df.select(F.count("*").alias("total"))
    return counted.join(F.broadcast(total)).where(F.col("load") >= share * F.col("total")).select("key", "load", (F.col("load") / F.col("total")).alias("share"), "shards")
