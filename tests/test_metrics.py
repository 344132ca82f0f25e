import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenaudit.functions.labels import label_key
from lumenaudit.operators import metrics as M
from lumenaudit.operators import repair as R
from lumenaudit.operators import sampling as S
from lumenaudit.operators.skew import _hash_int, balanced_aggregate, fragment_replicate_join, heavy_keys, key_loads, plan_shards, salt_for


def labels(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, label string")


def test_label_key(spark):
    values = [" Red-Dog ", "red dog", "RED_DOG", None, "", " ", "None", "NaN", "unlabeled", "x"]
    got = [r[0] for r in labels(spark, values).orderBy("id").select(label_key("label")).collect()]
    assert got == ["red_dog"] * 3 + [None] * 6 + ["x"]


def test_distribution_and_metrics(spark):
    df = labels(spark, ["a"] * 4 + ["b"] * 2 + ["c"] + ["d"] + [None] * 3)
    assert [tuple(r) for r in M.class_distribution(df, "label").collect()] == [("a", 4, 0.5), ("b", 2, 0.25), ("c", 1, 0.125), ("d", 1, 0.125)]
    r = M.diversity_metrics(df, "label").first()
    assert (r.shannon_entropy, r.gini_index, r.effective_classes) == (1.75, 0.6563, 3.36) or r.gini_index == pytest.approx(0.6562, abs=1e-4)
    assert [r["class"] for r in M.flag_imbalance(df, "label").collect()] == []
    assert [r["class"] for r in M.flag_imbalance(df, "label", 0.6).collect()] == ["c", "d"]
    assert M.balance_status(df, "label").first().balanced is False
    assert M.summarize_imbalance(df, "label").count() == 4


def test_empty_tables(spark):
    df = labels(spark, [])
    assert M.class_distribution(df, "label").count() == 0 and M.flag_imbalance(df, "label").count() == 0
    assert M.diversity_metrics(df, "label").first().shannon_entropy is None
    assert M.value_histogram(df.withColumn("x", F.lit(1.0)), "x").count() == 0
    assert M.group_fairness(df.withColumn("g", F.col("label")), "g", "label").first().available is False


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=30))
def test_proportions_add_up(spark, values):
    assert sum(r.proportion for r in M.class_distribution(labels(spark, list(values)), "label").collect()) == pytest.approx(1)


def groups(spark, rows):
    return spark.createDataFrame(rows, "g string, label string")


def test_parity(spark):
    same = groups(spark, [("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")])
    assert tuple(M.group_parity(same, "g", "label").first()) == (0.0, None, None)
    apart = groups(spark, [("x", "a"), ("y", "b"), ("z", "b"), ("x", None), (None, "a")])
    assert tuple(M.group_parity(apart, "g", "label").first()) == (1.0, "x", "y")
    one = M.group_fairness(groups(spark, [("x", "a")]), "g", "label").first()
    assert (one.available, one.label_distribution_parity) == (False, None)
    assert M.group_distribution(apart, "g", "label").where("proportion = 0").count() == 3


def test_zscores(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    rows = M.zscores(df, ["a", "b"], False).collect()
    assert [r.z_a for r in rows] == [-1.0, 1.0, 0.0] and {r.z_b for r in rows} == {0.0}
    assert M.zscores(df, ["a"], True).first().z_a == pytest.approx(-1 / math.sqrt(2))


def quality(spark, values):
    cols = ", ".join(f"{c} double" for c in M.PROPERTIES)
    return spark.createDataFrame([(i, False, *([float(v)] + [1.0] * 6)) for i, v in enumerate(values)] + [(99, True, *[None] * 7)], f"id long, is_corrupt boolean, {cols}")


def test_tiers(spark):
    got = {r.id: r.quality_bucket for r in M.quality_tiers(quality(spark, range(9))).collect()}
    assert [got[i] for i in range(9)] == ["Low"] * 3 + ["Medium"] * 3 + ["High"] * 3 and 99 not in got
    assert {r.quality_bucket for r in M.quality_tiers(quality(spark, [1, 1, 1, 1, 9])).collect()} == {"Medium"}
    assert M.quality_tiers(quality(spark, [4])).first().quality_score == 0
    d = M.disparity(M.quality_tiers(quality(spark, range(9))), "quality_bucket", "blur").collect()
    assert len(d) == 3 and all(r.flag and r.max_disparity == 6 for r in d)


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 10]] + [(None,), (float("nan"),)], "x double")
    got = {r.bin: r["count"] for r in M.value_histogram(df, "x", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 3: 0, 4: 1}
    assert {r.bin: r["count"] for r in M.value_histogram(df.where("x = 1"), "x", 3).collect()} == {0: 1, 1: 0, 2: 0}


# -- samples ------------------------------------------------------------------------------


def test_split_is_per_label_and_whole(spark):
    df = labels(spark, ["a"] * 95 + ["b"] * 3 + [None] * 5)
    rows = S.stratified_split(df, "id", "label", 0.1).collect()
    assert len(rows) == 103 and sum(r.split == "val" and r.label == "a" for r in rows) == 10 and sum(r.split == "val" and r.label == "b" for r in rows) == 1
    assert not any(r.split == "val" and r.label is None for r in rows)
    order = [r.id for r in S.shuffled(df.where("label = 'a'"), "id").collect()][:10]
    assert {r.id for r in rows if r.split == "val" and r.label == "a"} == set(order)
    assert [r.id for r in S.shuffle_positions(df, "id").orderBy("position").collect()] == [r.id for r in S.shuffled(df, "id").collect()]


def test_rebalance(spark):
    df = labels(spark, ["a"] * 10 + ["b"] * 4 + ["c"] * 2 + [None])
    n = {r.label: r["count"] for r in S.rebalance(df, "id", "label").groupBy("label").count().collect()}
    assert n == {"a": 10, "b": 10, "c": 10, None: 1}
    n = {r.label: r["count"] for r in S.rebalance(df, "id", "label", "minmax").groupBy("label").count().collect()}
    assert n == {"a": 10, "c": 10}
    even = labels(spark, ["a"] * 3 + ["b"] * 3)
    assert S.rebalance(even, "id", "label").count() == 6
    assert S.rebalance(even.limit(0), "id", "label").count() == 0
    with pytest.raises(ValueError):
        S.rebalance(df, "id", "label", "other")


def test_repairs(spark):
    def say(metrics):
        text = json.dumps({"metrics": metrics}) if metrics is not None else None
        return R.repair_suggestions(spark.createDataFrame([(text,)], "report string")).first().suggestions

    assert say({"class_distribution": {"a": 1, "b": 1}}) == ["The dataset looks balanced."]
    assert say({"class_distribution": {"a": 4, "b": 2}})[0].startswith("Balance classes")
    assert say({"group_analysis": {"available": True, "label_distribution_parity": 0.3}})[0].startswith("Review groups")
    assert say({"group_analysis": {"available": False, "robustness_flag": True}})[0].startswith("Improve")
    assert say({"high_influence_count": 2}) == ["Review 2 samples of high influence."]
    assert say(None)[0].startswith("error") and R.repair_suggestions(spark.createDataFrame([("{bad",)], "report string")).first().suggestions[0].startswith("error")


# -- skew ----------------------------------------------------------------------------------


def skewed(spark):
    rows = [(i, "hot" if i < 600 else f"k{i % 40}" if i < 990 else None, i % 7, "l") for i in range(1000)]
    return spark.createDataFrame(rows, "id long, key string, x int, name string").repartition(3)


def test_plan_packs_shards_evenly(spark):
    plan = plan_shards(key_loads(skewed(spark), "key"), 8).collect()
    hot = next(r for r in plan if r.key == "hot")
    assert hot.shards >= 5 and len(set(hot.salts)) == hot.shards
    df = spark.createDataFrame([(s,) for s in hot.salts], "s int")
    tasks = [r[0] for r in df.select(F.pmod(F.hash(F.lit("hot"), F.col("s")), F.lit(8))).collect()]
    assert len(set(tasks)) >= 5 and max(tasks.count(t) for t in tasks) <= 2  # Spark's own hash spreads the shards
    assert plan_shards(key_loads(skewed(spark).limit(0), "key"), 8).count() == 0


def test_salts_undo_the_hash():
    rng = np.random.default_rng(0)
    hashed, seed = rng.integers(0, 1 << 31, 1000), rng.integers(-(1 << 31), 1 << 31, 1000)
    assert (_hash_int(salt_for(hashed, seed), seed) == hashed).all()


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_rows_of_tasks_are_even(spark, adaptive):
    """A third of the rows has one key: with a right side too large to broadcast, no task joins much more than its share."""
    was = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 5 == 0, F.lit("warm")).otherwise(F.concat(F.lit("k"), F.col("id") % 997))
        left = spark.range(60_000).select(key.alias("key"), F.col("id").alias("row"))
        right = left.select("key").distinct().withColumn("weight", F.length("key"))
        for spread_by in ((), ("row",)):
            joined = fragment_replicate_join(left, right, "key", tasks=16, spread_by=spread_by)
            per = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect()]
            assert sum(per) == 60_000 and len(per) == 16 and max(per) < 1.3 * 60_000 / 16
        plain = [r["count"] for r in left.repartition(16, "key").join(right.repartition(16, "key"), "key").groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert max(plain) > 5 * 60_000 / 16
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was[1])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_plain_join(spark, how):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1, "a"), ("hot", 2, "b"), ("k3", 3, "c"), (None, 4, "d"), ("zz", 5, "e")], "key string, x int, name string")
    got = fragment_replicate_join(left, right, "key", how, tasks=8)
    plain = left.join(right.withColumnRenamed("x", "x_right").withColumnRenamed("name", "name_right"), "key", how)
    cols = plain.columns
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, plain.collect()))
    with pytest.raises(ValueError):
        fragment_replicate_join(left, right, "key", "full")


def test_aggregate_and_heavy_keys(spark):
    df = skewed(spark)
    got = balanced_aggregate(df, "key", [F.sum("x").alias("s"), F.count("*").alias("n")], [F.sum("s").alias("s"), F.sum("n").alias("n")], tasks=8)
    want = df.groupBy("key").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r.key, r.load) for r in heavy_keys(df, "key", 0.01).collect()} == {("hot", 600), (None, 10)} | {(r.key, r["count"]) for r in df.where("key like 'k%'").groupBy("key").count().where("count >= 10").collect()}
    assert heavy_keys(df.limit(0), "key", 0.1).count() == 0


def test_label_report_has_every_row(spark, sf):
    import __spark_entry__ as entry

    out = entry.queries()["p7_labels"](spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/quality_scores.parquet")
    assert sum(r.n_rows for r in out) == rows.count()
    assert sum(r.label is None for r in out) == 1 and any(r.label is not None and r.target_share is None for r in out)


def test_no_aggregate_gathers_a_column(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", float(i * 7 % 50)) for i in range(200)] + [(None, 1.0), ("a", None)], "g string, v double")
    out = M.group_quantiles(rows, "g", "v")
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {r.g: (r.n, r.a, r.b) for r in rows.where("g is not null and v is not null").groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.75).alias("b")).collect()}
    assert {r.g: (r.n, r.q25, r.q75) for r in out.collect()} == want
    assert M.group_quantiles(rows.limit(0), "g", "v").count() == 0
