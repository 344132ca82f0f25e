import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenaudit.llm.flow import Network
from lumenaudit.functions.groups import Groups
from lumenaudit.llm.near_duplicates import Incidence, name_tokens, near_duplicate_groups, pairs_of_groups, set_links
from lumenaudit.llm.percentiles import combine_states, percentile_state, percentiles, regroup_state
from lumenaudit.llm.quota_sample import cell_quotas, sample_by_targets
from lumenaudit.operators.components import connected_components


def joined(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


# -- near duplicates --------------------------------------------------------------------


def test_name_tokens(spark):
    cases = {"/a/b/Red-Dog_12.final.jpg": ["red", "dog", "12", "final"], "x.png": ["x"], "": [], "/a/.hidden": [], "a a A.b.c": ["a", "b"], "/p/noext": ["noext"]}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "path string")
    out = {r.path: r.t for r in df.select("path", name_tokens(F.col("path")).alias("t")).collect()}
    assert all(out[k] == v for k, v in cases.items()) and out[None] is None


@pytest.mark.parametrize("chunk", [8192, 4])
def test_set_links_join_what_brute_force_joins(spark, chunk):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    sets = []
    for _ in range(25):
        base = list(rng.choice(words, 7, replace=False))
        sets += [base]
        for _ in range(int(rng.integers(0, 6))):
            edit = list(base)
            edit[int(rng.integers(7))] = f"n{rng.integers(5)}"
            sets += [edit[: int(rng.integers(5, 8))]]
    sets += [sets[0]] * 30 + [[]] * 3 + [None] * 2
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, t array<string>")
    comp = {r.node: r.root for r in connected_components(set_links(df, "id", "t", 0.75, chunk_rows=chunk)).collect()}
    real = [set(s or []) for s in sets]
    edges = [(i, j) for i, j in combinations(range(len(sets)), 2) if real[i] and real[j] and len(real[i] & real[j]) >= 0.75 * len(real[i] | real[j])]
    want = joined(len(sets), edges)
    assert all(comp.get(i, i) == want[i] for i in range(len(sets)))


def test_products_of_incidence():
    rng = np.random.default_rng(0)
    for _ in range(5):
        sets = []
        for _ in range(30):
            base = set(rng.integers(0, 50, int(rng.integers(3, 9))).tolist())
            sets.append(base)
            for _ in range(int(rng.integers(0, 4))):
                sets.append((base - {int(rng.choice(list(base)))}) | {int(rng.integers(50))})
        inc = Incidence(pa.array([sorted(x) for x in sets], pa.list_(pa.int64())))
        n = len(sets)
        near = lambda pairs: joined(n, [(i, j) for i, j in pairs if i != j and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])])
        whole, halves, small = Groups(n), Groups(n), Groups(n)
        inc.join(whole, np.arange(n), None, 0.75)
        inc.join(halves, np.arange(0, n, 2), np.arange(1, n, 2), 0.75)
        post = [rng.choice(n, int(k), replace=False) for k in rng.integers(1, 20, 6)]
        inc.join_small(small, np.concatenate(post), np.r_[0, np.cumsum([len(p) for p in post])], 0.75)
        assert whole.label.tolist() == near(combinations(range(n), 2))
        assert halves.label.tolist() == near([(i, j) for i in range(0, n, 2) for j in range(1, n, 2)])
        assert small.label.tolist() == near([x for p in post for x in combinations(p.tolist(), 2)])


def test_a_hot_token_stays_small():
    import tracemalloc

    rng = np.random.default_rng(1)
    rows = 6000
    lists = np.concatenate([np.zeros((rows, 1), np.int64), rng.integers(10, 900, (rows, 6)).cumsum(1)], 1)
    inc = Incidence(pa.array(lists.tolist(), pa.list_(pa.int64())))
    tracemalloc.start()
    inc.join(Groups(rows), np.arange(rows), None, 0.75)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20


def test_groups_by_both_links(spark):
    rec = "vec_id long, path string, label string, embedding string, group_id int"
    names = ["/a/cat one two three four.jpg", "/b/CAT-one-two-three-four.png", "/c/x1.jpg", "/c/x2.jpg", None, "/d/.jpg", "/e/alone.jpg"]
    records = spark.createDataFrame([(i, p, "l", "e", 0) for i, p in enumerate(names)] + [(0, "/a/cat one two three four.jpg", "m", "e", 0), (None, "/q/x.jpg", "", "", 1)], rec)
    v = {1: [1.0, 0, 0, 0.1], 2: [1.0, 0, 0, 0.2], 4: [0, 1.0, 0, 0], 5: [0, 2.0, 0.1, 0], 6: [0, 0, 1.0, 0], 99: [0, 0, 1.0, 0.01], 3: [0.0] * 4}
    vectors = spark.createDataFrame([(i, [float(y) for y in x], "z") for i, x in v.items()] + [(1, None, "z"), (2, [1.0], "z"), (1, [float("nan"), 0.0, 0.0, 0.0], "z"), (2, [0.0] * 4, "z")], "vec_id long, embedding array<float>, size string")
    got = near_duplicate_groups(records, vectors, dim=4)
    assert {(r.vec_id, r.group_id, r.size) for r in got.collect()} == {(0, 0, 3), (1, 0, 3), (2, 0, 3), (4, 4, 2), (5, 4, 2)}
    for rows in (4096, 1):
        pairs = [tuple(r) for r in pairs_of_groups(got, rows).collect()]
        assert sorted(pairs) == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert near_duplicate_groups(records.limit(0), vectors.limit(0), dim=4).count() == 0
    assert {r.vec_id for r in near_duplicate_groups(records, dim=4).collect()} == {0, 1}


# -- percentiles ------------------------------------------------------------------------

VALUES = [1.0, 2.0, 2.0, -5.5, 1e300, -0.0, 0.0, float("inf"), None, float("nan"), 3.25]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 2), st.sampled_from(VALUES)), max_size=60))
def test_percentiles_match_numpy(spark, rows):
    df = spark.createDataFrame(rows, "g string, d int, x double")
    state = percentile_state(df, ["g", "d"], "x")
    fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
    for group, got in ((("g", "d"), percentiles(state, fractions)), (("g",), percentiles(regroup_state(state, ["g"]), fractions))):
        want = {}
        for r in rows:
            if r[2] is not None and r[2] == r[2]:
                want.setdefault(r[: len(group)], []).append(r[2])
        found = {(tuple(x[g] for g in group), x.fraction): (x.n_values, x.percentile) for x in got.collect()}
        assert len(found) == len(want) * len(fractions)
        for key, values in want.items():
            v = sorted(values)
            for f in fractions:
                at = f * (len(v) - 1)
                lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
                exact = lo if lo == hi or at == int(at) else lo + (hi - lo) * (at - int(at))
                assert found[key, f] == (len(v), pytest.approx(exact))


def test_states_of_days_combine(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("n"), (F.col("id") * 7 % 101).cast("double").alias("value"), F.lit("x").alias("_part"))
    df = df.withColumnRenamed("n", "group")
    whole = percentile_state(df, ["group"], "value")
    parts = [percentile_state(df.where(c), ["group"], "value") for c in ("value < 30", "value >= 30 and value < 60", "value >= 60")]
    a, b = percentiles(whole, [0.25, 0.5]), percentiles(combine_states(*parts), [0.25, 0.5], partitions=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        percentiles(whole, [1.5])


def test_null_groups_stay_apart(spark):
    rows = [(None, "a", float(i)) for i in range(5)] + [("a", None, 10.0 + i) for i in range(5)] + [(None, None, 99.0), ("a", "a", 7.0)]
    df = spark.createDataFrame(rows, "g string, h string, x double").coalesce(1)
    got = {(r.g, r.h, r.fraction): (r.n_values, r.percentile) for r in percentiles(percentile_state(df, ["g", "h"], "x"), [0.0, 0.5], partitions=1).collect()}
    assert got == {
        (None, "a", 0.0): (5, 0.0), (None, "a", 0.5): (5, 2.0), ("a", None, 0.0): (5, 10.0), ("a", None, 0.5): (5, 12.0),
        (None, None, 0.0): (1, 99.0), (None, None, 0.5): (1, 99.0), ("a", "a", 0.0): (1, 7.0), ("a", "a", 0.5): (1, 7.0),
    }


# -- quotas -----------------------------------------------------------------------------


def test_flow_is_of_least_cost():
    net = Network()
    cheap, dear = net.arc("s", "a", 5, 1), net.arc("s", "b", 5, 3)
    net.arc("a", "t", 3), net.arc("b", "t", 9), net.arc("a", "b", 9, 1)
    assert net.send("s", "t") == (10, 3 * 1 + 2 * 2 + 5 * 3)
    assert (net.flow(cheap), net.flow(dear)) == (5, 5)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), st.integers(0, 40)), st.integers(0, 100), st.integers(0, 5))
def test_quotas(cells, size, seed):
    targets = {"a": (0.5, 3), "b": (0.3, 0), "c": (0.2, 12)}
    quota, short = cell_quotas(cells, targets, size, seed)
    for c, (share, least) in targets.items():
        have, want = sum(n for (a, _), n in cells.items() if a == c), int(np.ceil(max(least, share * size)))
        assert sum(q for (a, _), q in quota.items() if a == c) >= min(have, least)
        assert short[c] == max(0, want - have)
    assert all(0 <= q <= cells[c] for c, q in quota.items())
    # the size is kept, unless the floors need more or there is less
    have = {c: sum(n for (a, _), n in cells.items() if a == c) for c in targets}
    floors = sum(min(have[c], least) for c, (_, least) in targets.items())
    assert sum(quota.values()) == max(floors, min(size, sum(have.values())))
    drawn = {c: sum(q for (a, _), q in quota.items() if a == c) for c in targets}
    free = [c for c, (_, least) in targets.items() if least < drawn[c] < have[c]]
    for c in free:
        # categories that neither lack records nor stand on their floor keep their proportions
        assert all(abs(drawn[c] * targets[o][0] - drawn[o] * targets[c][0]) <= 1.01 for o in free)


def test_sample(spark):
    rows = [(i, "a" if i < 60 else "B-x " if i < 80 else None if i < 90 else "c", i % 2, i, i) for i in range(100)]
    rows += [(0, "c", 1, 999, 0), (None, "a", 1, 1, 1), (1, "a", 0, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, label string, k int, scanned_at int, arrived_at int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b_x", 0.25, 25), ("c", 0.25, 0), ("zzz", 0.0, 2), (None, 1.0, 1)], "label string, target_share double, min_rows int")
    sample, report = sample_by_targets(df, targets, F.col("k").cast("string"), 0.4)
    got = {r.label: r for r in report.collect()}
    assert (got["a"].available, got["a"].wanted, got["a"].shortfall) == (59, 20, 0) and got["a"].drawn in (13, 14)
    assert (got["b_x"].drawn, got["b_x"].shortfall, got["zzz"].shortfall) == (20, 5, 2) and got["c"].drawn in (6, 7)
    rows = sample.collect()
    assert len({r.vec_id for r in rows}) == len(rows) == 40
    even = sum(1 for r in rows if r.label == "a" and r.cross == "0")
    assert 5 <= even <= 9
    empty, none = sample_by_targets(df.limit(0), targets, F.lit("x"))
    assert empty.count() == 0 and none.where("shortfall > 0").count() == 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (None, 3), (6001, 6000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(80)) and got[6001] == 6000 and 5000 not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pattern_of_tokens_matches_the_plain_reading():
    assert re.findall("[a-z0-9]+", "a-b_c1") == ["a", "b", "c1"]


@pytest.mark.parametrize("chunk_rows", [40_960, 300])
def test_vector_links_are_whole_at_any_number_of_rows(spark, monkeypatch, chunk_rows):
    from lumenaudit.functions.vectors import unit
    from lumenaudit.llm import near_duplicates

    # pairs just above and below the bound; at the cells of a large table some of them share none
    rng = np.random.default_rng(5)
    a = unit(rng.normal(size=(400, 128)))
    turn = rng.normal(size=(400, 128))
    turn = unit(turn - (turn * a).sum(1, keepdims=True) * a)
    cos = np.where(np.arange(400) % 4 == 0, 0.947, 0.953)[:, None]
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * turn, a[:50] * 3]).astype(np.float32)
    if hasattr(near_duplicates, "cell_shape"):
        monkeypatch.setattr(near_duplicates, "cell_shape", lambda *_: (128, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<float>")
    links = near_duplicates.vector_links(df, "vec_id", "v", 128, 0.95, chunk_rows=chunk_rows)
    got = {}
    for r in near_duplicates.connected_components(links).collect():
        got.setdefault(r.root, set()).add(r.node)
    u = unit(x)
    s = u @ u.T
    want = {frozenset(np.flatnonzero(s[i] > 0.95).tolist()) for i in range(400) if (s[i] > 0.95).sum() > 1}
    assert {frozenset(g) for g in got.values()} == want
