import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenaudit.functions.vectors import unit
from lumenaudit.llm.cells import placed
from lumenaudit.llm import cross_polytope
from lumenaudit.llm.cross_polytope import best_cells, cell_shape, hadamard, pseudo_rotation, similar_vectors, top_of_blocks
from lumenaudit.llm.density import cluster_vectors, describe_clusters
from lumenaudit.llm.diverse_subset import diverse_subset, greedy_determinant, representatives

SCHEMA = "vec_id long, label string, embedding array<float>, similarity string, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, lab, None if v is None else [float(x) if x is not None else None for x in v], "x", 1) for i, lab, v in rows], SCHEMA)


def clustered(seed=0, sizes=(12, 7, 5, 3, 1, 1, 1), dim=16, spread=0.12):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for size in sizes:
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(size):
            rows.append((n, f"l{size}", (c + rng.normal(size=dim) * spread / np.sqrt(dim)) * rng.uniform(1, 9)))
            n += 1
    return rows


BAD = [(900, "bad", None), (901, "bad", [0.0] * 16), (902, "bad", [1.0] * 15), (903, "bad", [float("nan")] + [1.0] * 15), (904, "bad", [None] + [1.0] * 15), (None, "bad", [1.0] * 16)]


def truth(rows, k, least):
    ids = np.array([r[0] for r in rows])
    u = unit(np.array([r[2] for r in rows], np.float32))
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(ids)):
        o = [j for j in np.lexsort((ids, -s[i])) if j != i and s[i, j] >= least][:k]
        out |= {(int(ids[i]), int(ids[j])) for j in o}
    return out


def test_hadamard_keeps_lengths_and_inverts():
    x = np.random.default_rng(0).normal(size=(5, 16)).astype(np.float32)
    assert np.allclose(hadamard(hadamard(x)), x, atol=1e-5)
    assert np.allclose(np.linalg.norm(pseudo_rotation(x[:, :11], 3), axis=1), np.linalg.norm(x[:, :11], axis=1), atol=1e-5)


@pytest.mark.parametrize("rows", [1, 1000, 100_000, 10_000_000])
def test_cells_follow_the_number_of_rows(rows):
    shape = cell_shape(rows, 128, 450)
    cells = 2 * shape[0] * (2 * shape[1] or 1)
    assert cells <= 1 << 17 and (rows < 10_000 or 0.2 <= cells / (rows / 450) <= 4)
    c = best_cells(unit(np.random.default_rng(1).normal(size=(20, 128)).astype(np.float32)), shape, 5, 1)
    assert c.shape == (20, 5) and c.max() < cells


def test_chunks_meet_in_pairs():
    import pyarrow as pa

    ids = pa.array(range(100))
    b = placed(ids, pa.array([b"x"] * 100), np.zeros((100, 1), np.int32), {0: 3}).to_pandas()
    groups = {k: set(g.vec_id) for k, g in b.groupby(["one", "two"])}
    assert all(any(i in g and j in g for g in groups.values()) for i in range(100) for j in range(i))


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 60), st.integers(1, 12), st.integers(0, 3))
def test_block_search_is_exact(n, k, copies):
    rng = np.random.default_rng(n * 7 + k)
    x = unit(rng.normal(size=(n, 8)).astype(np.float32))
    x[: min(copies * 3, n)] = x[0]
    ids = np.sort(rng.choice(1000, n, replace=False)).astype(np.int64)
    got = {(int(ids[q]), int(i)) for r, i, _ in top_of_blocks(x, ids, x, ids, k, -1.0, block=7) for q, i in zip(r, i)}
    s = np.round(x @ x.T, 6)
    want = set()
    for i in range(n):
        want |= {(int(ids[i]), int(ids[j])) for j in [j for j in np.lexsort((ids, -s[i])) if j != i][:k]}
    assert got == want


def test_similar_vectors_match_brute_force(spark):
    rows = clustered()
    got = similar_vectors(table(spark, rows + BAD + rows[:3]), k=4, dim=16, probes=4, min_similarity=0.72, rows_per_cell=16)
    assert {(r.vec_id, r.neighbor_id) for r in got.collect()} == truth(rows, 4, 0.72)


def test_similar_vectors_of_a_hot_group_of_copies(spark):
    rows = clustered()
    rows += [(100 + i, "copy", rows[0][2]) for i in range(60)]
    got = similar_vectors(table(spark, rows), k=4, dim=16, probes=4, min_similarity=0.72, rows_per_cell=16, chunk_rows=8)
    found = got.collect()
    assert {(r.vec_id, r.neighbor_id) for r in found} == truth(rows, 4, 0.72)
    assert all(len({x.rank for x in found if x.vec_id == i}) == 4 for i in range(100, 160))


@pytest.mark.parametrize("rows", [12_100, 121_000, 1_200_000, 12_000_000])
def test_similar_pairs_meet_at_any_number_of_rows(spark, monkeypatch, rows):
    from lumenaudit.llm import cross_polytope

    # pairs of cosine 0.85 to 0.92, compared in the cells of a table of so many rows
    rng = np.random.default_rng(9)
    a = unit(rng.normal(size=(600, 128)))
    turn = rng.normal(size=(600, 128))
    turn = unit(turn - (turn * a).sum(1, keepdims=True) * a)
    cos = rng.uniform(0.85, 0.92, (600, 1))
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * turn])
    shape = cell_shape(rows, 128, 450)
    monkeypatch.setattr(cross_polytope, "cell_shape", lambda *_: shape)
    got = {(r.vec_id, r.neighbor_id) for r in similar_vectors(table(spark, [(i, "x", v) for i, v in enumerate(x)]), min_similarity=0.72).collect()}
    assert sum((i, i + 600) in got and (i + 600, i) in got for i in range(600)) >= 0.985 * 600


def test_neighbors_query_is_whole_at_any_similarity(spark, tmp_path, monkeypatch):
    from lumenaudit.llm import cross_polytope, queries

    # far neighbours only: at the cells of a large table few of them share a cell
    rng = np.random.default_rng(3)
    rows = [(i, "x", rng.normal(size=128)) for i in range(300)]
    table(spark, rows + [(900, "bad", None)]).write.parquet(str(tmp_path / "vectors.parquet"))
    monkeypatch.setattr(cross_polytope, "cell_shape", lambda *_: (128, 1))
    monkeypatch.setattr(cross_polytope, "EXACT_ROWS", 80, raising=False)
    got = {(r.vec_id, r.neighbor_id) for r in queries.p1_neighbors(spark, str(tmp_path)).collect()}
    want = truth(rows, 10, -1.0)
    assert len(got) == 3000 and len(got & want) >= 0.999 * len(want)


def test_similar_vectors_empty(spark):
    assert similar_vectors(table(spark, BAD), dim=16).count() == 0
    assert similar_vectors(table(spark, []), dim=16).columns == ["vec_id", "neighbor_id", "similarity", "rank"]


def test_recall_on_test_data(spark, sf):
    import pyarrow.parquet as pq

    from lumenaudit.functions.vectors import list_matrix

    t = pq.read_table(f"{sf}/vectors.parquet")
    ok, x = list_matrix(t["embedding"], 128)
    ids = t["vec_id"].to_numpy()[ok]
    ids, at = np.unique(ids, return_index=True)
    want = truth(list(zip(ids, ids, x[at])), 10, 0.72)
    got = {(r.vec_id, r.neighbor_id) for r in similar_vectors(spark.read.parquet(f"{sf}/vectors.parquet"), min_similarity=0.72).collect()}
    assert len(got & want) >= 0.98 * len(want)


@pytest.fixture(scope="module")
def true_pairs():
    """(units, pairs) of 2,000 records' ten nearest with a cosine of 0.72 or more in the largest table at hand."""
    import os

    import pyarrow.parquet as pq

    from lumenaudit.functions.vectors import list_matrix

    name = next(p for p in ("/root/testdata/sf0.1/vectors.parquet", os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/vectors.parquet") if os.path.exists(p))
    t = pq.read_table(name)
    ok, x = list_matrix(t["embedding"], 128)
    _, at = np.unique(t["vec_id"].to_numpy()[ok], return_index=True)
    u = unit(x[at])
    asked = np.random.default_rng(0).permutation(len(u))[:2000]
    f = u.astype(np.float32)
    pairs = []
    for a in range(0, len(asked), 500):
        s = f[asked[a : a + 500]] @ f.T
        s[np.arange(len(s)), asked[a : a + 500]] = -2
        top = np.argpartition(-s, 10, 1)[:, :10]
        r, c = np.nonzero(np.take_along_axis(s, top, 1) >= 0.72)
        pairs.append(np.stack([asked[a : a + 500][r], top[r, c]], 1))
    return u, np.concatenate(pairs)


@pytest.mark.parametrize("rows", [12_000, 121_000, 1_000_000, 10_000_000, 30_000_000, 100_000_000])
def test_recall_does_not_fall_with_the_cells_of_larger_tables(true_pairs, rows):
    u, pairs = true_pairs
    shape = cross_polytope.cell_shape(rows, 128, 450)
    cells = cross_polytope.placed_cells(u, shape, *cross_polytope.places(shape), 20)
    a, b = cells[pairs[:, 0]], cells[pairs[:, 1]]
    meet = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2))
    assert len(pairs) > 300 and meet.mean() >= 0.99


def test_clusters(spark):
    rows = clustered(sizes=(40, 9, 5, 4, 1, 1))
    df = table(spark, rows + BAD + rows[:5])
    for chunk in (16384, 8):
        got = {(r.cluster_id, r.vec_id) for r in cluster_vectors(df, dim=16, min_size=5, rows_per_cell=8, chunk_rows=chunk).collect()}
        assert got == {(0, i) for i in range(40)} | {(40, i) for i in range(40, 49)} | {(49, i) for i in range(49, 54)}
    assert cluster_vectors(table(spark, []), dim=16).count() == 0


def test_cluster_core_points(spark):
    # a bridge of single points joins two dense groups only while it counts as core
    a = [[1.0, 0.0, 0, 0], [1.0, 0.02, 0, 0], [1.0, 0.0, 0.02, 0], [1.0, 0.02, 0.02, 0]]
    b = [[0.0, 1.0, 0, 0], [0.02, 1.0, 0, 0], [0.0, 1.0, 0.02, 0], [0.02, 1.0, 0.02, 0]]
    bridge = [[1.0, 1.0, 0, 0]]
    df = table(spark, [(i, "x", v) for i, v in enumerate(a + b + bridge)])
    one = cluster_vectors(df, dim=4, min_similarity=0.7, min_points=2).select("cluster_id").distinct().count()
    dense = cluster_vectors(df, dim=4, min_similarity=0.9, min_points=3)
    assert one == 1 and {(r.cluster_id, r.vec_id) for r in dense.collect()} == {(0, i) for i in range(4)} | {(4, i) for i in range(4, 8)}


def brute_dbscan(u, least, min_points):
    """{row: (root, core)} by definition; root is the cluster's smallest core."""
    hit = np.round(u @ u.T, 6) >= least
    core = hit.sum(1) >= min_points
    root = np.where(core, np.arange(len(u)), len(u))
    for _ in range(len(u)):
        new = np.array([root[hit[i] & core].min() if core[i] else len(u) for i in range(len(u))])
        if (new == root).all():
            break
        root = new
    for i in np.flatnonzero(~core):
        near = hit[i] & core
        root[i] = root[near].min() if near.any() else len(u)
    return {i: (int(root[i]), bool(core[i])) for i in range(len(u)) if root[i] < len(u)}


@pytest.mark.parametrize("min_points", [2, 5])
def test_clusters_are_those_of_the_definition(spark, min_points):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4))
    u = unit(x.astype(np.float32))
    want = brute_dbscan(u, 0.95, min_points)
    name = {}
    for i, (root, _) in want.items():
        name[root] = min(name.get(root, i), i)
    assert len(name) > 5 and (min_points == 2 or any(not c for _, c in want.values()))
    df = table(spark, [(i, "x", v) for i, v in enumerate(x)])
    for how in ({"exact": True, "chunk_rows": 1_000_000}, {"exact": True, "chunk_rows": 60}, {"exact": True, "chunk_rows": 20}, {"margin": 2.0, "max_cells": 99, "rows_per_cell": 100, "chunk_rows": 90}):
        got = cluster_vectors(df, dim=4, min_similarity=0.95, min_points=min_points, min_size=1, **how).collect()
        assert {r.vec_id: (r.cluster_id, r.is_core) for r in got} == {i: (name[root], c) for i, (root, c) in want.items()}


def test_two_steps_of_division():
    from lumenaudit.llm.density import Pivots

    rng = np.random.default_rng(5)
    centers = unit(rng.normal(size=(500, 32)).astype(np.float32))
    u = unit((centers[rng.integers(0, 500, 4000)] + 0.06 * rng.normal(size=(4000, 32))).astype(np.float32))
    p = Pivots(u, 24, 1000, 0.5)
    assert p.cells is not None and 500 < p.first[-1] <= 1100
    cells = p.place(u, 0.3, 6)
    assert (cells[:, 0] >= 0).all() and np.bincount(cells[:, 0]).max() < 200
    hit = np.argwhere(np.triu(u @ u.T >= 0.72, 1))
    met = [bool(set(cells[a][cells[a] >= 0]) & set(cells[b])) for a, b in hit[:20000]]
    assert np.mean(met) > 0.995


def test_cluster_description(spark):
    rows = clustered(sizes=(6, 5))
    rows[0] = (0, "None", rows[0][2])
    df = table(spark, rows)
    out = {r.cluster_id: r for r in describe_clusters(df, cluster_vectors(df, dim=16, min_size=5, rows_per_cell=4), dim=16).collect()}
    assert out[0]["size"] == 6 and out[0].labels == "l6:5" and out[6].labels == "l5:5"
    u = unit(np.array([r[2] for r in rows[:6]], np.float32))
    m = u.mean(0)
    assert out[0].medoids.split(",")[0] == str(int((u @ m).argmax()))


def test_greedy_determinant_is_greedy():
    rng = np.random.default_rng(4)
    u = unit(rng.normal(size=(30, 6)).astype(np.float32))
    labels = np.array(list("abc") * 10)
    kernel = np.exp((u @ u.T - 1) / 0.5) * np.where(labels[:, None] == labels, 1, 0.7)
    rows, gains = greedy_determinant(u, labels, 6, 0.5, 0.7)
    chosen = []
    for _ in range(6):
        det = [np.linalg.det(kernel[np.ix_([*chosen, i], [*chosen, i])]) if i not in chosen else -1 for i in range(30)]
        chosen.append(int(np.argmax(np.round(det, 7))))
    assert rows.tolist() == chosen
    assert np.isclose(np.prod(gains), np.linalg.det(kernel[np.ix_(chosen, chosen)]), rtol=1e-3)


def test_varied_subset_covers_groups(spark):
    rows = clustered(sizes=(300, 20, 10, 5, 5, 3, 1, 1, 1, 1), spread=0.05)
    rows += [(1000 + i, "l300", rows[0][2]) for i in range(100)]
    df = table(spark, rows + BAD)
    out = diverse_subset(df, 10, dim=16, block_rows=64).collect()
    assert len(out) == 10 and [r["rank"] for r in sorted(out, key=lambda r: r["rank"])] == list(range(1, 11))
    start = np.cumsum([0, 300, 20, 10, 5, 5, 3, 1, 1, 1, 1])
    groups = {int(np.searchsorted(start, r.vec_id, "right")) if r.vec_id < 900 else 1 for r in out}
    assert len(groups) >= 9
    again = diverse_subset(df, 10, dim=16, block_rows=64).collect()
    assert {r.vec_id for r in again} == {r.vec_id for r in out}
    near = representatives(df, diverse_subset(df, 10, dim=16, block_rows=64), dim=16)
    assert near.count() == 347 + 100 and near.where("similarity < 0.5").count() == 0


def test_subset_of_copies_and_none(spark):
    df = table(spark, [(i, "a", [1.0, 2.0, 3.0, 4.0]) for i in range(20)])
    assert [r.vec_id for r in diverse_subset(df, 5, dim=4).collect()] == [0]
    assert diverse_subset(df, 0, dim=4).count() == 0
    assert diverse_subset(table(spark, []), 5, dim=4).count() == 0
