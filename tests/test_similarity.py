import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenaudit.operators import models as M
from lumenaudit.operators import similarity as S

#: Two copies, a chain 2~3~4 whose ends are apart, a zero vector, a null, a single.
TINY = [(0, "a", [1.0, 0, 0]), (1, "a", [2.0, 0, 0]), (2, "b", [0, 1.0, 0]), (3, "b", [0, 1.0, 0.4]), (4, "b", [0, 1.0, 0.9]), (5, None, [0.0, 0, 0]), (6, None, None), (7, "c", [-1.0, -1, -1])]


def table(spark, rows):
    return spark.createDataFrame([(i, lab, None if v is None else [float(x) for x in v], 1) for i, lab, v in rows], "vec_id long, label string, embedding array<float>, src int")


def random_rows(n, d=6, seed=0, labels="ab"):
    rng = np.random.default_rng(seed)
    return [(i, labels[i % len(labels)], rng.normal(size=d).astype(np.float32)) for i in range(n)]


def test_duplicates(spark):
    df = table(spark, TINY)
    for chunk in (4096, 2):
        got = {(r.cluster_id, r.vec_id) for r in S.duplicate_clusters(df, 0.9, chunk_rows=chunk).collect()}
        assert got == {(0, 0), (0, 1), (2, 2), (2, 3), (2, 4)}
    rows = sorted(map(tuple, S.summarize_duplicates(S.duplicate_clusters(df, 0.9)).collect()))
    assert rows == [(0, [1], 2), (2, [3, 4], 3)]
    names = df.select("vec_id", F.concat(F.lit("n"), "vec_id").alias("name"))
    assert sorted(map(tuple, S.summarize_duplicates(S.duplicate_clusters(df, 0.9), names).collect())) == [("n0", ["n1"], 2), ("n2", ["n3", "n4"], 3)]
    assert {(r.src, r.dst) for r in S.similar_pairs(df, 0.9, chunk_rows=3).collect()} == {(0, 1), (2, 3), (3, 4)}
    assert S.duplicate_clusters(df.limit(0)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.integers(1, 25), st.integers(1, 6), st.sampled_from(["cosine", "dot", "euclidean"]), st.sampled_from([4096, 5]))
def test_neighbors_match_brute_force(spark, n, k, metric, chunk):
    rows = random_rows(n, seed=n * k)
    if n > 3:
        rows[3] = (3, "a", rows[1][2])
    df = table(spark, rows)
    x = np.array([r[2] for r in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = {"cosine": u @ u.T, "dot": x @ x.T, "euclidean": -np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))}[metric]
    s = np.round(s, 9)
    want = {(i, j, r + 1) for i in range(n) for r, j in enumerate([j for j in np.lexsort((np.arange(n), -s[i])) if j != i][:k])}
    got = S.knn_join(df, df, k, metric=metric, chunk_rows=chunk).collect()
    assert {(r.src, r.dst, r["rank"]) for r in got} == want
    shuffled = df.orderBy(F.desc("vec_id")).repartition(3)
    assert {(r.src, r.dst, r["rank"]) for r in S.knn_join(shuffled, shuffled, k, metric=metric).collect()} == want


def test_propagation(spark):
    rows = [(0, "b", [1, 0.1]), (1, "a", [1, -0.1]), (2, None, [1, 0]), (3, None, [0, 1]), (4, "c", [0, 1])]
    df = table(spark, rows)
    got = {r.vec_id: (r.pred_label, r.confidence) for r in S.propagate_labels(df, "label", 2).collect()}
    assert got == {2: ("a", 0.5), 3: ("b", 0.5)} or got[2] == ("a", 0.5)
    more = {r.vec_id: r.pred_label for r in S.propagate_labels(df, "label", 50).collect()}
    assert more == {2: "a", 3: "a"}
    none = S.propagate_labels(table(spark, [(1, None, [1.0, 0])]), "label").collect()
    assert [(r.pred_label, r.confidence) for r in none] == [(None, 0.0)]
    out = {r.vec_id: r for r in S.relabel(df, "label", 1, 0.7).collect()}
    assert out[0].final_label is None and out[0].resolved_label == "b" and out[3].final_label == "c" and len(out) == 5
    assert {r.final_label for r in S.relabel(df, "label", 1, 0.0).where("vec_id = 0").collect()} == {"b"}


def test_outliers(spark):
    df = table(spark, [(i, "a", [i, 0.0]) for i in range(4)] + [(10, "b", [0, 0]), (11, "b", [9, 9])])
    got = [(r.vec_id, r.label) for r in S.centroid_outliers(df, "label", 2).orderBy("rank").collect()]
    assert got == [(0, "a"), (3, "a")]
    scores = S.knn_outlier_scores(df, 2)
    assert {r.vec_id: r.score for r in scores.collect()}[11] == pytest.approx((np.hypot(6, 9) + np.hypot(7, 9)) / 2)
    assert [r.vec_id for r in S.flag_outliers(scores, 0.95).where("status = 'Outlier'").collect()] == [11]


def test_diversity(spark):
    rows = random_rows(23, 5, 3, "aab") + [(90, "one", [1, 2, 3, 4, 5]), (91, None, [1, 1, 1, 1, 1])]
    df = table(spark, rows)
    x = np.array([r[2] for r in rows if r[1] == "a"], float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for chunk in (4096, 4):
        got = {r["class"]: r for r in S.intra_class_diversity(df, "label", chunk_rows=chunk).collect()}
        assert set(got) == {"a", "b"} and got["a"].mean_distance == pytest.approx(d.mean(), 1e-6) and got["a"].variance_distance == pytest.approx(d.var(), 1e-6)
    m = {r["class"]: r for r in S.class_moments(df, "label").collect()}
    assert np.allclose(np.array(m["a"].cov).reshape(5, 5), np.cov(x.T)) and m["one"].cov is None
    o = {(r.class_a, r.class_b): r.distance for r in S.class_overlap(df, "label").collect()}
    y = np.array([r[2] for r in rows if r[1] == "b"], float)
    cross = np.sqrt(np.linalg.eigvals(np.cov(x.T) @ np.cov(y.T)).astype(complex)).sum().real
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(np.cov(x.T)) + np.trace(np.cov(y.T)) - 2 * cross
    assert o["a", "b"] == pytest.approx(want, 1e-5) and o["a", "one"] == 0
    assert S.diversity_index(df, "label").first().diversity_index > 0


def test_clustering(spark):
    rows = [(i, "a", [i % 2 * 10 + i * 0.01, 0.0]) for i in range(20)]
    df = table(spark, rows)
    got = M.kmeans_clusters(df, 2).collect()
    assert len({(r.vec_id % 2, r.cluster_id) for r in got}) == 2
    with pytest.raises(ValueError):
        M.kmeans_clusters(df, 20)
    with_cluster = df.withColumn("c", F.col("vec_id") % 2)
    sil = M.silhouette(with_cluster, "c", chunk_rows=7).agg(F.avg("silhouette")).first()[0]
    assert 0.98 < sil < 1 and M.silhouette(df.withColumn("c", F.lit(1)), "c").where("silhouette <> 0").count() == 0
    named = M.pseudo_labels(spark.createDataFrame([(1, 0), (2, 5)], "vec_id long, cluster_id long"), {0: "zero"}).collect()
    assert [r.pseudo_label for r in named] == ["zero", "cluster_5"]


def test_influence_and_candidates(spark):
    rows = random_rows(40, 4, 5)
    df = table(spark, rows + [(77, "Unknown", [1, 1, 1, 1]), (78, None, [1, 1, 1, 1])])
    got = {r.vec_id: r.influence for r in M.influence_one_step(df, "label").collect()}
    x, y = np.array([r[2] for r in rows], float), np.array([i % 2 for i in range(40)])
    hot = np.eye(2)[y]
    w, b = 10 * (hot - 0.5).T @ x / 40, 10 * (hot - 0.5).mean(0)
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    want = ((p - hot) ** 2).sum(1) * ((x * x).sum(1) + 1)
    assert len(got) == 40 and all(got[i] == pytest.approx(want[i]) for i in range(40))
    top = M.problem_candidates(df, "label", 0.1).collect()
    assert len(top) == 4 and all(r.reasons for r in top) and top[0].problem_score >= top[-1].problem_score
    with pytest.raises(ValueError):
        M.influence_one_step(df.where("label = 'a'"), "label")


def test_projection(spark):
    df = table(spark, [(i, "a", [i, 0.5 * i, (i * 7) % 3 * 0.1]) for i in range(30)])
    rows = M.pca_projection(df).orderBy("vec_id").collect()
    assert rows[-1].x1 > rows[0].x1 and M.pca_variance(df).first().ratio > 0.95
    assert M.reduce_embeddings(df, "tsne", most=20).count() == 20
    with pytest.raises(ValueError):
        M.reduce_embeddings(df, "umap")


def test_class_moments_query_has_all_dimensions(spark, tmp_path):
    import __spark_entry__ as entry

    rng = np.random.default_rng(2)
    x = {0: rng.normal(size=(9, 64)).astype(np.float32), 1: rng.normal(size=(5, 64)).astype(np.float32), 2: rng.normal(size=(1, 64)).astype(np.float32)}
    rows = [(c * 100 + i, c, v.tolist()) for c, m in x.items() for i, v in enumerate(m)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = entry.queries()["class_moments_all"](spark, str(tmp_path)).toPandas()
    assert len(out) == 3 * 64 * 64
    for c, m in x.items():
        mine = out[out["class"] == c].sort_values(["i", "j"])
        assert np.allclose(mine["mean"].to_numpy().reshape(64, 64), np.repeat(m.astype(float).mean(0)[:, None], 64, 1), atol=2e-6)
        if len(m) > 1:
            assert np.allclose(mine["cov"].to_numpy().reshape(64, 64), np.cov(m.astype(float).T), atol=2e-6)
        else:
            assert mine["cov"].isna().all()


def test_tsne_places_every_row(spark):
    rng = np.random.default_rng(6)
    group = np.arange(120) % 2
    x = rng.normal(size=(120, 8)) * 0.1 + group[:, None] * 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.x1, r.x2) for r in M.reduce_embeddings(df, "tsne", most=60, whole=True).collect()}
    assert set(out) == set(range(120))
    p = np.array([out[i] for i in range(120)])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert np.isfinite(p).all() and (group[d.argmin(1)] == group).all()


def test_tsne_query_projects_the_whole_table(spark, tmp_path):
    import __spark_entry__ as entry

    x = np.random.default_rng(7).normal(size=(310, 4))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert entry.queries()["tsne_projection"](spark, str(tmp_path)).count() == 310


def test_kmeans_keeps_the_best_of_ten_fits(spark, monkeypatch):
    seeds = []
    real = M.KMeans
    monkeypatch.setattr(M, "KMeans", lambda seed, **more: seeds.append(seed) or real(seed=seed, **more))
    df = spark.createDataFrame([(i, [float(i % 3 * 9), float(i)]) for i in range(12)], "vec_id long, embedding array<double>")
    assert M.kmeans_clusters(df, 3).count() == 12 and len(set(seeds)) == 10


def test_inverted_lists(spark):
    from lumenaudit.operators import index as X
    from lumenaudit.operators import similarity as S

    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([centers[i % 12] + 0.4 * rng.normal(size=16) for i in range(600)]).reshape(600, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700 + i, x[0].tolist()) for i in range(40)] + [(None, x[1].tolist()), (800, None), (801, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for metric in ("cosine", "euclidean", "dot"):
        exact = {(r.src, r.dst, r["rank"]) for r in S.knn_join(df, df, 4, metric=metric).collect()}
        for chunk in (16384, 30):
            whole = {(r.src, r.dst, r["rank"]) for r in X.ivf_search(df, df, 4, metric=metric, lists=10, probes=10, chunk_rows=chunk).collect()}
            assert whole == exact
        if metric != "dot":
            assert X.recall(X.search(df, df, 4, "lists", metric=metric), S.knn_join(df, df, 4, metric=metric)).first().recall > 0.95
    assert X.ivf_search(df, df.limit(0), 3).count() == 0 and X.ivf_search(df.limit(0), df, 3).count() == 0
    assert {tuple(r) for r in X.search(df, df, 2).collect()} == {tuple(r) for r in S.knn_join(df, df, 2).collect()}
    with pytest.raises(ValueError):
        X.search(df, df, 2, "pq")
