"""Queries on vectors: neighbours, duplicates, labels, outliers, diversity, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import cut, table
from lumenaudit.functions.vectors import as_double, cosine, dot, l2_normalize, norm
from lumenaudit.operators import index as X
from lumenaudit.operators import models as M
from lumenaudit.operators import similarity as S
from lumenaudit.operators.sampling import sample_rows
from lumenaudit.plans.registry import query

#: Parameter: the test vectors are far apart, so links count from here on.
LINK = 0.4

_E = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_COS = "list_cosine_similarity(a.e, b.e)"
_KNN = f"""
    SELECT a.vec_id AS src, b.vec_id AS dst, {_COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS r
    FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id
"""
_L2 = f"""
    SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.e, b.e) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e, b.e), 9), b.vec_id) AS r
    FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id
"""
_DUP = f"""
    pairs AS (SELECT a.vec_id AS s, b.vec_id AS t FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id WHERE {_COS} > {LINK}),
    reach(s, t) AS (SELECT s, t FROM pairs UNION SELECT r.s, p.t FROM reach r JOIN pairs p ON r.t = p.s),
    clusters AS (SELECT s AS vec_id, least(s, min(t)) AS cluster_id FROM reach GROUP BY s)
"""
_CENTROID = f"""
    cen AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(e[d]) AS m FROM {_E}, (SELECT unnest(range(1, 65)) AS d) GROUP BY label, d) GROUP BY label),
    dist AS (SELECT vec_id, x.label, list_distance(e, c) AS dist FROM {_E} x JOIN cen USING (label))
"""
_SCORES = f"knn AS (SELECT src AS vec_id, avg(dist) AS score FROM ({_L2}) WHERE r <= 5 GROUP BY src)"


def _e(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(f"SELECT vec_id, (i - 1)::INT AS dim, round(e[i] / greatest(sqrt(list_inner_product(e, e)), 1e-12), 6) AS value FROM {_E}, (SELECT unnest(range(1, 65)) AS i)")
def l2_normalize_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = _e(spark, d).select("vec_id", F.posexplode(l2_normalize(as_double("embedding"))).alias("dim", "value"))
    return _rounded(rows, "value")


@query(f"SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS length, round(list_cosine_similarity(e, f), 6) AS cosine, round(list_inner_product(e, f), 6) AS inner_product, round(list_distance(e, f), 6) AS distance FROM {_E}, (SELECT embedding::DOUBLE[] AS f FROM embeddings WHERE vec_id = 0)")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    from lumenaudit.functions.vectors import euclidean

    one = _e(spark, d).where("vec_id = 0").select(as_double("embedding").alias("f"))
    rows = _e(spark, d).select("vec_id", as_double("embedding").alias("e")).crossJoin(F.broadcast(one))
    e, f = F.col("e"), F.col("f")
    return _rounded(rows.select("vec_id", norm(e).alias("length"), cosine(e, f).alias("cosine"), dot(e, f).alias("inner_product"), euclidean(e, f).alias("distance")), "length", "cosine", "inner_product", "distance")


@query(f"SELECT a.vec_id AS src, b.vec_id AS dst, round({_COS}, 6) AS sim FROM {_E} a JOIN {_E} b ON a.vec_id < b.vec_id WHERE {_COS} > {LINK}")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.similar_pairs(_e(spark, d), LINK), "sim")


@query(f"""
    SELECT src, dst, r::INT AS rank, round(sim, 6) AS score FROM (
        SELECT a.vec_id AS src, b.vec_id AS dst, {_COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS r FROM {_E} a, {_E} b
    ) WHERE r <= 10
""")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.knn_graph(_e(spark, d), 10), "score")


@query(f"SELECT src, dst, r::INT AS rank, round(sim, 6) AS score FROM ({_KNN}) WHERE r <= 5")
def indexed_neighbors_all_lists(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours from the index when every list is looked into: then nothing is lost."""
    return _rounded(X.ivf_search(_e(spark, d), _e(spark, d), 5, lists=16, probes=16), "score")


@query("SELECT 5 * count(*) AS n, true AS recalled FROM embeddings")
def indexed_neighbors_recall(spark: SparkSession, d: str) -> DataFrame:
    """Does the index find nine tenths of the exact neighbours, with its own parameters?"""
    e = _e(spark, d)
    return X.recall(X.search(e, e, 5, "lists"), S.knn_join(e, e, 5)).select("n", (F.col("recall") >= 0.9).alias("recalled"))


@query(f"SELECT src, dst, r::INT AS rank, round(sim, 6) AS score FROM ({_KNN}) WHERE r <= 5 AND sim > {LINK}")
def knn_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.near_neighbors(_e(spark, d), LINK, 5), "score")


@query(f"WITH RECURSIVE {_DUP} SELECT cluster_id, vec_id FROM clusters")
def duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    return S.duplicate_clusters(_e(spark, d), LINK)


@query(f"""WITH RECURSIVE {_DUP} SELECT cluster_id AS representative, coalesce(string_agg(vec_id, ',' ORDER BY vec_id) FILTER (WHERE vec_id <> cluster_id), '') AS duplicates, count(*) AS "count" FROM clusters GROUP BY cluster_id""")
def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.summarize_duplicates(S.duplicate_clusters(_e(spark, d), LINK)).withColumn("duplicates", F.array_join("duplicates", ","))


_VOTES = f"""
    WITH k AS (SELECT vec_id, label, e FROM {_E} WHERE vec_id % 5 = 0),
    n AS (SELECT a.vec_id AS src, b.label AS l, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS r FROM (SELECT * FROM {_E} WHERE vec_id % 5 <> 0) a, k b),
    v AS (SELECT src, l, count(*) AS c FROM n WHERE r <= 5 GROUP BY src, l),
    w AS (SELECT src, arg_min(l, (-c, l)) AS pred, max(c) / sum(c) AS conf FROM v GROUP BY src)
"""


def _partly(spark: SparkSession, d: str) -> DataFrame:
    # the role of the labelled rows in this showcase: every fifth record has a label
    return _e(spark, d).withColumn("label", F.when(F.col("vec_id") % 5 == 0, F.col("label")))


@query(_VOTES + "SELECT src AS vec_id, pred AS pred_label, round(conf, 6) AS confidence FROM w")
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.propagate_labels(_partly(spark, d), "label"), "confidence")


@query(_VOTES + f"""
    SELECT vec_id, label::VARCHAR AS original_label, label::VARCHAR AS pred_label, NULL::VARCHAR AS final_label, 0.0::DOUBLE AS confidence, label::VARCHAR AS resolved_label FROM k
    UNION ALL SELECT src, NULL, pred::VARCHAR, CASE WHEN conf >= {LINK} THEN pred::VARCHAR END, round(conf, 6), CASE WHEN conf >= {LINK} THEN pred::VARCHAR ELSE 'unknown' END FROM w
""")
def relabel(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.relabel(_partly(spark, d), "label", threshold=LINK), "confidence")


@query(f"WITH {_CENTROID} SELECT vec_id, label, round(dist, 6) AS distance, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(dist, 9) DESC, vec_id) AS r FROM dist) WHERE r <= 5")
def centroid_outliers(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.centroid_outliers(_e(spark, d), "label"), "distance")


@query(f"WITH {_CENTROID} SELECT vec_id, label, round(dist, 6) AS distance FROM dist")
def centroid_distances(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.centroid_distances(_e(spark, d), "label"), "distance")


@query(f"WITH {_SCORES} SELECT vec_id, round(score, 6) AS score FROM knn")
def knn_outlier_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.knn_outlier_scores(_e(spark, d)), "score")


@query(f"WITH {_SCORES} SELECT vec_id, round(score, 6) AS score, CASE WHEN score >= (SELECT quantile_cont(score, 0.95) FROM knn) THEN 'Outlier' ELSE 'Normal' END AS status FROM knn")
def outlier_flag(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.flag_outliers(S.knn_outlier_scores(_e(spark, d))), "score")


@query(f"""
    WITH {_CENTROID}, {_SCORES}
    SELECT 'centroid' AS method, vec_id, round(dist, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(dist, 9) DESC, vec_id) AS r FROM dist) WHERE r <= 5
    UNION ALL SELECT 'knn', vec_id, round(score, 6) FROM knn
""")
def outlier_summary(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    a = S.centroid_outliers(e, "label").select(F.lit("centroid").alias("method"), "vec_id", F.col("distance").alias("score"))
    return _rounded(a.unionByName(S.knn_outlier_scores(e).select(F.lit("knn").alias("method"), "vec_id", "score")), "score")


@query(f"""
    SELECT a.label AS class, count(DISTINCT a.vec_id) AS n_samples, round(avg(list_distance(a.e, b.e)), 6) AS mean_distance, round(var_pop(list_distance(a.e, b.e)), 6) AS variance_distance
    FROM {_E} a JOIN {_E} b USING (label) GROUP BY 1 HAVING count(DISTINCT a.vec_id) >= 2
""")
def intra_class_diversity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.intra_class_diversity(_e(spark, d), "label"), "mean_distance", "variance_distance")


@query(f"""
    SELECT label AS class, (i - 1)::INT AS i, (j - 1)::INT AS j, round(covar_samp(e[i], e[j]), 6) AS cov, round(avg(e[i]), 6) AS mean
    FROM {_E}, (SELECT unnest(range(1, 9)) AS i), (SELECT unnest(range(1, 9)) AS j) GROUP BY label, i, j
""")
def class_moments(spark: SparkSession, d: str) -> DataFrame:
    """The first 8 dimensions, as the SQL has them; ``class_moments_all`` has all."""
    m = S.class_moments(_e(spark, d), "label")
    at = F.explode(F.sequence(F.lit(0), F.lit(7)))
    rows = m.select("class", "mean", "cov", at.alias("i")).select("*", at.alias("j"))
    return rows.select(F.col("class").cast("int").alias("class"), "i", "j", F.round(F.col("cov")[F.col("i") * 64 + F.col("j")], 6).alias("cov"), F.round(F.col("mean")[F.col("i")], 6).alias("mean"))


@query()
def class_moments_all(spark: SparkSession, d: str) -> DataFrame:
    """Every covariance and mean of each class; no covariance in classes of one row."""
    m = S.class_moments(_e(spark, d), "label").withColumn("width", F.size("mean"))
    rows = m.select("class", "mean", "cov", "width", F.posexplode("mean").alias("i", "m"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("j"))
    return rows.select(F.col("class").cast("int").alias("class"), "i", "j", F.round(F.col("cov")[F.col("i") * F.col("width") + F.col("j")], 6).alias("cov"), F.round("m", 6).alias("mean"))


@query()
def class_overlap_frechet(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.class_overlap(_e(spark, d), "label"), "distance")


@query()
def diversity_index(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.diversity_index(_e(spark, d), "label"), "mean_intra_distance", "mean_inter_distance", "diversity_index")


@query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return M.kmeans_clusters(_e(spark, d), 10)


_ASSIGN = f"""
    SELECT vec_id, c AS cluster_id, dist AS distance FROM (
        SELECT a.vec_id, b.vec_id AS c, list_distance(a.e, b.e) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e, b.e), 9), b.vec_id) AS r
        FROM {_E} a, {_E} b WHERE b.vec_id < 10) WHERE r = 1
"""


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    centers = _e(spark, d).where("vec_id < 10").select(F.col("vec_id").alias("cluster_id"), as_double("embedding").alias("center"))
    return M.assign_to_centers(_e(spark, d), centers)


@query(f"SELECT vec_id, cluster_id, round(distance, 6) AS distance FROM ({_ASSIGN})")
def kmeans_assign_step(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_assigned(spark, d), "distance")


@query(f"SELECT cluster_id, count(*) AS size FROM ({_ASSIGN}) GROUP BY cluster_id")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).groupBy("cluster_id").agg(F.count("*").alias("size"))


@query(f"SELECT vec_id, cluster_id, CASE cluster_id WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'cluster_' || cluster_id END AS pseudo_label FROM ({_ASSIGN})")
def pseudo_labels(spark: SparkSession, d: str) -> DataFrame:
    return M.pseudo_labels(_assigned(spark, d).select("vec_id", "cluster_id"), {0: "first", 1: "second"})


_SIL = f"""
    WITH p AS (SELECT a.vec_id, a.label AS c, b.label AS o, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM {_E} a, {_E} b GROUP BY 1, 2, 3),
    q AS (SELECT vec_id, c, max(CASE WHEN c = o AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN c <> o THEN s / n END) AS b FROM p GROUP BY 1, 2),
    sil AS (SELECT c, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS v FROM q)
"""


@query(_SIL + "SELECT c::VARCHAR AS cluster, count(*) AS n, round(avg(v), 6) AS silhouette, CASE WHEN avg(v) > 0.5 THEN 'strong' WHEN avg(v) > 0.2 THEN 'moderate' ELSE 'weak' END AS band FROM sil GROUP BY c")
def silhouette_by_label(spark: SparkSession, d: str) -> DataFrame:
    per = M.silhouette(_e(spark, d), "label").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette"))
    return _rounded(per.withColumn("band", M.silhouette_band(F.col("silhouette"))), "silhouette")


_INFLUENCE = f"""
    k AS (SELECT label, (dense_rank() OVER (ORDER BY label) - 1) AS code, count(*) AS n FROM {_E} GROUP BY label),
    tot AS (SELECT count(*) AS c, sum(n) AS n FROM k),
    cs AS (SELECT label, i, sum(e[i]) AS s FROM {_E}, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
    al AS (SELECT i, sum(s) AS s FROM cs GROUP BY i),
    w AS (SELECT label, list(10 * (cs.s - al.s / (SELECT c FROM tot)) / (SELECT n FROM tot) ORDER BY i) AS w FROM cs JOIN al USING (i) GROUP BY label),
    z AS (SELECT x.vec_id, x.label, k.label AS l, list_inner_product(x.e, w.w) + 10 * (k.n / (SELECT n FROM tot) - 1.0 / (SELECT c FROM tot)) AS z, list_inner_product(x.e, x.e) AS xx FROM {_E} x, w JOIN k USING (label)),
    pr AS (SELECT vec_id, label, l, xx, exp(z - max(z) OVER (PARTITION BY vec_id)) / sum(exp(z)) OVER (PARTITION BY vec_id) * exp(max(z) OVER (PARTITION BY vec_id)) AS p FROM z),
    inf AS (SELECT vec_id, label, sum(pow(p - CASE WHEN l = label THEN 1 ELSE 0 END, 2)) * (max(xx) + 1) AS influence FROM pr GROUP BY vec_id, label)
"""


@query(f"WITH {_INFLUENCE} SELECT vec_id, label, round(influence, 6) AS influence FROM inf")
def influence_one_step(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.influence_one_step(_e(spark, d), "label"), "influence")


@query()
def influence_trained(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.influence_trained(_e(spark, d), "label"), "influence")


@query(f"""
    WITH RECURSIVE {_DUP}, {_CENTROID}, {_INFLUENCE},
    b AS (SELECT i.vec_id, i.label, (influence - avg(influence) OVER ()) / stddev_pop(influence) OVER () AS zi, (dist - avg(dist) OVER ()) / stddev_pop(dist) OVER () AS zd,
        coalesce(c.vec_id <> c.cluster_id, false) AS dup FROM inf i JOIN dist USING (vec_id) LEFT JOIN clusters c ON c.vec_id = i.vec_id),
    s AS (SELECT vec_id, label, zi, zd, dup, zi + zd + CASE WHEN dup THEN 1 ELSE 0 END AS score FROM b)
    SELECT vec_id, label, round(score, 6) AS problem_score,
        CASE WHEN zi > 1 OR zd > 1 OR dup THEN concat_ws(', ', CASE WHEN zi > 1 THEN 'high influence' END, CASE WHEN zd > 1 THEN 'far from class centroid' END, CASE WHEN dup THEN 'duplicate' END)
        ELSE 'borderline / combined score' END AS reasons
    FROM s ORDER BY round(score, 9) DESC, vec_id LIMIT (SELECT greatest(1, floor(0.05 * count(*)))::BIGINT FROM inf)
""")
def problematic_samples(spark: SparkSession, d: str) -> DataFrame:
    out = M.problem_candidates(_e(spark, d), "label", duplicates_above=LINK)
    return _rounded(out.withColumn("reasons", F.array_join("reasons", ", ")), "problem_score")


@query()
def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.pca_projection(_e(spark, d)), "x1", "x2")


@query()
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.pca_variance(_e(spark, d)), "ratio")


@query()
def tsne_projection(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.reduce_embeddings(_e(spark, d), "tsne", whole=True), "x1", "x2")


@query()
def knn_graph_points(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return _rounded(M.knn_graph_points(M.pca_projection(e), S.knn_graph(e, 5)), "score", "src_x", "src_y", "dst_x", "dst_y")


@query(f"""
    WITH s AS (SELECT * FROM {_E} ORDER BY md5('42:' || vec_id), vec_id LIMIT 100)
    SELECT a.vec_id AS row_id, b.vec_id AS col_id, round({_COS}, 6) AS sim FROM s a, s b
""")
def similarity_heatmap(spark: SparkSession, d: str) -> DataFrame:
    s = sample_rows(_e(spark, d).select("vec_id", as_double("embedding").alias("e")), "vec_id", 100)
    a, b = s.select(F.col("vec_id").alias("row_id"), F.col("e").alias("ea")), s.select(F.col("vec_id").alias("col_id"), F.col("e").alias("eb"))
    # 100 sampled rows on each side
    return _rounded(a.crossJoin(F.broadcast(b)).select("row_id", "col_id", cosine(F.col("ea"), F.col("eb")).alias("sim")), "sim")


# -- closed forms -----------------------------------------------------------------------
# In two dimensions matrix roots and main axes have closed forms, so that SQL can check the
# operators behind the queries on all dimensions above, on every row.

_PLANE = "(SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
_OVERLAP = f"""
    m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b FROM {_PLANE} GROUP BY label),
    o AS (SELECT p.label AS class_a, q.label AS class_b, CASE WHEN p.n < 2 OR q.n < 2 THEN 0 ELSE (p.mx - q.mx) ** 2 + (p.my - q.my) ** 2 + p.a + p.d + q.a + q.d
        - 2 * sqrt(greatest(0, p.a * q.a + 2 * p.b * q.b + p.d * q.d + 2 * sqrt(greatest(0, (p.a * p.d - p.b * p.b) * (q.a * q.d - q.b * q.b))))) END AS distance FROM m p JOIN m q ON p.label < q.label)
"""


def _plane(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).withColumn("embedding", F.slice(as_double("embedding"), 1, 2))


@query(f"WITH {_OVERLAP} SELECT class_a::BIGINT AS class_a, class_b::BIGINT AS class_b, round(distance, 6) AS distance FROM o")
def class_overlap_plane(spark: SparkSession, d: str) -> DataFrame:
    """The distances of classes by the first two dimensions."""
    return _rounded(S.class_overlap(_plane(spark, d), "label"), "distance")


@query(f"""
    WITH {_OVERLAP}, i AS (SELECT avg(t) AS t FROM (SELECT avg(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS t FROM {_PLANE} p JOIN {_PLANE} q USING (label) GROUP BY label HAVING count(DISTINCT p.vec_id) > 1))
    SELECT round(any_value(t), 6) AS mean_intra_distance, round(avg(distance), 6) AS mean_inter_distance, round(any_value(t) / (avg(distance) + 1e-8), 6) AS diversity_index FROM o, i
""")
def diversity_index_plane(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.diversity_index(_plane(spark, d), "label"), "mean_intra_distance", "mean_inter_distance", "diversity_index")


_AXES = f"""
    c AS (SELECT var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b FROM {_PLANE}),
    l AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS l2 FROM c),
    u AS (SELECT *, CASE WHEN b = 0 THEN CASE WHEN a >= d THEN 1.0 ELSE 0.0 END ELSE b / sqrt(b * b + (l1 - a) ** 2) END AS ux, CASE WHEN b = 0 THEN CASE WHEN a >= d THEN 0.0 ELSE 1.0 END ELSE (l1 - a) / sqrt(b * b + (l1 - a) ** 2) END AS uy FROM l),
    axes AS (SELECT l1, l2, ux * CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) < 0 THEN -1 ELSE 1 END AS ux, uy * CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) < 0 THEN -1 ELSE 1 END AS uy FROM u),
    points AS (SELECT vec_id, label, x * ux + y * uy AS x1, (y * ux - x * uy) * CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE -uy END) < 0 THEN -1 ELSE 1 END AS x2 FROM {_PLANE}, axes)
"""


@query(f"WITH {_AXES} SELECT unnest([1, 2])::INT AS component, round(unnest([l1 / (l1 + l2), l2 / (l1 + l2)]), 6) AS ratio FROM axes")
def pca_variance_plane(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.pca_variance(_plane(spark, d)), "ratio")


@query(f'WITH {_AXES} SELECT vec_id, label AS "group", round(x1, 6) AS x1, round(x2, 6) AS x2 FROM points')
def pca_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Points of a projection with the group that colours them."""
    e = _plane(spark, d)
    points = M.reduce_embeddings(e, "pca").join(e.select("vec_id", F.col("label").alias("group")), "vec_id")
    return _rounded(points, "x1", "x2").select("vec_id", "group", "x1", "x2")


@query(f"""
    WITH {_AXES}, k AS (SELECT src, dst, r::INT AS rank, round(sim, 6) AS score FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {_COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS r FROM {_E} a, {_E} b) WHERE r <= 5)
    SELECT src, dst, rank, score, round(p.x1, 6) AS src_x, round(p.x2, 6) AS src_y, round(q.x1, 6) AS dst_x, round(q.x2, 6) AS dst_y FROM k JOIN points p ON p.vec_id = src JOIN points q ON q.vec_id = dst WHERE src <> dst
""")
def knn_graph_plane(spark: SparkSession, d: str) -> DataFrame:
    """The neighbour graph drawn on two main axes."""
    points = M.pca_projection(_plane(spark, d))
    return _rounded(M.knn_graph_points(points, S.knn_graph(_e(spark, d), 5)), "score", "src_x", "src_y", "dst_x", "dst_y")


@query("SELECT count(*) AS n_rows, 10::BIGINT AS n_clusters, 0::BIGINT AS n_nearer_elsewhere FROM embeddings")
def kmeans_facts(spark: SparkSession, d: str) -> DataFrame:
    """What any result of k-means must satisfy: every row is in the cluster whose mean is nearest."""
    e = _e(spark, d)
    found = cut(M.kmeans_clusters(e, 10), "kmeans")
    means = S.class_centroids(e.join(found, "vec_id"), "cluster_id").select(F.col("label").cast("long").alias("cluster_id"), F.col("centroid").alias("center"))
    near = M.assign_to_centers(e, means).select("vec_id", F.col("cluster_id").alias("near"))
    return found.join(near, "vec_id").agg(F.count("*").alias("n_rows"), F.count_distinct("cluster_id").alias("n_clusters"), F.count_if(F.col("cluster_id") != F.col("near")).alias("n_nearer_elsewhere"))


@query("SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_distinct, count(*) AS n_finite FROM embeddings")
def tsne_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every row has one place, and it is finite."""
    out = M.reduce_embeddings(_e(spark, d), "tsne", whole=True)
    return out.agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_distinct"), F.count_if(~F.isnan(F.col("x1") + F.col("x2"))).alias("n_finite"))
