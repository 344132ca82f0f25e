"""Clustering, influence, problem candidates and projections."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import spread
from lumenaudit.functions.vectors import as_double, dot
from lumenaudit.operators.metrics import zscores
from lumenaudit.operators.similarity import CHUNK_ROWS, _blocks, _chunks, _matrix, _scores, centroid_distances, duplicate_clusters

REAL = "unknown"


def real_classes(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is neither null nor ``unknown`` in any case."""
    return df.where(F.col(label).isNotNull() & (F.lower(F.col(label).cast("string")) != REAL))


def kmeans_clusters(vectors: DataFrame, k: int, seed: int = 42, restarts: int = 10, max_steps: int = 300, tolerance: float = 1e-9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster_id`` of the best of several k-means fits, each of ``max_steps`` steps at most or until no centre moves more than ``tolerance``. ``k`` must be at least 2 and below the number of rows."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("vec_id"), array_to_vector(as_double(vec_col)).alias("features")).persist()
    try:
        n = rows.count()
        if not 2 <= k < n:
            raise ValueError(f"k={k}: must be at least 2 and below the number of rows, {n}")
        # the fits are independent: their many short jobs run side by side
        with ThreadPoolExecutor(min(restarts, 5)) as pool:
            fits = list(pool.map(lambda i: KMeans(k=k, seed=seed + i, maxIter=max_steps, tol=tolerance).fit(rows), range(restarts)))
        best = min(fits, key=lambda m: m.summary.trainingCost)
        return best.transform(rows).select("vec_id", F.col("prediction").alias("cluster_id"))
    finally:
        rows.unpersist()


def assign_to_centers(vectors: DataFrame, centers: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster_id, distance``: the nearest of few centres (``cluster_id, center``); ties to the smaller id.

    Centres are collected once as a matrix; their number is the caller's ``k``.
    """
    rows = centers.orderBy("cluster_id").collect()
    names = np.array([r["cluster_id"] for r in rows], np.int64)
    c = np.array([r["center"] for r in rows], float)

    def nearest(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, c.shape[1]))
            d = np.round(-_scores(x, c, "euclidean"), 9)
            at = d.argmin(1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[at]), pa.array(d[np.arange(len(at)), at])], names=["vec_id", "cluster_id", "distance"])

    src = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), as_double(vec_col).alias("v"))
    return spread(src).mapInArrow(nearest, "vec_id long, cluster_id long, distance double")


def silhouette(vectors: DataFrame, cluster: str, id_col: str = "vec_id", vec_col: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``vec_id, cluster, silhouette`` with Euclidean distances; 0 in clusters of one row. Exact, chunk by chunk."""
    rows = vectors.where(F.col(vec_col).isNotNull() & F.col(cluster).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(cluster).cast("string").alias("c"), as_double(vec_col).alias("v"))
    n = _chunks(rows, chunk_rows)
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    grid = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    src = spread(rows)
    both = src.select("id", "c", "v", F.lit(True).alias("q"), own.alias("one"), grid.alias("two")).unionByName(src.select("id", "c", "v", F.lit(False).alias("q"), grid.alias("one"), own.alias("two")))

    def sums(key: tuple, group: pa.Table) -> pa.Table:
        q = group.column("q").to_numpy(zero_copy_only=False)
        ids, c = group.column("id").to_numpy(), np.array(group.column("c").to_pylist(), object)
        v = _matrix(group.column("v"))
        a, b = np.flatnonzero(q), np.flatnonzero(~q)
        names, code = np.unique(c[b].astype(str), return_inverse=True)
        out = [np.zeros(0, np.int64)], [np.zeros(0, object)], [np.zeros(0, object)], [np.zeros(0)]
        hot = np.eye(len(names))[code] if len(b) else np.zeros((0, 0))
        for r in _blocks(a, len(b)):
            s = -_scores(v[r], v[b], "euclidean") @ hot if len(b) else np.zeros((len(r), 0))
            k = s.shape[1]
            for to, part in zip(out, (np.repeat(ids[r], k), np.repeat(c[r], k), np.tile(names.astype(object), len(r)), s.ravel())):
                to.append(part)
        ids, c, o, total = (np.concatenate(x) for x in out)
        return pa.table({"id": pa.array(ids, pa.int64()), "c": pa.array(c, pa.string()), "o": pa.array(o, pa.string()), "s": pa.array(total, pa.float64())})

    # one row per query row and cluster of its chunk pair, added up before they are shuffled
    part = both.groupBy("one", "two").applyInArrow(sums, "id long, c string, o string, s double").groupBy("id", "c", "o").agg(F.sum("s").alias("s"))
    sizes = rows.groupBy(F.col("c").alias("o")).agg(F.count("*").alias("n"))
    per = part.join(sizes, "o")
    same = F.col("c") == F.col("o")
    inner = F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1)))
    outer = F.min(F.when(~same, F.col("s") / F.col("n")))
    ab = per.groupBy("id", "c").agg(inner.alias("a"), outer.alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return ab.select(F.col("id").alias("vec_id"), F.col("c").alias("cluster"), F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def silhouette_band(value: Column) -> Column:
    """Words for a mean silhouette."""
    return F.when(value > 0.5, "strong").when(value > 0.2, "moderate").otherwise("weak")


def pseudo_labels(assigned: DataFrame, names: Mapping[int, str] | None = None) -> DataFrame:
    """Adds ``pseudo_label``: the cluster's given name, else ``cluster_<id>``."""
    default = F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string"))
    if not names:
        return assigned.withColumn("pseudo_label", default)
    given = F.create_map(*[F.lit(x) for k, v in names.items() for x in (int(k), v)])
    return assigned.withColumn("pseudo_label", F.coalesce(F.try_element_at(given, F.col("cluster_id").cast("int")), default))


def gradient_norms(prob: Column, code: Column, vec: Column) -> Column:
    """Squared gradient norm of one sample in a linear softmax model: ``|p - e_y|^2 (|x|^2 + 1)``."""
    off = F.aggregate(F.transform(prob, lambda p, i: F.pow(p - F.when(i == code, 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    return off * (dot(vec, vec) + 1)


def _coded(vectors: DataFrame, label: str, id_col: str, vec_col: str) -> tuple[DataFrame, list]:
    """Real-class rows ``vec_id, label, code, x`` and the sorted classes (the caller's label set)."""
    rows = real_classes(vectors, label).where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), as_double(vec_col).alias("x"))
    classes = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    if len(classes) < 2:
        raise ValueError("at least two real classes are needed")
    codes = vectors.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"label {rows.schema['label'].dataType.simpleString()}, code int")
    return rows.join(F.broadcast(codes), "label"), classes


def influence_one_step(vectors: DataFrame, label: str, rate: float = 10.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, label, influence``: gradient norms after one full-batch step from zero weights, fully deterministic.

    The step's weights are ``rate`` times the mean of ``(e_y - 1/C) x``: class sums of
    the vectors, one row per class and dimension, reach the driver.
    """
    rows, classes = _coded(vectors, label, id_col, vec_col)
    dims = rows.select("code", F.posexplode("x").alias("d", "v")).groupBy("code", "d").agg(F.sum("v").alias("s")).collect()
    counts = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count("*").alias("n")).collect()}
    k, total = len(classes), sum(counts.values())
    width = max((r["d"] for r in dims), default=-1) + 1
    s = np.zeros((k, width))
    for r in dims:
        s[r["code"], r["d"]] = r["s"]
    w = rate * (s - s.sum(0) / k) / total
    b = rate * (np.array([counts[i] for i in range(k)]) / total - 1 / k)
    logits = F.array(*[dot(F.col("x"), F.array(*[F.lit(float(y)) for y in w[i]])) + float(b[i]) for i in range(k)])
    exps = F.transform(F.col("z"), lambda z: F.exp(z - F.array_max("z")))
    prob = F.transform(F.col("e"), lambda e: e / F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    scored = rows.withColumn("z", logits).withColumn("e", exps).withColumn("p", prob)
    return scored.select("vec_id", "label", gradient_norms(F.col("p"), F.col("code"), F.col("x")).alias("influence"))


def influence_trained(vectors: DataFrame, label: str, rounds: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, label, influence`` with the probabilities of a multinomial logistic regression of ``rounds`` iterations."""
    rows, _ = _coded(vectors, label, id_col, vec_col)
    data = rows.withColumn("features", array_to_vector("x"))
    model = LogisticRegression(maxIter=rounds, family="multinomial", labelCol="code", standardization=False).fit(data)
    p = model.transform(data).withColumn("p", vector_to_array("probability"))
    return p.select("vec_id", "label", gradient_norms(F.col("p"), F.col("code"), F.col("x")).alias("influence"))


def problem_candidates(vectors: DataFrame, label: str, top_fraction: float = 0.05, duplicates_above: float | None = 0.95, influence: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, label, problem_score, reasons``: the top ``max(1, floor(fraction * n))`` real-class rows, ties by id.

    Score: z of influence plus z of the distance to the class centroid (0 in classes below
    3 rows), plus 1 for duplicates that do not represent their cluster. Reasons name each
    z above 1 and duplicates; otherwise ``borderline / combined score``.
    """
    rows = real_classes(vectors, label)
    inf = influence_one_step(rows, label, id_col=id_col, vec_col=vec_col) if influence is None else influence
    dist = centroid_distances(rows, label, id_col, vec_col, 3).select("vec_id", F.col("distance").alias("d"))
    base = inf.join(dist, "vec_id", "left").select("vec_id", "label", "influence", F.coalesce("d", F.lit(0.0)).alias("distance"))
    z = zscores(base, ["influence", "distance"], False)
    if duplicates_above is not None:
        dup = duplicate_clusters(rows, duplicates_above, id_col, vec_col).where("vec_id <> cluster_id").select("vec_id", F.lit(True).alias("dup"))
        z = z.join(dup, "vec_id", "left").withColumn("dup", F.coalesce("dup", F.lit(False)))
    else:
        z = z.withColumn("dup", F.lit(False))
    score = F.col("z_influence") + F.col("z_distance") + F.when(F.col("dup"), 1.0).otherwise(0.0)
    named = F.array_compact(F.array(F.when(F.col("z_influence") > 1, "high influence"), F.when(F.col("z_distance") > 1, "far from class centroid"), F.when(F.col("dup"), "duplicate")))
    reasons = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("borderline / combined score")))
    scored = z.select("vec_id", "label", score.alias("problem_score"), reasons.alias("reasons"))
    n = max(1, int(top_fraction * inf.count()))
    return scored.orderBy(F.desc(F.round("problem_score", 9)), "vec_id").limit(n)


def pca_projection(vectors: DataFrame, n: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x1..xn``: main components; each component's sign makes its largest loading positive."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("vec_id"), array_to_vector(as_double(vec_col)).alias("features"))
    model = PCA(k=n, inputCol="features", outputCol="pc").fit(rows)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(0), np.arange(n)])
    a = vector_to_array("pc")
    return model.transform(rows).select("vec_id", *[(a[i] * float(sign[i] or 1)).alias(f"x{i + 1}") for i in range(n)])


def pca_variance(vectors: DataFrame, most: int = 30, vec_col: str = "embedding") -> DataFrame:
    """``component, ratio`` of explained variance, at most ``most`` components."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(array_to_vector(as_double(vec_col)).alias("features"))
    dim = len(rows.first()["features"])
    model = PCA(k=min(most, dim), inputCol="features", outputCol="pc").fit(rows)
    return vectors.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)], "component int, ratio double")


def tsne_points(x: np.ndarray, n: int = 2, perplexity: float = 30.0, rounds: int = 300, seed: int = 42) -> np.ndarray:
    """t-SNE of a small matrix; there is no distributed form, so callers sample first."""
    m = len(x)
    norms = (x * x).sum(1)
    sq = np.maximum(norms[:, None] + norms[None] - 2 * (x @ x.T), 0)
    p = np.zeros((m, m))
    for i in range(m):
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            e = np.exp(-sq[i] * beta)
            e[i] = 0
            q = e / max(e.sum(), 1e-12)
            gap = -(q[q > 0] * np.log(q[q > 0])).sum() - np.log(min(perplexity, max(2, (m - 1) / 3)))
            if abs(gap) < 1e-5:
                break
            low, high = (beta, high) if gap > 0 else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * m), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (m, n))
    v = np.zeros_like(y)
    for t in range(rounds):
        num = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(num, 0)
        q = np.maximum(num / num.sum(), 1e-12)
        g = 4 * (((p * (12 if t < 100 else 1) - q) * num)[:, :, None] * (y[:, None] - y[None])).sum(1)
        v = (0.5 if t < 100 else 0.8) * v - max(m / 12, 20) * g
        y = y + v
    return y


def reduce_embeddings(vectors: DataFrame, method: str = "pca", n: int = 2, seed: int = 42, most: int = 1500, id_col: str = "vec_id", vec_col: str = "embedding", whole: bool = False) -> DataFrame:
    """``vec_id, x1..xn`` by ``pca`` (all rows), or by ``tsne`` of at most ``most`` rows chosen by hash.

    ``whole``: t-SNE, too, gives all rows; one that is not in the fitted sample is placed
    among its 5 exact nearest fitted rows (Euclidean; ties to the smaller id), weighted by
    the inverse of the distance, or on the mean of those it equals.
    """
    if method == "pca":
        return pca_projection(vectors, n, id_col, vec_col)
    if method != "tsne":
        raise ValueError(f"method={method!r}: pca or tsne (umap needs a package that is not present)")
    src = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), as_double(vec_col).alias("v"))
    rows = src.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string"))), "vec_id").limit(most).collect()
    schema = ", ".join(["vec_id long", *[f"x{i + 1} double" for i in range(n)]])
    y = tsne_points(np.array([r["v"] for r in rows], float), n, seed=seed) if rows else np.zeros((0, n))
    if not whole or not rows:
        return vectors.sparkSession.createDataFrame([(r["vec_id"], *map(float, p)) for r, p in zip(rows, y)], schema)
    by = np.argsort([r["vec_id"] for r in rows], kind="stable")
    ids, x, y = np.array([r["vec_id"] for r in rows], np.int64)[by], np.array([r["v"] for r in rows], float)[by], y[by]

    def place(batches):  # noqa: ANN001, ANN202
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, x.shape[1])
            out = np.zeros((len(own), n))
            for at in range(0, len(own), 1024):
                d = np.round(-_scores(v[at : at + 1024], x, "euclidean"), 9)
                near = np.argsort(d, 1, kind="stable")[:, :5]
                d = np.take_along_axis(d, near, 1)
                w = np.where((d == 0).any(1, keepdims=True), d == 0, 1 / np.where(d > 0, d, 1))
                out[at : at + 1024] = (y[near] * w[:, :, None]).sum(1) / w.sum(1)[:, None]
            # fitted rows keep their own place
            k = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            fitted = ids[k] == own
            out[fitted] = y[k[fitted]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *[pa.array(c) for c in out.T]], names=["vec_id", *[f"x{i + 1}" for i in range(n)]])

    return spread(src).mapInArrow(place, schema)


def knn_graph_points(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of a neighbour graph with the coordinates of both ends, ready to draw."""
    a = points.select(F.col("vec_id").alias("src"), F.col("x1").alias("src_x"), F.col("x2").alias("src_y"))
    b = points.select(F.col("vec_id").alias("dst"), F.col("x1").alias("dst_x"), F.col("x2").alias("dst_y"))
    return edges.where("src <> dst").join(a, "src").join(b, "dst").select("src", "dst", "rank", "score", "src_x", "src_y", "dst_x", "dst_y")
