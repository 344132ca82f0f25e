"""Exact similarity joins, nearest neighbours and what is built on them.

The joins compare all rows in blocks: ids are dealt to chunks of bounded size, every pair
of chunks is one task that multiplies two small matrices. Nothing is broadcast and no
task grows with the table; the work is quadratic because the result is exact. Only the
rows asked for (the k best, or pairs above a bound) leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.functions.groups import similar_groups
from lumenaudit.functions.runtime import cut, spread
from lumenaudit.functions.vectors import as_double, euclidean, norm
from lumenaudit.operators.components import connected_components
from lumenaudit.operators.order_statistics import percentiles_of
from lumenaudit.operators.raster import Embedder, embed_images

#: Rows of a chunk at most. Every row is sent to as many tasks as there are chunks.
CHUNK_ROWS = 16384


def _rows(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    # floats travel as they are, at half the size, and are widened in the task
    v = F.col(vec_col) if dict(df.dtypes)[vec_col] in ("array<float>", "array<double>") else as_double(vec_col)
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *more)


def _chunks(df: DataFrame, chunk_rows: int) -> int:
    """Chunks of a table: none above ``chunk_rows``, and enough for pairs of them to fill the cores."""
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // chunk_rows), min(math.ceil(math.sqrt(2 * cores)), n // 256))


def _blocks(rows: np.ndarray, cols: int) -> Iterator[np.ndarray]:
    """Rows in runs whose product with ``cols`` columns stays small."""
    step = max(16, min(512, (1 << 22) // max(1, cols)))
    for at in range(0, len(rows), step):
        yield rows[at : at + step]


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    n = len(col)
    col = pa.chunked_array(col).combine_chunks() if not isinstance(col, pa.ChunkedArray) else col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / length


def _scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer; NaN where undefined (a zero vector has no cosine)."""
    if metric == "cosine":
        return _unit(a) @ _unit(b).T
    if metric == "dot":
        return a @ b.T
    if metric == "euclidean":
        sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        near = np.sqrt(np.maximum(sq, 0))
        # differences lose digits when vectors are close: those are computed directly
        r, c = np.nonzero(sq < 1e-6 * np.maximum(1e-300, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]))
        near[r, c] = np.sqrt(((a[r] - b[c]) ** 2).sum(1))
        return -near
    raise ValueError(f"metric={metric!r}: cosine, dot or euclidean")


def _chunk_pairs(queries: DataFrame, base: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows of both sides with the pair of chunks they meet in: ``one`` of queries, ``two`` of base."""
    nq, nb = (_chunks(d, chunk_rows) for d in (queries, base))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = spread(queries).select("id", "v", F.lit(True).alias("q"), own(nq).alias("one"), grid(nb).alias("two"))
    b = spread(base).select("id", "v", F.lit(False).alias("q"), grid(nq).alias("one"), own(nb).alias("two"))
    return q.unionByName(b)


def knn_join(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "cosine", exclude_self: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``src, dst, rank, score``: the ``k`` nearest rows of ``base`` for every query, exact.

    ``score`` is the cosine, the inner product or the Euclidean distance. Ties go to the
    smaller id. Rows with the query's own id are left out by id, not by position, unless
    ``exclude_self`` is false. Null ids and vectors take no part, nor do zero vectors
    under the cosine; fewer than ``k`` base rows give fewer neighbours. Vectors must have
    one length; ids must be unique on each side.
    """
    q, b = _rows(queries, id_col, vec_col), _rows(base, id_col, vec_col)
    found = _chunk_pairs(q, b, chunk_rows).groupBy("one", "two").applyInArrow(lambda group: best_in_group(group, k, metric, exclude_self), "src long, dst long, score double")
    return merge_best(found, k, metric)


def best_in_group(group: pa.Table, k: int, metric: str, exclude_self: bool) -> pa.Table:
    """``src, dst, score`` of the ``k`` nearest rows without the flag ``q`` for each row with it."""
    is_q = group.column("q").to_numpy(zero_copy_only=False)
    ids = group.column("id").to_numpy()
    qi, bi = np.flatnonzero(is_q), np.flatnonzero(~is_q)
    src, dst, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(qi) and len(bi):
        bi = bi[np.argsort(ids[bi], kind="stable")]
        v = _matrix(group.column("v"))
        for rows in _blocks(qi, len(bi)):
            # ties are decided on rounded scores, as sums of products differ in the last digits
            raw = _scores(v[rows], v[bi], metric)
            s = np.round(raw, 9)
            gone = np.isnan(s) | ((ids[rows][:, None] == ids[bi][None, :]) & exclude_self)
            s[gone] = -np.inf
            n = min(k, s.shape[1])
            order = np.argsort(-s, 1, kind="stable")[:, :n] if n * 8 > s.shape[1] else _top(s, n)
            val = np.take_along_axis(s, order, 1)
            r, c = np.nonzero(np.isfinite(val))
            src.append(ids[rows][r]), dst.append(ids[bi][order[r, c]]), score.append(raw[r, order[r, c]])
    return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "score": np.concatenate(score)})


def merge_best(found: DataFrame, k: int, metric: str) -> DataFrame:
    """``src, dst, rank, score``: the ``k`` best of what several groups found for a query."""
    sign = -1.0 if metric == "euclidean" else 1.0
    order = Window.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "dst", "rank", (F.lit(sign) * F.col("score")).alias("score"))


def _top(s: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest values of each row, ties to the first column."""
    edge = np.partition(s, s.shape[1] - n, 1)[:, -n][:, None]
    out = np.empty((len(s), n), np.int64)
    for i in range(len(s)):
        c = np.flatnonzero(s[i] >= edge[i])
        out[i] = c[np.argsort(-s[i, c], kind="stable")[:n]]
    return out


def similar_pairs(vectors: DataFrame, above: float, id_col: str = "vec_id", vec_col: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``src, dst, sim`` with ``src < dst``: all pairs with a cosine strictly above ``above``.

    The result lists every pair; for groups of many copies use ``duplicate_clusters``,
    which never does. Ids must be unique.
    """

    def above_bound(key: tuple, group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        is_q = group.column("q").to_numpy(zero_copy_only=False)
        u = _unit(_matrix(group.column("v")))
        a, b = np.flatnonzero(is_q), np.flatnonzero(~is_q)
        src, dst, sim = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for rows in _blocks(a, len(b)):
            s = u[rows] @ u[b].T
            r, c = np.nonzero((s > above) & (ids[rows][:, None] < ids[b][None, :]))
            src.append(ids[rows][r]), dst.append(ids[b][c]), sim.append(s[r, c])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "sim": np.concatenate(sim)})

    rows = _rows(vectors, id_col, vec_col)
    return _chunk_pairs(rows, rows, chunk_rows).groupBy("one", "two").applyInArrow(above_bound, "src long, dst long, sim double")


def duplicate_clusters(vectors: DataFrame, above: float = 0.90, id_col: str = "vec_id", vec_col: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``cluster_id, vec_id``: clusters that chains of pairs with a cosine above ``above`` join; single rows are left out.

    ``cluster_id`` is the smallest member. Each pair of chunks is reduced to its local
    groups, so a large cluster sends one row per member and chunk pair. Zero and null
    vectors are in no cluster.
    """
    rows = _rows(vectors, id_col, vec_col).where(norm(as_double("v")) > 0)
    n = _chunks(rows, chunk_rows)
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    cross = spread(rows).select("id", "v", own.alias("o"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("x"))
    placed = cross.select("id", "v", F.least("o", "x").alias("one"), F.greatest("o", "x").alias("two"))

    def local(key: tuple, group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        label = similar_groups(_unit(_matrix(group.column("v")))[order], above, True)
        ids = ids[order]
        on = label >= 0
        return pa.table({"src": ids[on], "dst": ids[label[on]]})

    links = placed.groupBy("one", "two").applyInArrow(local, "src long, dst long")
    return connected_components(links).select(F.col("root").alias("cluster_id"), F.col("node").alias("vec_id"))


def summarize_duplicates(clusters: DataFrame, names: DataFrame | None = None, name_col: str = "name") -> DataFrame:
    """``representative, duplicates, count``: the smallest member and the others in order, as ids or, with ``names`` (``vec_id, name``), as names."""
    rows = clusters if names is None else clusters.join(names.select("vec_id", name_col), "vec_id")
    item = F.col("vec_id") if names is None else F.col(name_col)
    per = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("i"), item.alias("x")))).alias("m"))
    return per.select(F.col("m")[0]["x"].alias("representative"), F.transform(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), lambda e: e["x"]).alias("duplicates"), F.size("m").cast("long").alias("count"))


def near_neighbors(vectors: DataFrame, above: float = 0.95, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``src, dst, rank, score``: of each row's ``k`` nearest others those above the bound, as ids."""
    return knn_join(vectors, vectors, k, id_col, vec_col).where(F.col("score") > above)


def knn_graph(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every row, itself included."""
    return knn_join(vectors, vectors, k, id_col, vec_col, exclude_self=False)


# -- labels ---------------------------------------------------------------------------


def propagate_labels(vectors: DataFrame, label: str, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, pred_label, confidence`` of unlabelled rows: the majority of the ``k`` nearest labelled rows.

    Ties of the vote go to the smallest label; confidence is the winner's part of the
    votes. Without labelled rows (or without neighbours) the label is null, confidence 0.
    """
    known, open_ = vectors.where(F.col(label).isNotNull()), vectors.where(F.col(label).isNull())
    near = knn_join(open_, known, k, id_col, vec_col)
    votes = near.join(known.select(F.col(id_col).alias("dst"), F.col(label).alias("l")), "dst").groupBy("src", "l").agg(F.count("*").alias("n"))
    won = votes.groupBy("src").agg(F.min_by("l", F.struct(-F.col("n"), "l")).alias("pred_label"), (F.max("n") / F.sum("n")).alias("confidence"))
    return open_.select(F.col(id_col).alias("vec_id")).join(won, F.col("vec_id") == F.col("src"), "left").select("vec_id", "pred_label", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def filter_pseudo_labels(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds ``final_label``: the predicted label where the confidence reaches the threshold."""
    return df.withColumn("final_label", F.when(F.col("confidence") >= threshold, F.col("pred_label")))


def relabel(vectors: DataFrame, label: str, k: int = 5, threshold: float = 0.7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, original_label, pred_label, final_label, confidence, resolved_label``.

    Labelled rows keep confidence 0, so their ``final_label`` is null unless the threshold
    is 0; ``resolved_label`` is the original, else the final label, else ``unknown``.
    """
    done = vectors.where(F.col(label).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(label).cast("string").alias("original_label"), F.col(label).cast("string").alias("pred_label"), F.lit(0.0).alias("confidence"))
    new = propagate_labels(vectors, label, k, id_col, vec_col).select("vec_id", F.lit(None).cast("string").alias("original_label"), F.col("pred_label").cast("string").alias("pred_label"), "confidence")
    out = filter_pseudo_labels(done.unionByName(new), threshold)
    return out.withColumn("resolved_label", F.coalesce("original_label", "final_label", F.lit("unknown")))


# -- outliers and diversity -------------------------------------------------------------


def class_centroids(vectors: DataFrame, label: str, vec_col: str = "embedding") -> DataFrame:
    """``label, centroid, n``: element-wise means, summed partially before the shuffle."""
    rows = vectors.where(F.col(label).isNotNull() & F.col(vec_col).isNotNull())
    dims = rows.select(F.col(label).alias("label"), F.posexplode(as_double(vec_col)).alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("centroid"), F.max("n").alias("n"))


def centroid_distances(vectors: DataFrame, label: str, id_col: str = "vec_id", vec_col: str = "embedding", least: int = 1) -> DataFrame:
    """``vec_id, label, distance`` to the centroid of the row's class, of classes with ``least`` rows or more."""
    c = class_centroids(vectors, label, vec_col).where(F.col("n") >= least)
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), as_double(vec_col).alias("v"))
    return rows.join(c, "label").select("vec_id", "label", euclidean(F.col("v"), F.col("centroid")).alias("distance"))


def centroid_outliers(vectors: DataFrame, label: str, top_k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``top_k`` members of each class farthest from its centroid; classes of fewer than 3 are left out; ties by id."""
    order = Window.partitionBy("label").orderBy(F.desc(F.round("distance", 9)), "vec_id")
    return centroid_distances(vectors, label, id_col, vec_col, 3).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def knn_outlier_scores(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, score``: mean Euclidean distance of the ``k`` nearest other rows."""
    near = knn_join(vectors, vectors, k, id_col, vec_col, "euclidean")
    return near.groupBy(F.col("src").alias("vec_id")).agg(F.avg("score").alias("score"))


def flag_outliers(scores: DataFrame, fraction: float = 0.95) -> DataFrame:
    """Adds ``status``: ``Outlier`` from the exact quantile of the scores on, else ``Normal``."""
    # written once: the scores are read by the sort and again by the comparison
    scores = cut(scores, "scores")
    cut_at = percentiles_of(scores, [], "score", [fraction]).select(F.col("p0").alias("_q"))
    return scores.crossJoin(F.broadcast(cut_at)).withColumn("status", F.when(F.col("score") >= F.col("_q"), "Outlier").otherwise("Normal")).drop("_q")


def intra_class_diversity(vectors: DataFrame, label: str, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``class, n_samples, mean_distance, variance_distance`` of all ordered pairs of a class.

    The zero distance of a row to itself counts unless ``exclude_self``. Classes of fewer
    than 2 rows are left out. A class is compared as pairs of chunks, however large it is.
    """
    rows = vectors.where(F.col(label).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("class"), as_double(vec_col).alias("v"))
    sizes = rows.groupBy("class").agg(F.count("*").alias("n")).where("n >= 2")
    m = F.ceil(F.col("n") / chunk_rows).cast("int")
    keyed = spread(rows).join(sizes, "class").select("class", "n", "v", F.pmod(F.xxhash64("id"), m).cast("int").alias("o"), F.explode(F.sequence(F.lit(0), m - 1)).alias("x"))
    placed = keyed.select("class", "n", "v", "o", F.least("o", "x").alias("one"), F.greatest("o", "x").alias("two"))

    def sums(key: tuple, group: pa.Table) -> pa.Table:
        v, o = _matrix(group.column("v")), group.column("o").to_numpy()
        one, two = key[1].as_py(), key[2].as_py()
        a, b = v[o == one], v[o == two]
        total = square = 0.0
        for rows in _blocks(np.arange(len(a)), len(b)):
            d = -_scores(a[rows], b, "euclidean")
            total += float(d.sum())
            square += float((d * d).sum())
        both = 1.0 if one == two else 2.0
        return pa.table({"class": pa.array([key[0].as_py()], kind), "n": [group.column("n")[0].as_py()], "s": [both * total], "q": [both * square]})

    kind = pa.string() if dict(vectors.dtypes)[label] == "string" else pa.int64()
    name = "string" if kind == pa.string() else "long"
    placed = placed.withColumn("class", F.col("class").cast(name))
    part = placed.groupBy("class", "one", "two").applyInArrow(sums, f"class {name}, n long, s double, q double")
    per = part.groupBy("class").agg(F.first("n").alias("n_samples"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    pairs = F.col("n_samples") * (F.col("n_samples") - (1 if exclude_self else 0))
    mean = F.col("s") / pairs
    return per.select("class", "n_samples", mean.alias("mean_distance"), (F.col("q") / pairs - mean * mean).alias("variance_distance"))


def class_moments(vectors: DataFrame, label: str, vec_col: str = "embedding") -> DataFrame:
    """``class, n, mean, cov``: means and sample covariances (row by row) of each class.

    Every partition sends one sum of outer products per class, so the rows of a class are
    never gathered. Classes of one row have a null covariance.
    """
    kind = dict(vectors.dtypes)[label]
    name = "string" if kind == "string" else "long"
    ptype = pa.string() if name == "string" else pa.int64()
    rows = vectors.where(F.col(label).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(label).cast(name).alias("class"), as_double(vec_col).alias("v"))

    def partial(batches):  # noqa: ANN001, ANN202
        held: dict[object, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            labels = np.array(b.column(0).to_pylist(), object)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(labels), -1)
            for c in dict.fromkeys(labels.tolist()):
                y = x[labels == c]
                h = held.setdefault(c, [0, 0.0, 0.0])
                h[0] += len(y)
                h[1] = h[1] + y.sum(0)
                h[2] = h[2] + y.T @ y
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), ptype), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1].tolist() for h in held.values()]), pa.array([h[2].ravel().tolist() for h in held.values()])], names=["class", "n", "s", "q"])

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        n = sum(group.column("n").to_pylist())
        s, q = _matrix(group.column("s")).sum(0), _matrix(group.column("q")).sum(0).reshape(-1, len(group.column("s")[0]))
        mean = s / n
        cov = ((q - n * np.outer(mean, mean)) / (n - 1)).ravel().tolist() if n > 1 else None
        return pa.table({"class": pa.array([key[0].as_py()], ptype), "n": [n], "mean": [mean.tolist()], "cov": pa.array([cov], pa.list_(pa.float64()))})

    return spread(rows).mapInArrow(partial, f"class {name}, n long, s array<double>, q array<double>").groupBy("class").applyInArrow(whole, f"class {name}, n long, mean array<double>, cov array<double>")


def frechet_distance(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray) -> float:
    """Squared distance of the means plus ``tr(A + B - 2 sqrt(AB))``; eigenvalues below 0 count as 0."""
    w, q = np.linalg.eigh(cov_a)
    root = (q * np.sqrt(np.clip(w, 0, None))) @ q.T
    cross = np.linalg.eigvalsh(root @ cov_b @ root)
    return float(((mean_a - mean_b) ** 2).sum() + np.trace(cov_a) + np.trace(cov_b) - 2 * np.sqrt(np.clip(cross, 0, None)).sum())


def class_overlap(vectors: DataFrame, label: str, vec_col: str = "embedding", missing: float | None = 0.0) -> DataFrame:
    """``class_a, class_b, distance`` of every two classes, ``class_a < class_b``; pairs with a class of one row get ``missing``."""
    m = class_moments(vectors, label, vec_col)
    a, b = m.select(*[F.col(c).alias(f"{c}_a") for c in m.columns]), m.select(*[F.col(c).alias(f"{c}_b") for c in m.columns])
    pairs = a.join(b, F.col("class_a") < F.col("class_b"))
    name = dict(m.dtypes)["class"]

    def distances(batches):  # noqa: ANN001, ANN202
        for t in batches:
            rows = t.to_pylist()
            out = []
            for r in rows:
                if r["cov_a"] is None or r["cov_b"] is None:
                    out.append(missing)
                    continue
                d = len(r["mean_a"])
                out.append(frechet_distance(np.array(r["mean_a"]), np.array(r["cov_a"]).reshape(d, d), np.array(r["mean_b"]), np.array(r["cov_b"]).reshape(d, d)))
            yield pa.RecordBatch.from_arrays([t.column("class_a"), t.column("class_b"), pa.array(out, pa.float64())], names=["class_a", "class_b", "distance"])

    return pairs.mapInArrow(distances, f"class_a {name}, class_b {name}, distance double")


def diversity_index(vectors: DataFrame, label: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row: mean distance within classes, mean Fréchet distance between them, and their ratio."""
    inside = intra_class_diversity(vectors, label, id_col, vec_col).agg(F.avg("mean_distance").alias("mean_intra_distance"))
    between = class_overlap(vectors, label, vec_col).agg(F.avg("distance").alias("mean_inter_distance"))
    return inside.crossJoin(between).withColumn("diversity_index", F.col("mean_intra_distance") / (F.coalesce("mean_inter_distance", F.lit(0.0)) + 1e-8))


def label_images(images: DataFrame, samples: DataFrame, embedder: str | Callable[[], Embedder] = "histogram", k: int = 5, threshold: float = 0.7) -> DataFrame:
    """From images and partly labelled samples to labels in one call.

    ``samples`` has ``vec_id, path, label``, ``images`` has ``path, image``. Images are
    embedded, unlabelled ones get the vote of their ``k`` nearest labelled ones, and votes
    below ``threshold`` stay ``unknown``. The result is that of ``relabel`` with ``path``;
    samples whose image cannot be decoded have no row.
    """
    vectors = cut(embed_images(images, embedder).join(samples.select("vec_id", "path", "label"), "path"), "embedded")
    return relabel(vectors, "label", k, threshold).join(vectors.select("vec_id", "path"), "vec_id")
