"""Clusters of mutually similar vectors.

Vectors are reduced to their main components (fitted on a bounded sample) and the reduced
space is divided in two steps among pivots that lie apart: few wide regions, and cells in
each. A vector belongs to the cell of its nearest pivot and, as its margin, to the further
cells whose pivots are almost as near. Cells are compared on the full vectors, one or two
chunks of bounded size at a time. A task knows for certain which of its rows are core
points when it sees enough neighbours; of the others it sends their few neighbours on, so
counts are made over all tasks together: neither chunks nor cells change which rows are
core. Clusters grow over core points only, local ones that share a core point are one, and
a row that is no core belongs to the cluster of a core in its reach. Representatives are
the medoids: the members most similar to the mean of their cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.functions.groups import Groups
from lumenaudit.functions.labels import label_key
from lumenaudit.functions.runtime import cut, drop_cut, spread
from lumenaudit.functions.vectors import dot, is_usable, l2_normalize, list_matrix, pack16, unit, unpack16
from lumenaudit.llm.cells import PLACED, by_cell, cell_counts, chunk_of, placed
from lumenaudit.operators.components import connected_components

#: Regions, and cells of one region, at most.
WIDE, FINE = 256, 256


class Pivots:
    """The division of the reduced space: regions around pivots, and cells around each region's own pivots."""

    def __init__(self, sample: np.ndarray, axes: int, wanted: int, apart: float) -> None:
        _, vectors = np.linalg.eigh(sample.T @ sample)
        self.basis = vectors[:, ::-1][:, :axes]
        reduced = self.reduce(sample)
        wide = wanted if wanted <= WIDE else min(WIDE, int(np.ceil(np.sqrt(wanted))))
        self.regions = reduced[leaders(reduced, wide, apart)]
        self.cells: list[np.ndarray] | None = None
        if wanted > WIDE:
            own = (reduced @ self.regions.T).argmax(1)
            self.cells = []
            for r in range(len(self.regions)):
                mine = reduced[own == r]
                # a region that holds more of the sample is divided further
                share = min(FINE, max(1, round(wanted * len(mine) / len(reduced))))
                self.cells.append(mine[farthest(mine, share)])
        self.first = np.r_[0, np.cumsum([len(c) for c in self.cells])] if self.cells is not None else np.arange(len(self.regions) + 1)

    def reduce(self, units: np.ndarray) -> np.ndarray:
        return unit((units @ self.basis).astype(np.float64) + 1e-12)

    def place(self, units: np.ndarray, margin: float, most: int) -> np.ndarray:
        """The cells of each row, its own first; -1 where there are fewer than ``most``."""
        x = self.reduce(units)
        top, score = _best(x @ self.regions.T, most)
        if self.cells is None:
            return np.where(score >= score[:, :1] - margin, top, -1)
        cell, value = np.full((len(x), most * most), -1, np.int64), np.full((len(x), most * most), -9.0)
        near = score >= score[:, :1] - margin
        for r in np.unique(top[near]):
            rows, slot = np.nonzero((top == r) & near)
            at, s = _best(x[rows] @ self.cells[r].T, most)
            cols = slot[:, None] * most + np.arange(at.shape[1])
            cell[rows[:, None], cols] = at + self.first[r]
            value[rows[:, None], cols] = s
        best, s = _best(value, most)
        best = np.take_along_axis(cell, best, 1)
        return np.where(s >= s[:, :1] - margin, best, -1)


def _best(score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``most`` largest scores of each row, largest first."""
    most = min(most, score.shape[1])
    top = np.argpartition(-score, most - 1, 1)[:, :most]
    s = np.take_along_axis(score, top, 1)
    by = np.argsort(-s, 1, kind="stable")
    return np.take_along_axis(top, by, 1), np.take_along_axis(s, by, 1)


def leaders(x: np.ndarray, wanted: int, apart: float) -> list[int]:
    """Rows of the sample that lie apart, in its order; at most ``wanted``."""
    free = np.ones(len(x), bool)
    out = []
    for i in range(len(x)):
        if free[i]:
            out.append(i)
            if len(out) == wanted:
                break
            free &= x @ x[i] < apart
    return out


def farthest(x: np.ndarray, wanted: int) -> list[int]:
    """Rows chosen one after the other, each the one farthest from those before it."""
    out, near = [], np.full(len(x), -2.0)
    for _ in range(min(wanted, len(x))):
        i = int(near.argmin())
        if near[i] > 1 - 1e-9:
            break
        out.append(i)
        near = np.maximum(near, x @ x[i])
    return out


def dense_part(units: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, min_points: int, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core rows, their group, row, neighbour) of the pairs of ``left`` and ``right``: one set, or two without a row in common.

    Core are rows that have ``min_points`` rows, themselves included, in reach here; links
    of two cores join groups. Of every other row its neighbours are listed, fewer than
    ``min_points - 1``. Single-precision products find links; those within 1e-5 of the
    bound are computed again in double precision and rounded to 6 places.
    """
    f = np.ascontiguousarray(units.astype(np.float32))
    same = left is right
    near = np.zeros(len(units), np.int64)

    def reach(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        s = f[rows] @ f[cols].T
        hit = s >= least
        r, c = np.nonzero(np.abs(s - np.float32(least)) < 1e-5)
        for at in range(0, len(r), 1 << 15):
            i, j = r[at : at + (1 << 15)], c[at : at + (1 << 15)]
            hit[i, j] = np.round(np.einsum("ij,ij->i", units[rows[i]], units[cols[j]]), 6) >= least
        if same:
            hit &= rows[:, None] != cols[None, :]
        return hit

    for at in range(0, len(left), block):
        rows = left[at : at + block]
        hit = reach(rows, right)
        near[rows] += hit.sum(1)
        if not same:
            near[right] += hit.sum(0)
    core = near >= min_points - 1
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for one, two in ((left, right),) if same else ((left, right), (right, left)):
        few = one[(near[one] > 0) & ~core[one]]
        for at in range(0, len(few), block):
            r, c = np.nonzero(reach(few[at : at + block], two))
            src.append(few[at : at + block][r]), dst.append(two[c])
    groups = Groups(len(units))
    open_, others = left[core[left]], right[core[right]]
    while len(open_) and len(others):
        label = groups.label[open_]
        value, size = np.unique(label, return_counts=True)
        large = value[size.argmax()]
        if size.max() >= block:
            # rows of one large group need only be compared with what is not in it yet
            rows, cols = open_[label == large][: 4 * block], others[groups.label[others] != large]
        else:
            rows, cols = open_[:block], others
        if len(cols):
            r, c = np.nonzero(reach(rows, cols))
            groups.join(rows[r], cols[c])
        left_over = np.ones(len(units), bool)
        left_over[rows] = False
        open_ = open_[left_over[open_]]
    own = np.unique(np.concatenate([left[core[left]], right[core[right]]]))
    return own, groups.label[own], np.concatenate(src), np.concatenate(dst)


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") == dim))


def _division(src: DataFrame, rows: int, dim: int, axes: int, rows_per_cell: int, apart: float, sample_rows: int, most_rows: int) -> Pivots | None:
    """Pivots fitted on a sample chosen by a hash of the id: ``sample_rows``, four for each cell if that is more, never above ``most_rows``."""
    wanted = min(WIDE * FINE, max(2, -(-rows // rows_per_cell)))
    drawn_rows = min(most_rows, max(sample_rows, 4 * wanted))
    drawn = src.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows))) < drawn_rows).toArrow()
    mask, sample = list_matrix(drawn.column("v"), dim)
    if not len(sample):
        # the draw may be empty for a tiny table: then the table itself is small
        drawn = src.limit(sample_rows).toArrow()
        mask, sample = list_matrix(drawn.column("v"), dim)
        if not len(sample):
            return None
    _, first = np.unique(drawn.column("vec_id").to_numpy()[mask], return_index=True)
    return Pivots(unit(sample[first]), min(axes, dim), wanted, apart)


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 128, min_similarity: float = 0.72,
    min_points: int = 5, min_size: int = 2, sample_rows: int = 4096, axes: int = 48, rows_per_cell: int = 450,
    apart: float = 0.5, margin: float = 0.3, max_cells: int = 6, chunk_rows: int = 16384, most_sample_rows: int = 200_000, exact: bool = False,
) -> DataFrame:
    """``cluster_id, vec_id, is_core``: members of each cluster; ``cluster_id`` is its smallest member.

    Two vectors are neighbours at a cosine of ``min_similarity`` or more. A vector is a
    core point with ``min_points`` vectors (itself included) in reach; clusters grow over
    core points, and a vector that is none belongs to the cluster, of those that have a
    core in its reach, with the smallest core. Vectors without a core in reach are in no
    cluster. Clusters of fewer than ``min_size`` records are left out.

    Two vectors meet when they share a cell. A vector is placed in at most ``max_cells``
    cells, so pairs of very scattered vectors may not meet (README: measured loss). With
    ``exact`` all vectors are one cell in chunks of ``chunk_rows``: every pair meets, and the
    work is quadratic in the rows. ``chunk_rows`` never changes the result.

    The sample (``sample_rows`` to ``most_sample_rows`` vectors, by the number of cells)
    fits axes and pivots only; every vector is placed and compared. Rows of one id are one
    record; null ids and unusable vectors take no part; an empty table gives an empty
    result.
    """
    if min_points < 1:
        raise ValueError("min_points must be at least 1")
    src = usable(vectors, id_col, vec_col, dim)
    rows = vectors.count()
    whole = max(1, -(-rows // chunk_rows)) if exact else 0
    pivots = None if exact else _division(src, rows, dim, axes, rows_per_cell, apart, sample_rows, most_sample_rows)
    if not exact and pivots is None:
        return vectors.sparkSession.createDataFrame([], "cluster_id long, vec_id long, is_core boolean")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for batch in batches:
            ok, m = list_matrix(batch.column(1), dim)
            if len(m):
                u = unit(m)
                yield batch.column(0).filter(pa.array(ok)), u, np.zeros((len(u), 1), np.int32) if exact else pivots.place(u, margin, max_cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, cells in hashed(batches):
            yield cell_counts(cells)

    if exact:
        chunks = {0: whole}
    else:
        # no more than WIDE * FINE rows reach the driver
        hot = src.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > chunk_rows)
        chunks = {r["cell"]: -(-r["n"] // chunk_rows) for r in hot.collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, u, cells in hashed(batches):
            yield placed(ids, pack16(u), cells, chunks)

    def local(key: tuple, group: pa.Table) -> pa.Table:
        cell, one, two = (x.as_py() for x in key)
        ids, at = np.unique(group.column("vec_id").to_numpy(), return_index=True)
        u = unpack16(group.column("v").combine_chunks().take(pa.array(at)), dim)
        a = b = np.arange(len(ids))
        if one != two:
            # the rows of one chunk meet each other in that chunk's own task
            own = chunk_of(ids, chunks[cell])
            a, b = np.flatnonzero(own == one), np.flatnonzero(own == two)
        core, label, x, y = dense_part(u, a, b, min_similarity, min_points)
        return pa.table({"a": np.concatenate([ids[core], ids[x]]), "b": np.concatenate([ids[label], ids[y]]), "core": np.r_[np.ones(len(core), bool), np.zeros(len(x), bool)]})

    found = cut(by_cell(spread(src).mapInArrow(place, PLACED), rows * (whole or 3), 2 * dim + 48, whole * (whole + 1) // 2).applyInArrow(local, "a long, b long, core boolean"), "reach")
    return _grow(found, min_points, min_size)


def _grow(found: DataFrame, min_points: int, min_size: int) -> DataFrame:
    """Clusters from what the tasks found: certain cores ``a`` with a member ``b`` of their local group, and neighbours ``b`` of rows ``a`` that were no core there."""
    sure = found.where("core").select(F.col("a").alias("vec_id")).distinct()
    loose = found.where("not core").select("a", "b").distinct()
    # all neighbours of a row that is core in no task are listed, so their number is exact
    open_ = loose.join(sure, F.col("a") == F.col("vec_id"), "left_anti")
    more = open_.groupBy(F.col("a").alias("vec_id")).agg(F.count("*").alias("n")).where(F.col("n") >= min_points - 1).select("vec_id")
    cores = cut(sure.unionByName(more), "cores")
    to_core = cut(loose.join(cores.select(F.col("vec_id").alias("b")), "b", "left_semi").join(cores.select(F.col("vec_id").alias("a"), F.lit(True).alias("also")), "a", "left").select("a", "b", F.coalesce("also", F.lit(False)).alias("also")), "links")
    links = found.where("core and a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(to_core.where("also").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    joined = connected_components(links)
    rooted = cut(cores.join(joined, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("root", "vec_id").alias("root")), "roots")
    edge = to_core.where("not also").join(rooted, F.col("b") == F.col("vec_id")).groupBy(F.col("a").alias("vec_id")).agg(F.min("root").alias("root"))
    whole = cut(rooted.withColumn("is_core", F.lit(True)).unionByName(edge.withColumn("is_core", F.lit(False))), "members")
    for t in (found, cores, to_core, rooted):
        drop_cut(t)
    # a member that is no core may be the smallest
    sizes = whole.groupBy("root").agg(F.count("*").alias("n"), F.min("vec_id").alias("cluster_id")).where(F.col("n") >= min_size)
    return whole.join(sizes, "root").select("cluster_id", "vec_id", "is_core")


def describe_clusters(vectors: DataFrame, members: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", dim: int = 128, typical: int = 3, labels: int = 3) -> DataFrame:
    """``cluster_id, size, n_labels, labels, medoids, cohesion`` of each cluster.

    ``medoids`` lists the ``typical`` members most similar to the cluster's mean vector
    (ties: smaller id), ``labels`` the most frequent label keys with their counts (ties:
    by name), ``cohesion`` the mean similarity of the members to the mean vector. A
    record's label is the least of its rows' label keys; unlabelled records count in
    ``size`` only.
    """
    usable_rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), label_key(label_col).alias("label"))
    one = usable_rows.where(is_usable("v", dim)).groupBy("vec_id").agg(F.first("v").alias("v"), F.min("label").alias("label"))
    rows = members.join(one, "vec_id").withColumn("v", l2_normalize(F.col("v")))
    mean = rows.groupBy("cluster_id").agg(Summarizer.mean(array_to_vector("v")).alias("m"), F.count("*").alias("size"))
    mean = mean.select("cluster_id", "size", l2_normalize(vector_to_array("m")).alias("m"))
    near = cut(rows.select("cluster_id", "vec_id", "v").join(mean, "cluster_id").select("cluster_id", "vec_id", "size", dot(F.col("v"), F.col("m")).alias("s")), "near")
    order = Window.partitionBy("cluster_id").orderBy(F.desc("s"), "vec_id")
    top = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= typical).groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id"))), lambda x: x["vec_id"]), ",").alias("medoids"))
    stats = near.groupBy("cluster_id").agg(F.first("size").alias("size"), F.round(F.avg("s"), 6).alias("cohesion"))
    by = rows.where("label is not null").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "label")
    named = by.withColumn("r", F.row_number().over(rank)).groupBy("cluster_id").agg(
        F.count("*").alias("n_labels"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= labels, F.struct("r", "label", "n")))), lambda x: F.concat(x["label"], F.lit(":"), x["n"])), ",").alias("labels")
    )
    return stats.join(top, "cluster_id").join(named, "cluster_id", "left").select("cluster_id", "size", F.coalesce("n_labels", F.lit(0).cast("long")).alias("n_labels"), "labels", "medoids", "cohesion")
