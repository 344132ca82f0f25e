"""Approximate nearest neighbours by inverted lists.

Centres are fitted on a bounded sample; every row of the base lies in the list of its
nearest centre, and a query looks into the lists of its few nearest centres. Lists are
compared exactly, in tasks of bounded size, however uneven they are, and the best of all
lists are merged. What a query can miss are neighbours in lists it does not look into;
``recall`` measures that against the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import spread
from lumenaudit.operators.sampling import hash_key
from lumenaudit.operators.similarity import CHUNK_ROWS, _matrix, _rows, _unit, best_in_group, knn_join, merge_best

#: Fixed value: below so many rows the exact search is used.
EXACT_BELOW = 1000
#: Lists at most, and sample rows for each of them.
MOST_LISTS, SAMPLE_OF_LIST = 4096, 32


def fit_centers(sample: np.ndarray, lists: int, steps: int = 8, seed: int = 42) -> np.ndarray:
    """Centres of ``lists`` parts of the sample by Lloyd's steps from random rows; empty parts keep their centre."""
    rng = np.random.default_rng(seed)
    centers = sample[np.sort(rng.choice(len(sample), min(lists, len(sample)), replace=False))]
    for _ in range(steps):
        own = nearest_lists(sample, centers, 1)[:, 0]
        n = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, sample)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest_lists(x: np.ndarray, centers: np.ndarray, probes: int, block: int = 4096) -> np.ndarray:
    """The ``probes`` centres nearest to each row (Euclidean), nearest first."""
    size = (centers * centers).sum(1) / 2
    probes = min(probes, len(centers))
    out = np.zeros((len(x), probes), np.int64)
    for at in range(0, len(x), block):
        far = size - x[at : at + block] @ centers.T
        top = np.argpartition(far, probes - 1, 1)[:, :probes]
        out[at : at + block] = np.take_along_axis(top, np.argsort(np.take_along_axis(far, top, 1), 1, kind="stable"), 1)
    return out


def ivf_search(
    queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "cosine",
    exclude_self: bool = True, lists: int | None = None, probes: int | None = None, chunk_rows: int = CHUNK_ROWS, seed: int = 42,
) -> DataFrame:
    """``src, dst, rank, score`` as ``knn_join`` gives them, found in inverted lists.

    ``lists`` is the root of the number of base rows by default (at most ``MOST_LISTS``), ``probes`` a
    third of the lists where they are few and the root of their number times four where
    they are many. The sample that fits the centres has at most ``SAMPLE_OF_LIST`` rows for
    each list; every row of the base is in a list. Under the inner product lists go by
    direction. Null ids and vectors take no part, nor do zero vectors under the cosine; an
    empty base gives an empty result.
    """
    q, b = _rows(queries, id_col, vec_col), _rows(base, id_col, vec_col)
    n = base.count()
    lists = max(1, min(MOST_LISTS, lists or round(math.sqrt(n))))
    probes = probes or max(1, min(lists, max(-(-lists // 3) if lists <= 128 else 0, round(4 * math.sqrt(lists)))))
    even = metric != "euclidean"
    shape = (lambda m: np.nan_to_num(_unit(m))) if even else (lambda m: m)
    # at most MOST_LISTS * SAMPLE_OF_LIST rows
    drawn = b.orderBy(hash_key(seed, "id"), "id").limit(lists * SAMPLE_OF_LIST).toArrow()
    if not drawn.num_rows:
        return merge_best(q.sparkSession.createDataFrame([], "src long, dst long, score double"), k, metric)
    centers = fit_centers(shape(_matrix(drawn.column("v"))), lists, seed=seed)

    def counted(many: int):  # noqa: ANN202
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if x.num_rows:
                    c, m = np.unique(nearest_lists(shape(_matrix(pa.chunked_array([x.column(1)]))), centers, many), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(m.astype(np.int64))], names=["list", "n"])

        return f

    def chunks(rows: DataFrame, many: int) -> np.ndarray:
        # one number per list
        got = rows.mapInArrow(counted(many), "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).where(F.col("n") > chunk_rows).collect()
        out = np.ones(len(centers), np.int64)
        for r in got:
            out[r["list"]] = -(-r["n"] // chunk_rows)
        return out

    parts_b, parts_q = chunks(b, 1), chunks(q, probes)

    def place(is_query: bool):  # noqa: ANN202
        many, own, other = (probes, parts_q, parts_b) if is_query else (1, parts_b, parts_q)

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if not x.num_rows:
                    continue
                ids = x.column(0).to_numpy()
                at = nearest_lists(shape(_matrix(pa.chunked_array([x.column(1)]))), centers, many)
                row, cell = np.repeat(np.arange(len(ids)), at.shape[1]), at.ravel()
                mixed = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                mine = (mixed % own[cell].astype(np.uint64)).astype(np.int32)
                # a row meets every chunk of the other side
                n = other[cell]
                rep = np.repeat(np.arange(len(row)), n)
                theirs = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                one, two = (mine[rep], theirs) if is_query else (theirs, mine[rep])
                take = pa.array(row[rep])
                yield pa.RecordBatch.from_arrays([x.column(0).take(take), x.column(1).take(take), pa.array(np.full(len(rep), is_query)), pa.array(cell[rep].astype(np.int32)), pa.array(one), pa.array(two)], names=["id", "v", "q", "list", "one", "two"])

        return f

    kind = q.schema["v"].dataType.simpleString()
    schema = f"id long, v {kind}, q boolean, list int, one int, two int"
    b = b.withColumn("v", F.col("v").cast(kind))
    placed = spread(q).mapInArrow(place(True), schema).unionByName(spread(b).mapInArrow(place(False), schema))
    found = placed.groupBy("list", "one", "two").applyInArrow(lambda group: best_in_group(group, k, metric, exclude_self), "src long, dst long, score double")
    return merge_best(found, k, metric)


def search(queries: DataFrame, base: DataFrame, k: int, kind: str = "auto", **more) -> DataFrame:  # noqa: ANN003
    """Neighbours by the exact search or by inverted lists; ``auto``: exact below ``EXACT_BELOW`` base rows."""
    if kind not in ("auto", "exact", "lists"):
        raise ValueError(f"kind={kind!r}: auto, exact or lists")
    if kind == "exact" or (kind == "auto" and base.count() < EXACT_BELOW):
        return knn_join(queries, base, k, **more)
    return ivf_search(queries, base, k, **more)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``n, recall``: the part of the exact neighbours that were found."""
    hit = exact.select("src", "dst").join(found.select("src", "dst", F.lit(1.0).alias("hit")), ["src", "dst"], "left")
    return hit.agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
