"""Most similar vectors for every vector, by cross-polytope hashing.

Unit vectors are turned by pseudo-rotations (random signs and fast Hadamard transforms,
three rounds) and belong to the nearest signed axis, their cell. Multiprobe: a vector is
placed in its ``probes`` best cells, so two vectors meet when any of their best cells
agree. Cells are compared exactly, block by block, and the best of all cells are merged.

The number of cells follows the number of vectors. Above ``4 * dim`` cells a second
rotation, cut to as many axes as needed, refines the first. As cells get smaller, vectors
are placed in more of them, and refined cells come from two independent hashings, so that
the share of similar pairs that meet stays (``places``). A cell of more than
``chunk_rows`` places is compared as pairs of chunks, each pair a task of bounded memory:
every two members of a cell are compared, however large it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import cut, spread
from lumenaudit.functions.vectors import is_usable, list_matrix, pack16, unit, unpack16
from lumenaudit.llm.cells import PLACED, by_cell, cell_counts, chunk_of, placed

#: Rows of a chunk where every two chunks are compared.
EXACT_ROWS = 24_576

MAX_CELLS = 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row (row length a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.float32(math.sqrt(d))


def pseudo_rotation(x: np.ndarray, seed: int, rounds: int = 3) -> np.ndarray:
    """``rounds`` times random signs and a Hadamard transform; short rows are filled with zeros."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    if d != x.shape[1]:
        x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32, copy=False)
    for _ in range(rounds):
        x = hadamard(x * rng.choice(np.array([-1, 1], np.float32), d))
    return x


def cell_shape(rows: int, dim: int, rows_per_cell: int) -> tuple[int, int]:
    """Axes used of the first and of the second rotation (0: none) for so many vectors."""
    d = 1 << max(0, (dim - 1).bit_length())
    cells = min(MAX_CELLS, max(2, -(-rows // rows_per_cell)))
    if cells <= 4 * d:
        return min(d, max(1, cells // 2)), 0
    return d, min(d, max(1, round(cells / (4 * d))))


def places(shape: tuple[int, int]) -> tuple[int, int]:
    """Hashings, and cells of each that a vector is placed in, for cells of this shape.

    Chosen so that of the ten nearest with a cosine of 0.72 or more at least 0.996 share a
    cell (measured at dimension 128, see README).
    """
    first, second = shape
    if not second:
        return 1, 5 if first <= 16 else 6
    return 2, next(p for most, p in ((2, 6), (5, 8), (12, 10), (64, 12), (math.inf, 16)) if second <= most)


def placed_cells(units: np.ndarray, shape: tuple[int, int], tables: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes`` best cells of each row in each of ``tables`` hashings, numbered apart; -1 where there are fewer."""
    cells = 2 * shape[0] * max(1, 2 * shape[1])
    found = [best_cells(units, shape, probes, seed + 1000 * t) for t in range(tables)]
    return np.concatenate([np.where(c >= 0, c + t * cells, -1) for t, c in enumerate(found)], 1).astype(np.int32)


def best_cells(units: np.ndarray, shape: tuple[int, int], probes: int, seed: int) -> np.ndarray:
    """The ``probes`` nearest cells of each row, best first; -1 where there are fewer cells."""
    first, second = shape

    def digits(axes: int, s: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        r = pseudo_rotation(units, s)[:, :axes]
        both = np.concatenate([r, -r], 1)
        most = min(most, 2 * axes)
        top = np.argpartition(-both, most - 1, 1)[:, :most]
        score = np.take_along_axis(both, top, 1)
        by = np.argsort(-score, 1, kind="stable")
        return np.take_along_axis(top, by, 1), np.take_along_axis(score, by, 1)

    a, sa = digits(first, seed, probes)
    if not second:
        out = a
    else:
        b, sb = digits(second, seed + 1, probes)
        # the loss of a place is how far its two axes stay behind the best ones
        loss = ((sa[:, :1] - sa) ** 2)[:, :, None] + ((sb[:, :1] - sb) ** 2)[:, None, :]
        code = (a[:, :, None] * (2 * second) + b[:, None, :]).reshape(len(a), -1)
        by = np.argsort(loss.reshape(len(a), -1), 1, kind="stable")[:, :probes]
        out = np.take_along_axis(code, by, 1)
    if out.shape[1] < probes:
        out = np.pad(out, ((0, 0), (0, probes - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def _hashed(batches: Iterator[pa.RecordBatch], dim: int, shape: tuple[int, int], tables: int, probes: int, seed: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        mask, rows = list_matrix(batch.column(1), dim)
        if len(rows):
            units = unit(rows)
            yield batch.column(0).filter(pa.array(mask)), units, placed_cells(units, shape, tables, probes, seed)


def top_of_blocks(queries: np.ndarray, q_ids: np.ndarray, base: np.ndarray, b_ids: np.ndarray, k: int, least: float, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of queries, id, similarity) of the ``k`` best of ``base`` for each query, itself left out.

    ``b_ids`` must ascend. Single-precision products choose candidates, double precision ranks them: similarity
    rounded to 6 places descending, then id ascending.
    """
    qf, bf = queries.astype(np.float32), np.ascontiguousarray(base.astype(np.float32))
    m, span = len(bf), 16
    wide = -(-m // span) * span
    spare = 3
    b_wide = np.concatenate([b_ids, np.full(wide - m, np.iinfo(np.int64).min, np.int64)])
    if wide > m:
        bf = np.concatenate([bf, np.zeros((wide - m, bf.shape[1]), np.float32)])
    for at in range(0, len(qf), block):
        q, q_own = qf[at : at + block], q_ids[at : at + block]
        s = q @ bf.T
        s[:, m:] = -2
        here = np.searchsorted(b_ids, q_own)
        own = np.flatnonzero((here < m) & (b_ids[np.minimum(here, m - 1)] == q_own))
        s[own, here[own]] = -2
        groups = s.reshape(len(q), span, wide // span).max(1)  # a group is every (wide / span)-th column
        take = min(groups.shape[1], k + spare)
        if take < groups.shape[1]:
            # the best values lie in the groups with the best maxima
            g = np.argpartition(groups, groups.shape[1] - take, 1)[:, -take:]
        else:
            g = np.broadcast_to(np.arange(take), (len(q), take))
        cols = (g[:, None, :] + np.arange(span)[:, None] * (wide // span)).reshape(len(q), -1)
        vals = np.take_along_axis(s, cols, 1)
        n = min(vals.shape[1], k + spare)
        edge = np.partition(vals, vals.shape[1] - n, 1)[:, -n]
        floor = np.maximum(edge, least - 1e-5)
        r, c = np.nonzero(vals >= floor[:, None])
        rows, picked = r + at, cols[r, c]
        # equal values at the edge may hide in groups that were not taken: then all of the row takes part
        hidden = (groups >= (floor - 2e-6)[:, None]).sum(1) > take if take < groups.shape[1] else np.zeros(len(q), bool)
        for x in np.flatnonzero(hidden & (edge >= least - 1e-5)):
            more = np.flatnonzero(s[x] >= edge[x] - 2e-6)
            gone = rows != at + x
            rows, picked = np.concatenate([rows[gone], np.full(len(more), at + x)]), np.concatenate([picked[gone], more])
        if len(rows) and picked.max() >= m:
            rows, picked = rows[picked < m], picked[picked < m]
        sims = np.round(np.einsum("ij,ij->i", queries[rows], base[picked]), 6)
        fit = sims >= least
        rows, picked, sims = rows[fit], picked[fit], sims[fit]
        ids = b_ids[picked]
        by = np.lexsort((ids, -sims, rows))
        rows, ids, sims = rows[by], ids[by], sims[by]
        start = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
        rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0)) if len(rows) else rows
        good = rank < k
        yield rows[good], ids[good], sims[good]


def _lists(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, q_ids: np.ndarray) -> pa.RecordBatch:
    """One record per query with the lists of its neighbours."""
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    offsets = np.r_[start, len(rows)].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(q_ids[rows[start]], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(sims.astype(np.float32), pa.float32()))],
        names=["vec_id", "ids", "sims"],
    )


def similar_vectors(
    vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 128,
    min_similarity: float = -1.0, probes: int | None = None, rows_per_cell: int = 450, chunk_rows: int = 16384, seed: int = 20, exact: bool = False,
) -> DataFrame:
    """``vec_id, neighbor_id, similarity, rank``: the ``k`` most similar other records of each record.

    Similarity is the cosine, rounded to 6 places from vectors held in 16 bits (exact to
    about 1e-5); of equal ones the smaller id comes first. Rows of one id are one record
    (they must hold the same vector). Null ids, null vectors and vectors that are too
    short, too long, all zero or not finite take no part. Exact copies are neighbours of
    similarity 1. An empty table gives an empty result. Other columns are not read.

    Loss: two records that share none of their best cells do not meet. Their number follows
    the cells (``places``); ``probes`` sets it by hand, in one hashing. With
    ``exact`` all records are one cell in chunks of ``EXACT_ROWS``: every two records are
    compared, none is lost, and the work is quadratic in the rows.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") == dim))
    total = vectors.count()
    shape = cell_shape(total, dim, rows_per_cell)
    tables, probes = places(shape) if probes is None else (1, probes)
    whole = max(1, -(-total // EXACT_ROWS)) if exact else 0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, cells in _hashed(batches, dim, shape, tables, probes, seed):
            yield cell_counts(cells)

    every, copies = src, _saturated(src, k, dim)
    if copies is not None:
        src = src.withColumns(_digest()).join(copies.select("h", "g", "last"), (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")) & (F.col("vec_id") > F.col("last")), "left_anti").select("vec_id", "v")

    # one number per cell; no more than 2 * MAX_CELLS rows reach the driver
    if exact:
        chunks = {0: whole}
    else:
        hot = src.mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > chunk_rows)
        chunks = {r["cell"]: -(-r["n"] // chunk_rows) for r in hot.collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, units, cells in _hashed(batches, dim, shape, tables, probes, seed):
            yield placed(ids, pack16(units), np.zeros((len(ids), 1), np.int32) if exact else cells, chunks)

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        _, one, two = (x.as_py() for x in key)
        ids, at = np.unique(group.column("vec_id").to_numpy(), return_index=True)
        x = unpack16(group.column("v").combine_chunks().take(pa.array(at)), dim)
        out = []
        if one == two:
            parts = [(x, ids, x, ids)]
        else:
            own = chunk_of(ids, chunks[key[0].as_py()])
            a, b = own == one, own == two
            parts = [(x[a], ids[a], x[b], ids[b]), (x[b], ids[b], x[a], ids[a])]
        for q, qi, base, bi in parts:
            if len(q) and len(base):
                out += [_lists(r, i, s, qi) for r, i, s in top_of_blocks(q, qi, base, bi, k, min_similarity)]
        names = pa.schema([("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32()))])
        return pa.Table.from_batches([b.cast(names) for b in out], names)

    found = by_cell((spread(src) if copies is None else src).mapInArrow(place, PLACED), total * (whole or tables * probes), 2 * dim + 48, whole * (whole + 1) // 2).applyInArrow(compare, "vec_id long, ids array<long>, sims array<float>")

    # each record's lists (at most one per cell and chunk pair) become one sorted list of k
    entry = F.arrays_zip(F.transform("sims", lambda s: -F.round(s.cast("double"), 6)).alias("s"), F.col("ids").alias("i"))
    merged = found.select("vec_id", entry.alias("e")).groupBy("vec_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("e")))), 1, k).alias("e"))
    near = merged.select("vec_id", F.posexplode("e").alias("p", "x")).select("vec_id", F.col("x.i").alias("neighbor_id"), (-F.col("x.s")).alias("similarity"), (F.col("p") + 1).alias("rank"))
    if copies is None:
        return near
    # the copies that were left out: their neighbours are the first k of their class
    rest = _left_out(every, copies)
    return near.unionByName(rest.select("vec_id", F.posexplode(F.slice("first", 1, k)).alias("p", "neighbor_id")).select("vec_id", "neighbor_id", F.lit(1.0).alias("similarity"), (F.col("p") + 1).alias("rank")))


def _digest() -> dict[str, Column]:
    """96 bits that equal vectors share."""
    return {"_h": F.xxhash64("v"), "_g": F.hash("v")}


def _saturated(src: DataFrame, k: int, dim: int) -> DataFrame | None:
    """``h, g, first, last`` of classes of more than ``k + 1`` identical vectors; null if there are none.

    Every member's ``k`` nearest are then the class's smallest ids, and no other vector
    can need more than the ``k + 1`` smallest as neighbours: members beyond them need not
    be compared, so a group of copies of any size costs what ``k + 1`` records cost.
    """
    rows = src.withColumns(_digest())
    big = cut(rows.groupBy("_h", "_g").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("_h", "_g"), "copies")
    if big.isEmpty():
        return None
    order = Window.partitionBy("_h", "_g").orderBy("vec_id")
    # few rows per class are kept, so Spark limits classes before the shuffle
    members = rows.join(big, ["_h", "_g"]).where(is_usable("v", dim)).select("_h", "_g", "vec_id").distinct()
    first = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return cut(first.groupBy(F.col("_h").alias("h"), F.col("_g").alias("g")).agg(F.array_sort(F.collect_list("vec_id")).alias("first"), F.max("vec_id").alias("last"), F.count("*").alias("n")).where(F.col("n") == k + 1).drop("n"), "copies")


def _left_out(src: DataFrame, copies: DataFrame) -> DataFrame:
    """``vec_id, first`` of the copies beyond the first of their class."""
    return src.withColumns(_digest()).select("vec_id", "_h", "_g").join(copies, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")) & (F.col("vec_id") > F.col("last"))).select("vec_id", "first").dropDuplicates(["vec_id"])
