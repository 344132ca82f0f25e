"""Groups of records that differ by small edits.

Names: a record is the set of tokens of its file name. The record by token incidence
matrix is multiplied with its transpose in blocks, one block for each rare token that two
agreeing sets must share (the size-derived prefix). A block's rows are ordered by size, so
that the columns whose sizes allow a link are a range; the sparse product of a run of rows
accumulates overlap counts, and pairs below the bound are dropped. Runs, blocks and tasks
have bounded bytes, whatever the table's size. Vectors are dense and have
no rare part that two similar ones must share: they are dealt to chunks, and the product
of every two chunks keeps pairs above the similarity bound, so none is lost. Both kinds of
links are reduced to groups inside their block, so a block of many copies sends one row
per record, never its pairs; groups are then joined across blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions.groups import Groups, linked_groups
from lumenaudit.functions.runtime import cut, parallelism
from lumenaudit.functions.vectors import list_matrix, pack, unpack
from lumenaudit.llm.cells import PLACED, TASK_BYTES, by_cell, chunk_of, placed
from lumenaudit.operators.components import connected_components


def name_tokens(path: Column) -> Column:
    """Distinct runs of a-z and 0-9 in the last part of a path, lower case, without the extension."""
    last = F.lower(F.element_at(F.split(path, "/"), -1))
    stem = F.regexp_replace(last, "\\.[^.]*$", "")
    return F.array_distinct(F.filter(F.split(stem, "[^a-z0-9]+"), lambda x: x != ""))


def set_links(sets: DataFrame, id_col: str, tokens_col: str, jaccard: float, chunk_rows: int = 8192) -> DataFrame:
    """``src, dst``: links that join all sets with a Jaccard similarity of ``jaccard`` or more.

    The links connect each group of similar sets (directly or over others); they are not
    all of its pairs. Equal sets are compared once. Empty and null sets have no links.
    """
    spark = sets.sparkSession
    rows = sets.select(F.col(id_col).cast("long").alias("id"), F.array_sort(F.array_distinct(tokens_col)).alias("t")).where("id is not null and size(t) > 0")
    sign = F.array_join("t", " ")
    rows = rows.withColumn("sign", sign)
    head = rows.groupBy("sign").agg(F.min("id").alias("head"), F.first("t").alias("t"))
    same = rows.join(head.select("sign", "head"), "sign").where("id <> head").select(F.col("id").alias("src"), F.col("head").alias("dst"))

    # tokens in ascending order of how many distinct sets hold them
    each = head.select("head", F.size("t").alias("n"), F.explode("t").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df"))
    ranked = each.join(often, "token").groupBy("head", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(jaccard) - 1e-9) + 1
    hashes = F.array_sort(F.transform("o", lambda x: F.xxhash64(x["token"])))
    prefix = ranked.select("head", hashes.alias("h"), F.explode(F.slice("o", 1, keep.cast("int"))).alias("p")).where("p.df > 1")
    m = F.ceil(F.col("p.df") / chunk_rows).cast("int")
    own = F.pmod(F.xxhash64("head"), m).cast("int")
    # a set travels with at most all of its tokens to as many blocks: an upper bound of the bytes, from the rows as they stand
    room = rows.agg(F.sum(F.size("t") * (8 * F.size("t") + 48))).first()[0] or 0
    blocks = max(parallelism(spark), -(-room // TASK_BYTES))
    cross = prefix.select("head", "h", F.xxhash64("p.token").alias("token"), own.alias("own"), F.explode(F.sequence(F.lit(0), m - 1)).alias("other"), m.alias("m"))
    keyed = cross.select(
        "head", "h", "token", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
        F.when(F.col("m") == 1, F.pmod(F.col("token"), F.lit(blocks))).otherwise(F.col("token")).alias("block"),
    )

    def product(key: tuple, group: pa.Table) -> pa.Table:
        _, one, two = (x.as_py() for x in key)
        ids = group.column("head").to_numpy()
        token, own = group.column("token").to_numpy(), group.column("own").to_numpy()
        lists = group.column("h").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        uniq, first, inv = np.unique(ids, return_index=True, return_inverse=True)
        incidence = Incidence(lists.take(pa.array(first)))
        groups = Groups(len(uniq))
        by = np.argsort(token, kind="stable")
        edges = np.flatnonzero(np.r_[True, token[by][1:] != token[by][:-1], True])
        if one == two:
            incidence.join_small(groups, inv[by], edges, jaccard)
        for left, right in zip(edges[:-1], edges[1:]):
            at = by[left:right]
            if one != two:
                incidence.join(groups, inv[at[own[at] == one]], inv[at[own[at] == two]], jaccard)
            elif right - left > SMALL:
                incidence.join(groups, inv[at], None, jaccard)
        label = groups.label
        on = label != np.arange(len(uniq))
        return pa.table({"src": uniq[on], "dst": uniq[label[on]]})

    near = keyed.groupBy("block", "one", "two").applyInArrow(product, "src long, dst long")
    return same.unionByName(near)


#: Rows up to which the blocks of several tokens are multiplied together.
SMALL = 32
#: Products of two entries that are accumulated at a time.
STEP = 1 << 21


class Incidence:
    """The sets of one task as a sparse matrix of rows by tokens."""

    def __init__(self, lists: pa.ListArray) -> None:
        self.size = lists.value_lengths().to_numpy().astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        _, self.token = np.unique(lists.flatten().to_numpy(), return_inverse=True)

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``rows``, token) of every entry of these rows."""
        n = self.size[rows]
        at = np.repeat(np.arange(len(rows)), n)
        return at, self.token[np.repeat(self.start[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]

    def join_small(self, groups: Groups, post: np.ndarray, edges: np.ndarray, jaccard: float) -> None:
        """The blocks of all tokens that up to ``SMALL`` rows hold, many blocks at a time."""
        count = np.diff(edges)
        some = np.flatnonzero((count > 1) & (count <= SMALL))
        run = np.cumsum(count[some] * SMALL) // (STEP // 4)
        for r in np.unique(run):
            own = some[run == r]
            rows = np.concatenate([post[edges[b] : edges[b + 1]] for b in own])
            block = np.repeat(np.arange(len(own)), count[own])
            at, token = self.entries(rows)
            order = np.lexsort((at, token, block[at]))
            at, token = at[order], token[order]
            # entries of one token in one block stand together: a product for each two of them
            pairs = [np.zeros(0, np.int64)]
            for d in range(1, SMALL):
                hit = np.flatnonzero((token[d:] == token[:-d]) & (block[at[d:]] == block[at[:-d]]))
                if not len(hit):
                    break
                pairs.append(at[hit] * len(rows) + at[hit + d])
            code, both = np.unique(np.concatenate(pairs), return_counts=True)
            a, b = rows[code // len(rows)], rows[code % len(rows)]
            ok = both >= jaccard * (self.size[a] + self.size[b] - both) - 1e-9
            groups.join(a[ok], b[ok])

    def join(self, groups: Groups, left: np.ndarray, right: np.ndarray | None, jaccard: float) -> None:
        """One block: every two of ``left`` (``right``: each of it with each of ``right``), a run of rows at a time."""
        left = np.unique(left)
        right = left if right is None else np.unique(right)
        left, right = left[np.argsort(self.size[left], kind="stable")], right[np.argsort(self.size[right], kind="stable")]
        if not len(left) or not len(right):
            return
        at, token = self.entries(right)
        order = np.argsort(token, kind="stable")
        posted = at[order]
        first = np.r_[0, np.cumsum(np.bincount(token, minlength=int(self.token.max()) + 1))]
        done = 0
        while done < len(left):
            # as many rows as keep counts and products small
            rows = left[done : done + max(1, STEP // len(right))]
            r, t = self.entries(rows)
            n = first[t + 1] - first[t]
            upto = np.searchsorted(np.cumsum(np.bincount(r, n, len(rows))), STEP, "right")
            rows = rows[: max(1, upto)]
            done += len(rows)
            label = groups.label[rows[0]]
            if (groups.label[rows] == label).all() and (groups.label[right] == label).all():
                continue
            n, t, r = n[r < len(rows)], t[r < len(rows)], r[r < len(rows)]
            column = posted[np.repeat(first[t] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            low, high = np.searchsorted(self.size[right], [np.ceil(jaccard * self.size[rows[0]] - 1e-9), np.floor(self.size[rows[-1]] / jaccard + 1e-9) + 1])
            fit = (column >= low) & (column < high)
            wide = max(1, int(high - low))
            both = np.bincount(np.repeat(r, n)[fit] * wide + column[fit] - low, minlength=len(rows) * wide).reshape(len(rows), wide)
            total = self.size[rows][:, None] + self.size[right[low:high]][None, :] if high > low else np.full(both.shape, 9e9)
            a, b = np.nonzero((both > 0) & (both >= jaccard * (total - both) - 1e-9))
            groups.join(rows[a], right[low + b])


def vector_links(vectors: DataFrame, id_col: str, vec_col: str, dim: int, above: float, chunk_rows: int = 40_960, sizes_from: DataFrame | None = None) -> DataFrame:
    """``src, dst``: links that join all vectors whose cosine is above ``above``.

    Every two vectors are compared: the rows are dealt to chunks, each pair of chunks is a
    task, and its links are reduced to groups there. Equal vectors are compared once. Rows
    of one id are one vector. Unusable vectors have no links. ``sizes_from``: a table with
    the same columns that holds at least the rows of ``vectors`` and is cheaper to read
    twice; the number of chunks is taken from it, as an upper bound.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") == dim))
    total = (vectors if sizes_from is None else sizes_from).count()
    many = max(1, -(-total // chunk_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, m = list_matrix(batch.column(1), dim)
            if len(m):
                yield placed(batch.column(0).filter(pa.array(ok)), pack(m), np.zeros((len(m), 1), np.int32), {0: many})

    def product(key: tuple, group: pa.Table) -> pa.Table:
        _, one, two = (x.as_py() for x in key)
        ids, at = np.unique(group.column("vec_id").to_numpy(), return_index=True)
        m = unpack(group.column("v").combine_chunks().take(pa.array(at)), dim, "<f4")
        own = chunk_of(ids, many)
        a = np.flatnonzero(own == one)
        label = linked_groups(m, a, a if one == two else np.flatnonzero(own == two), above)
        on = label != np.arange(len(ids))
        return pa.table({"src": ids[on], "dst": ids[label[on]]})

    return by_cell(src.mapInArrow(place, PLACED), total * many, 4 * dim + 48, many * (many + 1) // 2).applyInArrow(product, "src long, dst long")


def near_duplicate_groups(
    records: DataFrame, vectors: DataFrame | None = None, id_col: str = "vec_id", path_col: str = "path", vec_col: str = "embedding",
    dim: int = 128, above: float = 0.95, jaccard: float = 0.75,
) -> DataFrame:
    """``vec_id, group_id, size``: one row per record in a group of two or more.

    Records are linked when their vectors' cosine is above ``above`` or the token sets of
    their file names have a Jaccard similarity of ``jaccard`` or more; a group is all that
    chains of links join, and ``group_id`` its smallest member. Several rows of one id are
    one record (least path). Records without a usable vector link by name only, records
    without a path or tokens by vector only; vectors without a record do not count; null
    ids are dropped; empty tables give an empty result.
    """
    one = records.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(path_col).alias("path"))
    links = set_links(one.select("vec_id", name_tokens(F.col("path")).alias("t")), "vec_id", "t", jaccard)
    if vectors is not None:
        ids = one.select("vec_id")
        raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
        own = raw.where(F.size("v") == dim).join(ids, "vec_id", "left_semi")
        links = links.unionByName(vector_links(own, "vec_id", "v", dim, above, sizes_from=raw))
    joined = connected_components(links)
    sizes = joined.groupBy("root").agg(F.count("*").alias("size"))
    return joined.join(sizes, "root").select(F.col("node").alias("vec_id"), F.col("root").alias("group_id"), "size")


def pairs_of_groups(groups: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """``vec_id_a, vec_id_b``: every two members of a group, for reports that want pairs.

    A group of more than ``chunk_rows`` is dealt to chunks, and each pair of chunks is joined
    apart, so no task lists the pairs of a large group.
    """
    m = F.ceil(F.col("size") / chunk_rows).cast("int")
    kept = cut(groups.select("group_id", "vec_id", m.alias("m"), F.pmod(F.xxhash64("vec_id"), m).cast("int").alias("own")), "groups")
    every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    a = kept.select("group_id", F.col("vec_id").alias("vec_id_a"), F.col("own").alias("one"), every.alias("two"))
    b = kept.select("group_id", F.col("vec_id").alias("vec_id_b"), every.alias("one"), F.col("own").alias("two"))
    return a.join(b, ["group_id", "one", "two"]).where("vec_id_a < vec_id_b").select("vec_id_a", "vec_id_b")
