"""Rows placed in cells, and the comparison of a cell's rows in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData

from lumenaudit.functions.groups import Groups, similar_groups
from lumenaudit.functions.runtime import parallelism

__all__ = ["Groups", "PLACED", "by_cell", "cell_counts", "chunk_of", "placed", "similar_groups"]


def chunk_of(ids: np.ndarray, m: int) -> np.ndarray:
    """The chunk of each id when a cell is cut in ``m``; all rows of an id share it."""
    mixed = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return (mixed % np.uint64(m)).astype(np.int32)


def placed(ids: pa.Array, payload: pa.Array, cells: np.ndarray, chunks: dict[int, int]) -> pa.RecordBatch:
    """``vec_id, cell, one, two, v``: each row once per cell (-1: none).

    Cells in ``chunks`` are cut in so many chunks; their rows go to every pair of chunks
    that has theirs, so that each two rows of a cell meet in a task of bounded size.
    """
    key = ids.to_numpy()
    rows, cell, one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for p in range(cells.shape[1]):
        c = cells[:, p]
        r = np.flatnonzero(c >= 0)
        big = np.isin(c[r], list(chunks)) if chunks else np.zeros(len(r), bool)
        s = r[~big]
        zero = np.zeros(len(s), np.int32)
        rows.append(s), cell.append(c[s].astype(np.int32)), one.append(zero), two.append(zero)
        for x in np.unique(c[r[big]]):
            at = r[c[r] == x]
            own = chunk_of(key[at], chunks[int(x)])
            for other in range(chunks[int(x)]):
                rows.append(at), cell.append(np.full(len(at), x, np.int32))
                one.append(np.minimum(own, other).astype(np.int32)), two.append(np.maximum(own, other).astype(np.int32))
    take = pa.array(np.concatenate(rows))
    return pa.RecordBatch.from_arrays(
        [ids.take(take), pa.array(np.concatenate(cell)), pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), payload.take(take)],
        names=["vec_id", "cell", "one", "two", "v"],
    )


#: Bytes of placed rows that one task should read.
TASK_BYTES = 48 << 20


def by_cell(rows: DataFrame, expected: int, row_bytes: int, large: int = 0) -> GroupedData:
    """Placed rows grouped by cell and chunk pair, in as many tasks as ``expected`` rows of that size need.

    ``large``: how many groups are long work each; more tasks then keep two of them from sharing one.
    """
    tasks = max(parallelism(rows.sparkSession), -(-expected * row_bytes // TASK_BYTES), 4 * large)
    keys = ["cell", "one", "two"]
    return rows.repartition(tasks, *keys).groupBy(*keys)


PLACED = "vec_id long, cell int, one int, two int, v binary"


def cell_counts(cells: np.ndarray) -> pa.RecordBatch:
    """``cell, n`` of one batch."""
    c, n = np.unique(cells[cells >= 0], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "n"])
