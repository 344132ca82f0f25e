"""Vectors as Arrow columns and NumPy blocks, and vector expressions for Catalyst."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


# -- blocks ---------------------------------------------------------------------------


def list_matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask, matrix): which rows are usable, and the usable rows as float32.

    A row is usable when it is not null, has ``dim`` finite numbers and is not all zero.
    Null elements count as not finite.
    """
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], type=col.type)
    lengths = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    mask = lengths == dim
    kept = col.filter(pa.array(mask))
    flat = kept.flatten()
    data = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    good = np.isfinite(data).all(1) & (data != 0).any(1)
    full = np.zeros(len(mask), bool)
    full[np.flatnonzero(mask)[good]] = True
    return full, data[good]


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    wide = matrix.astype(np.float64)
    scale = np.abs(wide).max(1, keepdims=True) if wide.size else np.ones((len(wide), 1))
    wide = wide / np.where(scale > 0, scale, 1)
    norm = np.sqrt((wide * wide).sum(1, keepdims=True))
    return wide / np.where(norm > 0, norm, 1)


def pack16(units: np.ndarray) -> pa.Array:
    """Unit rows as 16-bit integers in a binary column: half of float32, cosine exact to about 1e-5."""
    top = np.abs(units).max(1, keepdims=True) if len(units) else np.ones((0, 1))
    q = np.rint(units / np.where(top > 0, top, 1) * 32767).astype("<i2")
    return pack(q)


def unpack16(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit rows in double precision from ``pack16``."""
    return unit(unpack(col, dim, "<i2").astype(np.float32))


def pack(matrix: np.ndarray) -> pa.Array:
    """Each row's bytes as one value of a binary column."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def unpack(col: pa.Array | pa.ChunkedArray, dim: int, dtype: str) -> np.ndarray:
    """The matrix behind a binary column of equal row lengths (no nulls)."""
    if isinstance(col, pa.ChunkedArray):
        return np.concatenate([unpack(c, dim, dtype) for c in col.chunks]) if col.num_chunks else np.zeros((0, dim), dtype)
    if len(col) == 0:
        return np.zeros((0, dim), dtype)
    offsets = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(col), dim)


# -- expressions ----------------------------------------------------------------------


def as_double(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def is_usable(col: Column | str, dim: int) -> Column:
    """``dim`` finite numbers, not all zero: the condition of ``list_matrix`` as an expression (false for null)."""
    c = F.col(col) if isinstance(col, str) else col
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(c) == dim) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null when a side is null or of length zero."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return dot(a, b) / F.nullif(scale, F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def l2_normalize(a: Column, floor: float = 1e-12) -> Column:
    """Each element divided by the larger of the length and ``floor``."""
    length = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x / length)
