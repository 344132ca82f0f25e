"""Passages of evaluation items in a corpus.

Items and documents are cut in overlapping windows of as many words as the shortest
passage that counts. Every window has a SimHash of its word pairs, 64 bits. Fingerprints
within ``radius`` bits agree in at least one of ``radius + 1`` blocks, so looking up every
block finds all of them. Candidates are verified exactly: the windows' weighted shingle
similarity, rare shingles counting more, and then the run of words they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import spread
from lumenaudit.llm.words import WordHashes, mix, words

SLICE_CHARS = 8_000_000


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of every two neighbouring words."""
    return mix(h[:-1], h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)


def simhashes(features: np.ndarray, width: int, step: int = 1 << 15) -> np.ndarray:
    """SimHash of each run of ``width`` features; a bit is set if more features have it than not."""
    n = len(features) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, step):
        part = features[at : min(at + step, n) + width - 1]
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1)
        run = np.zeros((len(part) + 1, 64), np.int16)
        np.cumsum(bits, axis=0, dtype=np.int16, out=run[1:])
        # int16 may wrap, differences of up to 32767 stay right
        many = (run[width:] - run[:-width]) * 2 > width
        out[at : at + len(many)] = np.packbits(many, axis=1).view(np.uint64).ravel()
    return out


class BlockIndex:
    """Fingerprints found again within a Hamming radius, by ``radius + 1`` blocks of their bits."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges[:-1], edges[1:]):
            value = self._part(prints, low, high)
            order = np.argsort(value, kind="stable")
            if high - low <= 22:
                start = np.searchsorted(value[order], np.arange((1 << (high - low)) + 1, dtype=np.uint64))
                self.blocks.append((low, high, order, start, None))
            else:
                self.blocks.append((low, high, order, None, value[order]))

    @staticmethod
    def _part(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``prints``, rows of the index) of all pairs within the radius, each once."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high, order, start, values in self.blocks:
            v = self._part(prints, low, high)
            if start is not None:
                a, b = start[v], start[v + np.uint64(1)]
            else:
                a, b = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            rows = np.flatnonzero(b > a)
            for lo in range(0, len(rows), 1 << 16):
                r = rows[lo : lo + (1 << 16)]
                n = b[r] - a[r]
                i = np.repeat(r, n)
                j = order[np.repeat(a[r], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                close = np.bitwise_count(prints[i] ^ self.prints[j]) <= self.radius
                left.append(i[close]), right.append(j[close])
        pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        return pair[:, 0], pair[:, 1]


class Items:
    """One slice of the items, ready for the search.

    Windows that several items share, as an instruction they have in common, are in the
    index once; their owners are attached to what was found.
    """

    def __init__(self, ids: list[int], texts: list[str], width: int, radius: int) -> None:
        hashes = WordHashes()
        self.width = width
        per = [hashes(words(t)) for t in texts]
        self.words = np.concatenate([np.zeros(0, np.uint64), *per])
        size = np.array([len(p) for p in per], np.int64)
        start = np.r_[0, np.cumsum(size)][:-1]
        window, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (s, n) in enumerate(zip(start, size)):
            m = max(0, n - width + 1)
            window.append(s + np.arange(m)), owner.append(np.full(m, k))
        at, who = np.concatenate(window), np.concatenate(owner)
        self.ids, self.size = np.array(ids, np.int64), size
        # equal windows: one in the index, with the places it stands in (item, position)
        text = np.lib.stride_tricks.sliding_window_view(self.words, width)[at] if len(at) else np.zeros((0, width), np.uint64)
        whole = np.ascontiguousarray(text).view(np.dtype((np.void, width * 8))).ravel()
        _, first, back = np.unique(whole, return_index=True, return_inverse=True)
        back = back.ravel()
        order = np.argsort(back, kind="stable")
        self.start = at[first]
        self.place_owner, self.place_at = who[order], at[order]
        self.place_first = np.r_[0, np.cumsum(np.bincount(back, minlength=len(first)))]
        feats = np.concatenate([np.zeros(0, np.uint64), *(np.r_[shingles(p), np.zeros(min(1, len(p)), np.uint64)] for p in per)])
        prints = simhashes(feats, width - 1)
        self.index = BlockIndex(prints[self.start], radius) if len(self.start) else None
        # weight of a shingle: rare among the items counts more
        value, count = np.unique(feats, return_counts=True)
        self.rare, self.weight = value, 1 + np.log(max(1, len(per)) / np.minimum(count, max(1, len(per))))

    def weights(self, feats: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.rare, feats), max(0, len(self.rare) - 1))
        top = 1 + np.log(max(1, len(self.ids)))
        return np.where(self.rare[at] == feats, self.weight[at], top) if len(self.rare) else np.full(feats.shape, top)

    def similarity(self, doc: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of the shingle sets of document and item windows."""
        span = np.arange(self.width)
        out = np.ones(len(i))
        for lo in range(0, len(i), 1 << 14):
            a, b = doc[i[lo : lo + (1 << 14), None] + span], self.words[self.start[j[lo : lo + (1 << 14)]][:, None] + span]
            differ = np.flatnonzero((a != b).any(1))
            p, q = (mix(x[differ, :-1], x[differ, 1:]) for x in (a, b))
            # a repeated shingle of a window counts once; the second window's weigh only where the first lacks them
            p, q = np.sort(p, 1), np.sort(q, 1)
            new_p = np.concatenate([np.ones((len(p), 1), bool), p[:, 1:] != p[:, :-1]], 1)
            new_q = np.concatenate([np.ones((len(q), 1), bool), q[:, 1:] != q[:, :-1]], 1)
            known = (q[:, :, None] == p[:, None, :]).any(2)
            wp, wq = self.weights(p) * new_p, self.weights(q) * new_q
            both = (wq * known).sum(1)
            out[lo + differ] = both / (wp.sum(1) + wq.sum(1) - both)
        return out

    def places(self, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document position, item, position in the items' words, similarity): each hit once for every place its window stands in."""
        n = self.place_first[j + 1] - self.place_first[j]
        at = np.repeat(self.place_first[j] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(i, n), self.place_owner[at], self.place_at[at], np.repeat(sim, n)


def leaked_passages(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    min_words: int = 12, radius: int = 3, min_similarity: float = 0.8,
) -> DataFrame:
    """``doc_id, item_id, windows, similarity, longest_run, item_share``: items found in each document.

    A row tells that some window of the document lies within ``radius`` bits of a window
    of the item and has a weighted shingle similarity of ``min_similarity`` or more;
    ``windows`` counts the item's windows found, ``longest_run`` the longest run of
    consecutive words in common (0 if no window is shared word by word), ``item_share``
    the part of the item's windows found. A common run of ``min_words`` words is always
    found: its windows have the same fingerprint.

    Every text is searched whole. Null and empty texts and those of fewer than
    ``min_words`` words match nothing; null ids are dropped; several documents of one id
    are one document (its best figures); empty tables give an empty result. Items are sent to the tasks in
    slices of at most about ``SLICE_CHARS`` characters, each searched against all rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null")
    keyed = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("t")).where("item_id is not null and t is not null")
    chars = keyed.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = -(-chars // SLICE_CHARS)
    schema = "doc_id long, item_id long, windows int, similarity double, longest_run int, item_share double"
    found = spark.createDataFrame([], schema)
    for s in range(slices):
        rows = keyed.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).collect()
        part = Items([r["item_id"] for r in rows], [r["t"] for r in rows], min_words, radius)
        if part.index is not None:
            found = found.unionByName(spread(docs).mapInArrow(_searcher(part, min_similarity), schema))
    best = found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("windows", "similarity", "longest_run", "item_share")])
    return best


def _searcher(items: Items, min_similarity: float):  # noqa: ANN202
    width = items.width

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held: list[np.ndarray] = []
            own: list[int] = []
            total = 0
            for k, t in enumerate(batch.column(1).to_pylist()):
                h = hashes(words(t))
                if len(h) >= width:
                    held.append(h), own.append(k)
                    total += len(h)
                if total > 1 << 18:
                    yield from _match(items, held, [ids[x] for x in own], min_similarity)
                    held, own, total = [], [], 0
            if held:
                yield from _match(items, held, [ids[x] for x in own], min_similarity)

    return search


def _match(items: Items, texts: list[np.ndarray], ids: list[int], min_similarity: float) -> Iterator[pa.RecordBatch]:
    width = items.width
    doc = np.concatenate(texts)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)
    prints = simhashes(shingles(doc), width - 1)
    whole = np.flatnonzero(np.arange(len(prints)) + width <= end[owner[: len(prints)]])
    i, j = items.index.near(prints[whole])
    i = whole[i]
    sim = items.similarity(doc, i, j)
    ok = sim >= min_similarity
    i, t, at, sim = items.places(i[ok], j[ok], sim[ok])
    if not len(i):
        return
    d = owner[i]
    code = d * len(items.ids) + t
    # runs: equal windows that follow each other in both texts
    span = np.arange(width)
    e = np.concatenate([x + np.flatnonzero((doc[i[x : x + (1 << 16), None] + span] == items.words[at[x : x + (1 << 16), None] + span]).all(1)) for x in range(0, len(i), 1 << 16)])
    shift = at[e] - i[e]
    order = np.lexsort((i[e], shift, code[e]))
    e, shift = e[order], shift[order]
    start = np.r_[True, (code[e][1:] != code[e][:-1]) | (shift[1:] != shift[:-1]) | (i[e][1:] != i[e][:-1] + 1)][: len(e)]
    run = np.arange(len(e)) - np.maximum.accumulate(np.where(start, np.arange(len(e)), 0)) + width
    keys, back = np.unique(code, return_inverse=True)
    back = back.ravel()
    longest, best = np.zeros(len(keys), np.int64), np.zeros(len(keys))
    np.maximum.at(longest, back[e], run)
    np.maximum.at(best, back, sim)
    # an item's windows found: each of its places once
    n = np.bincount(np.unique(np.stack([back, at], 1), axis=0)[:, 0], minlength=len(keys))
    owner_of, item = keys // len(items.ids), keys % len(items.ids)
    every = items.size[item] - width + 1
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([ids[a] for a in owner_of.tolist()], pa.int64()), pa.array(items.ids[item], pa.int64()), pa.array(n, pa.int32()),
            pa.array(best, pa.float64()), pa.array(longest, pa.int32()), pa.array(n / every, pa.float64()),
        ],
        names=["doc_id", "item_id", "windows", "similarity", "longest_run", "item_share"],
    )
