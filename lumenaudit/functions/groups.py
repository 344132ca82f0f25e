"""Groups that links join inside one block of rows."""

from __future__ import annotations

import numpy as np

from lumenaudit.functions.vectors import unit


class Groups:
    """Disjoint groups of 0..n-1, joined by arrays of edges; the label of a group is its least member."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the groups of ``a[i]`` and ``b[i]``: larger labels hook to the least linked one until all agree."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            differ = la != lb
            if not differ.any():
                return
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            to = np.arange(len(self.label))
            np.minimum.at(to, np.maximum(la, lb), np.minimum(la, lb))
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


def similar_groups(units: np.ndarray, least: float, strict: bool, counts_of: int = 2, block: int = 512) -> np.ndarray:
    """Labels of the groups that links of similarity ``least`` or more (``strict``: more) join; -1: in none.

    ``counts_of``: a row is a core if so many rows, itself included, lie within reach;
    only links of cores join, and a row that is no core belongs to its first core's group.
    Single-precision products find links; those within 1e-5 of the bound are computed
    again in double precision.
    """
    n = len(units)
    f = np.ascontiguousarray(units.astype(np.float32))
    groups = Groups(n)
    near = np.zeros(n, np.int64)

    def links(rows: np.ndarray, cols: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        s = f[rows] @ (f.T if cols is None else f[cols].T)
        r, c = np.nonzero(s > least - 1e-5)
        close = np.flatnonzero(s[r, c] < least + 1e-5)
        i, j = rows[r], c if cols is None else cols[c]
        if len(close):
            exact = np.einsum("ij,ij->i", units[i[close]], units[j[close]])
            keep = np.ones(len(i), bool)
            keep[close[exact <= least] if strict else close[np.round(exact, 6) < least]] = False
            i, j = i[keep], j[keep]
        return i, j

    if counts_of <= 2:
        open_ = np.ones(n, bool)
        while open_.any():
            label, size = np.unique(groups.label[open_], return_counts=True)
            large = label[size.argmax()] if size.max() >= block else None
            if large is None:
                rows = np.flatnonzero(open_)[:block]
                groups.join(*links(rows, None))
            else:
                # rows of one large group need only be compared with what is not in it yet
                rows = np.flatnonzero(open_ & (groups.label == large))[: 4 * block]
                cols = np.flatnonzero(groups.label != large)
                if len(cols):
                    groups.join(*links(rows, cols))
                else:
                    break
            open_[rows] = False
        _, back, count = np.unique(groups.label, return_inverse=True, return_counts=True)
        return np.where(count[back] > 1, groups.label, -1) if n else groups.label

    def hits(at: int) -> tuple[np.ndarray, np.ndarray]:
        return links(np.arange(at, min(at + block, n)), None)

    for at in range(0, n, block):
        r, _ = hits(at)
        near += np.bincount(r, minlength=n)
    core = near >= counts_of
    owner = np.full(n, n)
    for at in range(0, n, block):
        r, c = hits(at)
        both = core[r] & core[c]
        groups.join(r[both], c[both])
        edge = core[r] & ~core[c]
        np.minimum.at(owner, c[edge], r[edge])
    out = np.where(core, groups.label, -1)
    reached = ~core & (owner < n)
    out[reached] = groups.label[owner[reached]]
    return out


def linked_groups(rows: np.ndarray, left: np.ndarray, right: np.ndarray, above: float, block: int = 512, wide: int = 4096) -> np.ndarray:
    """Labels of the groups that links of cosine above ``above`` join; each row's own number if in none.

    Every row of ``left`` is compared with every row of ``right``: two sets that share no
    row, or one and the same. Equal rows are compared once, and blocks that lie in one
    group already not at all. Single-precision products find links; those within 1e-5 of
    the bound are computed again in double precision.
    """
    groups = Groups(len(rows))
    if not len(left) or not len(right):
        return groups.label
    same = left is right
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel()
    _, first, back = np.unique(whole, return_index=True, return_inverse=True)
    groups.join(np.arange(len(rows)), first[back.ravel()])
    alone = np.zeros(len(rows), bool)
    alone[first] = True
    if same:
        left = right = left[alone[left]]
    else:
        # a row whose equal is on the other side is linked already, but speaks for its side
        left, right = (x[np.unique(back.ravel()[x], return_index=True)[1]] for x in (left, right))
    f = [np.concatenate([unit(rows[x[at : at + wide]]).astype(np.float32) for at in range(0, len(x), wide)]) for x in ((left,) if same else (left, right))]
    q, base = f[0], f[-1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for at in range(0, len(left), block):
        for to in range(at if same else 0, len(right), wide):
            here, there = left[at : at + block], right[to : to + wide]
            own = groups.label[here[0]]
            if (groups.label[here] == own).all() and (groups.label[there] == own).all():
                continue
            s = q[at : at + block] @ base[to : to + wide].T
            hit = np.flatnonzero(s > above - 1e-5)
            i, j, near = here[hit // s.shape[1]], there[hit % s.shape[1]], s.ravel()[hit]
            new = groups.label[i] != groups.label[j]
            i, j, near = i[new], j[new], near[new]
            close = np.flatnonzero(near < above + 1e-5)
            if len(close):
                keep = np.ones(len(i), bool)
                for part in np.array_split(close, -(-len(close) // wide)):
                    keep[part] = np.einsum("ij,ij->i", unit(rows[i[part]]), unit(rows[j[part]])) > above
                i, j = i[keep], j[keep]
            if len(i):
                found.append((i, j))
                held += len(i)
            if held > 1 << 18:
                groups.join(*(np.concatenate(x) for x in zip(*found)))
                found, held = [], 0
    if found:
        groups.join(*(np.concatenate(x) for x in zip(*found)))
    return groups.label
