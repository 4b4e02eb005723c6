"""Sums over the points in the reach of many queries, in NumPy, without making their pairs.

Points lie in Morton order under a tree of bounding boxes.  All queries go down it together: a box wholly within a
query's reach adds its sums, one wholly beyond adds nothing, others are opened, and points are looked at one by one only
along the edge of a reach.  A caller that can tell its answer from bounds ends its queries early.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

LEAF, FAN = 16, 4
#: Pairs of a query and a box, or of a query and a leaf's points, that are held at once.
MOST, MOST_LEAVES = 1 << 17, 1 << 13
#: Relative room around a box's verdict; whatever lies within it is decided point by point.
ROOM = 1e-9


@dataclass
class Side:
    """A further condition on one number of the points: low and high of each query, taken with room, and the exact test.

    exact: of the points' numbers (a row for each query number given), these query numbers, and the numbers of all sides.
    scale: metres of reach that one unit stands for, where boxes are formed.  room: about low and high, beside ROOM.
    """

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    exact: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray | bool]
    scale: float = 1.0
    room: float = 0.0


def within(points: np.ndarray, queries: np.ndarray, most: np.ndarray | float, scale: float) -> Side:
    """Numbers at most `most` apart."""
    width = np.broadcast_to(np.asarray(most, dtype=float), queries.shape)
    return Side(points, queries - width, queries + width, lambda p, i, sides: np.abs(queries[i, None] - p) <= width[i, None], scale)


def scale(reach: np.ndarray, width: np.ndarray) -> float:
    """Metres of reach for one unit of a side condition, so that boxes are as small against one as against the other."""
    a, b = (float(np.max(v[np.isfinite(v)], initial=0.0)) for v in (reach, width))
    return a / b if a > 0 and b > 0 else 1.0


def _codes(at: np.ndarray, start: np.ndarray, step: float) -> np.ndarray:
    """Places along a Morton curve; infinite numbers at its ends."""
    bits = min(20, 62 // at.shape[1])
    with np.errstate(invalid="ignore", over="ignore"):
        cells = np.clip(np.nan_to_num((at - start) / step), 0, (1 << bits) - 1).astype(np.int64)
    code = np.zeros(len(at), dtype=np.int64)
    for b in range(bits):
        for k in range(at.shape[1]):
            code |= (cells[:, k] >> b & 1) << (b * at.shape[1] + k)
    return code


def _padded(a: np.ndarray, to: int, value: float) -> np.ndarray:
    more = -len(a) % to
    return np.concatenate([a, np.full((more, *a.shape[1:]), value)]) if more else a


def _level(lo: np.ndarray, hi: np.ndarray, total: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    return tuple([np.ascontiguousarray(a[:, k]) for k in range(a.shape[1])] for a in (lo, hi, total))


class Tree:
    """at: x, y, z of the points; sums: numbers to be summed, a column each; sides: further conditions."""

    def __init__(self, at: np.ndarray, sums: np.ndarray, sides: list[Side]):
        self.sides = sides
        full = np.column_stack([at, *[s.points for s in sides]]).astype(float)
        with np.errstate(invalid="ignore"):
            scaled = full * np.array([1.0, 1.0, 1.0, *[s.scale for s in sides]])
        finite = np.where(np.isfinite(scaled), scaled, np.nan)
        self.start = np.fmin.reduce(finite, axis=0) if len(at) else np.zeros(full.shape[1])
        self.start = np.nan_to_num(self.start)
        extent = float(np.nanmax(np.fmax.reduce(finite, axis=0) - self.start, initial=0.0)) if len(at) else 0.0
        self.step = max(extent, 1e-9) / (1 << min(20, 62 // full.shape[1]))
        order = np.argsort(_codes(scaled, self.start, self.step), kind="stable")
        self.order = order
        self.points = _padded(full[order], LEAF, np.nan).reshape(-1, LEAF, full.shape[1])
        self.leaf_sums = _padded(sums[order].astype(float), LEAF, 0.0).reshape(-1, LEAF, sums.shape[1])
        self.columns = [np.ascontiguousarray(self.points[:, :, k]) for k in range(full.shape[1])]
        self.weights = [np.ascontiguousarray(self.leaf_sums[:, :, k]) for k in range(sums.shape[1])]
        lo, hi, total = np.fmin.reduce(self.points, axis=1), np.fmax.reduce(self.points, axis=1), self.leaf_sums.sum(axis=1)
        self.levels = [_level(lo, hi, total)]
        while len(lo) > 64:
            lo, hi = (_padded(a, FAN, np.nan).reshape(-1, FAN, a.shape[1]) for a in (lo, hi))
            lo, hi = np.fmin.reduce(lo, axis=1), np.fmax.reduce(hi, axis=1)
            total = _padded(total, FAN, 0.0).reshape(-1, FAN, total.shape[1]).sum(axis=1)
            self.levels.append(_level(lo, hi, total))

    def visit(self, at: np.ndarray, radius: np.ndarray, apart: bool, settled: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Sums of the points within the radius (inclusive) of each query; apart: without those at its very place.

        settled: given query numbers, what is summed for them and the sums of what may still come in part, says which of
        them need no more.  It is asked after every level, last with nothing more to come.
        """
        m, k = len(at), len(self.weights)
        found = np.zeros((m, k))
        if not m:
            return found
        if not len(self.points):
            if settled is not None:
                settled(np.arange(m), found, np.zeros((m, k)))
            return found
        order = np.argsort(_codes(at, self.start[:3], self.step), kind="stable")
        top = len(self.levels) - 1
        wide = len(self.levels[top][0][0])
        block = max(1, MOST // wide)
        for a in range(0, m, block):
            rows = order[a : a + block]
            work = [(top, rows, np.repeat(np.arange(len(rows)), wide), np.tile(np.arange(wide), len(rows)))]
            while work:
                level, rows, who, node = work.pop()
                rows, who, node = self._open(level, at, radius, apart, settled, found, rows, who, node)
                if not len(who):
                    continue
                if level == 0:
                    self._leaves(at, radius, apart, found, rows, who, node)
                    if settled is not None:
                        settled(rows, found[rows], np.zeros((len(rows), k)))
                    continue
                who, node = np.repeat(who, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                on = node < len(self.levels[level - 1][0][0])
                who, node = who[on], node[on]
                work.extend((level - 1, rows[b:c], who[s:e] - b, node[s:e]) for b, c, s, e in _cuts(who, len(rows)))
        return found

    def _open(self, level, at, radius, apart, settled, found, rows, who, node):
        """Sums what is wholly within; the queries and boxes that are left."""
        lo, hi, total = self.levels[level]
        n = len(rows)
        near, far = None, None
        for k in range(3):
            q = at[rows, k][who]
            below, above = lo[k][node] - q, q - hi[k][node]
            span = np.minimum(below, above)
            gap = np.maximum(np.maximum(below, above, out=below), 0.0, out=below)
            gap *= gap
            span *= span
            near, far = (gap, span) if near is None else (near + gap, far + span)
        square = (radius[rows] ** 2)[who]
        may = near <= square * (1 + ROOM)
        whole = far <= square * (1 - ROOM)
        if apart:
            whole &= near > 0
        for k, s in enumerate(self.sides, 3):
            low, high = s.low[rows], s.high[rows]
            if np.isneginf(low).all() and np.isposinf(high).all():
                continue
            a, b = lo[k][node], hi[k][node]
            room = ROOM * (np.where(np.isfinite(low), np.abs(low), 0) + np.where(np.isfinite(high), np.abs(high), 0) + 1) + 2 * s.room
            may &= (b >= (low - room)[who]) & (a <= (high + room)[who])
            whole &= (a >= (low + room)[who]) & (b <= (high - room)[who])
        whole &= may
        w, v = who[whole], node[whole]
        for j, t in enumerate(total):
            found[rows, j] += np.bincount(w, weights=t[v], minlength=n)
        open_ = np.flatnonzero(may & ~whole)
        who, node = who[open_], node[open_]
        if settled is not None:
            more = np.column_stack([np.bincount(who, weights=t[node], minlength=n) for t in total])
            on = ~settled(rows, found[rows], more)
            some = on[who]
            who, node = who[some], node[some]
        else:
            on = np.bincount(who, minlength=n) > 0
        return rows[on], (np.cumsum(on) - 1)[who], node

    def _leaves(self, at, radius, apart, found, rows, who, node):
        n = len(rows)
        for a in range(0, len(who), MOST_LEAVES):
            w, leaf = who[a : a + MOST_LEAVES], node[a : a + MOST_LEAVES]
            q = rows[w]
            d = [self.columns[k][leaf] - at[q, k][:, None] for k in range(3)]
            on = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= radius[q][:, None]
            if apart:
                on &= (d[0] != 0) | (d[1] != 0) | (d[2] != 0)
            numbers = [self.columns[k][leaf] for k in range(3, len(self.columns))]
            for s, p in zip(self.sides, numbers, strict=True):
                on &= s.exact(p, q, numbers)
            for j, weight in enumerate(self.weights):
                found[rows, j] += np.bincount(w, weights=np.where(on, weight[leaf], 0.0).sum(axis=1), minlength=n)


def _cuts(who: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of queries, and of their pairs, of about MOST pairs at most; a query stays whole."""
    ends = np.searchsorted(who, np.arange(1, n + 1))
    b = s = 0
    while b < n:
        c = max(b + 1, int(np.searchsorted(ends, s + MOST, side="right")))
        e = int(ends[c - 1])
        yield b, c, s, e
        b, s = c, e


def counts(at: np.ndarray, points: np.ndarray, radius: np.ndarray, apart: bool, enough: np.ndarray | None = None, sides: list[Side] | None = None) -> np.ndarray:
    """Numbers of points within the reach of each query; from `enough` on, or where it can't be had, they may be less than
    all (but not less than enough, or not more than all)."""
    done = None
    if enough is not None:

        def done(i: np.ndarray, sure: np.ndarray, more: np.ndarray) -> np.ndarray:
            return (sure[:, 0] >= enough[i]) | (sure[:, 0] + more[:, 0] < enough[i])

    return Tree(points, np.ones((len(points), 1)), sides or []).visit(at, radius, apart, done)[:, 0]
