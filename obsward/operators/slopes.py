"""The median slope of all pairs of a group, by counting instead of making them, in NumPy."""

from __future__ import annotations

import numpy as np

#: Stations up to which all pairs are made; pairs that are made at once at the end of the search.
FEW, MADE = 1000, 4_000_000


def median_slope(z: np.ndarray, v: np.ndarray) -> float:
    """Median of (v_a - v_b) / (z_a - z_b) over all pairs, 0 where z lies less than 1 apart; NaN without pairs.

    Slopes up to a given one are counted by ranks, in n log² n.  Bounds are taken from sampled pairs and drawn together
    until few slopes lie between them; only these are made.
    """
    n = len(z)
    if n < 2:
        return float("nan")
    order = np.argsort(z, kind="stable")
    z, v = np.asarray(z, dtype=float)[order], np.asarray(v, dtype=float)[order]
    total = n * (n - 1) // 2
    ranks = [(total - 1) // 2, total // 2]
    if n <= FEW:
        i, j = np.triu_indices(n, 1)
        dz, dv = z[j] - z[i], v[j] - v[i]
        slopes = np.where(dz >= 1, dv / np.where(dz >= 1, dz, 1), 0.0)
        return float(np.mean(np.partition(slopes, ranks)[ranks]))
    first = _far_below(z)
    far = int(first.sum())
    level = total - far
    falling = far - int(_not_above(v, first, True).sum())  # far pairs whose slope is below 0
    wanted = [k if k < falling else k - level for k in ranks if not falling <= k < falling + level]
    found = _selected(z, v, first, wanted) if wanted else []
    return float(np.mean([*found, *[0.0] * (2 - len(wanted))]))


def _far_below(z: np.ndarray) -> np.ndarray:
    """For each place of sorted z, how many places lie at least 1 below it."""
    first = np.searchsorted(z, z - 1, side="right")
    while True:  # z - 1 is rounded, the difference of two is what counts
        less = (first > 0) & (z - z[np.maximum(first - 1, 0)] < 1)
        more = ~less & (z - z[np.minimum(first, len(z) - 1)] >= 1)
        if not (less | more).any():
            return first
        first = first - less + more


def _not_above(u: np.ndarray, first: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each i, how many k < first[i] have u[k] < u[i], or equal.

    A prefix is made of one block for each bit of its length, so every level of blocks is sorted and searched once.
    """
    n = len(u)
    values = np.sort(u)
    rank = np.searchsorted(values, u, side="left")
    found = np.zeros(n, dtype=np.int64)
    size = 1
    while size <= n:
        on = np.flatnonzero(first & size)
        if len(on):
            block = (first[on] & ~(2 * size - 1)) // size
            whole = n // size * size
            key = np.arange(whole, dtype=np.int64) // size * n + rank[:whole]
            key.sort()
            found[on] += np.searchsorted(key, block * n + rank[on], side="right" if or_equal else "left") - block * size
        size *= 2
    return found


def _selected(z: np.ndarray, v: np.ndarray, first: np.ndarray, wanted: list[int]) -> list[float]:
    """The slopes of these ranks (next to each other) among the pairs at least 1 apart."""
    ends = np.cumsum(first)
    far = int(ends[-1])
    steepest = float(v.max() - v.min()) * (1 + 1e-9)
    if not steepest:
        return [0.0] * len(wanted)

    def count(slope: float) -> int:
        """Pairs whose slope is at most this one: those whose later station isn't above the line through the earlier."""
        return far - int(_not_above(v - slope * z, first, False).sum())

    low, high, a, b = -steepest, steepest, 0, far
    r = np.random.default_rng(0)
    drawn = r.integers(0, far, max(200_000, len(z)))
    i = np.searchsorted(ends, drawn, side="right")
    k = drawn - (ends[i] - first[i])
    sample = np.sort((v[i] - v[k]) / (z[i] - z[k]))
    share, room = wanted[0] / far, 4 * (len(sample) ** -0.5)
    at = [sample[int(np.clip((share + s * room) * len(sample), 0, len(sample) - 1))] for s in (-0.5, 0.5)]
    width = 0.005
    while True:
        for slope in at:
            if low < slope < high:
                c = count(float(slope))
                if c <= wanted[0]:
                    low, a = float(slope), max(a, c)
                elif c > wanted[-1]:
                    high, b = float(slope), min(b, c)
        pairs = _between(z, v, first, low, high)
        if pairs is not None:
            slopes = np.sort(pairs)
            return [float(slopes[min(max(w - a, 0), len(slopes) - 1)]) for w in wanted]
        if high - low <= 4e-15 * max(abs(low), abs(high)) + 1e-16 * steepest:  # no finer than the slopes are rounded
            return [high] * len(wanted)
        share = (wanted[0] + 0.5 - a) / (b - a)
        middle = low + (high - low) * share
        before = high - low
        at = [middle - width * before, middle + width * before] if width < 0.25 else [(low + high) / 2]
        width = width * 2 if width < 0.25 else 0.005


def _between(z: np.ndarray, v: np.ndarray, first: np.ndarray, low: float, high: float) -> np.ndarray | None:
    """Slopes above low and at most high; None where too many pairs would have to be looked at.

    Two stations' heights above lines of the slope `low` change places until `high` only if they differ by no more than
    the lines part over the range of z.
    """
    u, w = v - low * z, v - high * z
    order = np.argsort(u, kind="stable")
    sorted_ = u[order]
    room = (high - low) * (z[-1] - z[0]) * (1 + 1e-9) + 1e-12 * float(np.abs(sorted_[[0, -1]]).max())
    start = np.searchsorted(sorted_, sorted_ - room, side="left")
    many = np.arange(len(u)) - start
    if int(many.sum()) > max(MADE, 4 * len(u)):
        return None
    out, ends = [], np.cumsum(many)
    a = 0
    while a < len(u):
        c = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MADE, side="right")))
        some = many[a:c]
        later = np.repeat(np.arange(a, c), some)
        earlier = np.arange(len(later)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(start[a:c], some)
        i, k = order[later], order[earlier]
        on = (k < first[i]) & (u[k] < u[i]) & (w[k] >= w[i])
        i, k = i[on], k[on]
        out.append((v[i] - v[k]) / (z[i] - z[k]))
        a = c
    return np.concatenate(out) if out else np.zeros(0)
