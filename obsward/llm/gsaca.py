"""Suffix array by grouping suffixes under their Lyndon prefixes, without recursive renaming."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Starts of the suffixes in order.  The last symbol must be smaller than all others.

    First the suffixes are grouped by their first symbol.  Groups are then taken from the greatest down.  For each
    member, `prev` is found: the nearest earlier place of a smaller group; that suffix continues with the group's
    prefix, so it moves into a new group right above its old one, places with more of the prefix above those with less.
    In the end a group holds the suffixes with one Lyndon prefix.  A single pass from the smallest suffix then puts
    each suffix, and those its `prev` pointers lead to, at the next free place of its group.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    place_of = np.empty(n, dtype=np.int64)
    place_of[sa] = np.arange(n)
    ordered = symbols[sa]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    widths = np.diff(np.append(starts, n))
    group_of = np.empty(n, dtype=np.int64)
    group_of[sa] = np.repeat(starts, widths)
    size_of = np.zeros(n, dtype=np.int64)
    size_of[starts] = widths
    order, place, group, size = sa.tolist(), place_of.tolist(), group_of.tolist(), size_of.tolist()
    prev = [-1] * n

    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end]
        end = g
        if len(members) > 1:
            members.sort()
        count: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if not count:
            continue
        if len(count) == len(members):
            classes = [list(count)]
        else:
            by: dict[int, list[int]] = {}
            for p, k in count.items():
                by.setdefault(k, []).append(p)
            classes = [by[k] for k in sorted(by, reverse=True)]
        for some in classes:
            moved: dict[int, int] = {}
            for j in some:
                h = group[j]
                last = h + size[h] - 1
                at, other = place[j], order[last]
                order[at] = other
                place[other] = at
                order[last] = j
                place[j] = last
                size[h] -= 1
                moved[h] = moved.get(h, 0) + 1
            for j in some:
                h = group[j]
                if h in moved:
                    group[j] = h + size[h]
            for h, m in moved.items():
                size[h + size[h]] = m

    free = list(range(n))
    out = [-1] * n
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            at = free[g]
            out[at] = s
            free[g] = at + 1
            done[s] = 1
            s = prev[s]
    return out
