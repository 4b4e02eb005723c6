"""Order-dependent consistency tests over one network of stations, in NumPy.

A network is a dict of arrays in the order of station ids: x, y, z, lat, lon, elev, value and the check's parameters.
Stations are taken in that order, and what one leaves in the flags the next ones see.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from typing import Any

import numpy as np

from obsward.operators.background import background, invert, quantile, vertical_profile
from obsward.types import BAD, EARTH_RADIUS, GOOD, ISOLATED_INNER, ISOLATED_OUTER, NOT_CHECKED, NOT_INVERTIBLE, ConditionType, member

Network = dict[str, np.ndarray]


class Places:
    """Neighbour lookup in cells of one radius."""

    def __init__(self, net: Network, radius: float):
        self.at = np.stack([net["x"], net["y"], net["z"]], axis=1)
        self.radius = radius
        cell = np.floor(self.at / max(radius, 1.0)).astype(np.int64)
        self.cell = list(map(tuple, cell.tolist()))
        self.members: dict[tuple[int, ...], list[int]] = {}
        for i, c in enumerate(self.cell):
            self.members.setdefault(c, []).append(i)

    def around(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Stations within the radius, itself too, by number; and their distances."""
        x, y, z = self.cell[i]
        some = [k for dx, dy, dz in product((-1, 0, 1), repeat=3) for k in self.members.get((x + dx, y + dy, z + dz), ())]
        found = np.sort(np.array(some))
        d = np.sqrt(((self.at[found] - self.at[i]) ** 2).sum(axis=1))
        on = d <= self.radius
        return found[on], d[on]


class Near:
    """Neighbour lookup that looks no further than it must: in cells of growing radii, the last of which is the radius."""

    def __init__(self, net: Network, radius: float, most: int):
        self.net, self.radius = net, radius
        a, b = sorted(float(np.ptp(net[k])) if len(net[k]) else 0.0 for k in "xyz")[1:]
        self.first = min(radius, max(1.0, (max(a, b / 1000) * b * 2 * (most + 1) / (np.pi * max(len(net["x"]), 1))) ** 0.5))
        self.levels: dict[float, Places] = {}

    def around(self, i: int, enough: int, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As that of Places, but if more than `enough` (of those in use) lie within a smaller radius, only these."""
        r = self.first
        while True:
            if r not in self.levels:
                self.levels[r] = Places(self.net, r)
            found, d = self.levels[r].around(i)
            if r >= self.radius or (len(found) if use is None else int(use[found].sum())) > enough:
                return found, d
            r = min(2 * r, self.radius)


def closest(found: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    if len(found) <= most:
        return found, d
    order = np.argsort(d, kind="stable")[:most]
    return found[order], d[order]


def great_circles(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    cosine = np.cos(a)[:, None] * np.cos(a) * np.cos(o[:, None] - o) + np.sin(a)[:, None] * np.sin(a)
    d = np.arccos(np.clip(cosine, -1, 1)) * EARTH_RADIUS
    d[(lat[:, None] == lat) & (lon[:, None] == lon)] = 0
    return d


def correlations(lat: np.ndarray, lon: np.ndarray, elev: np.ndarray, horizontal: float, vertical: float, distances: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * (distances / horizontal) ** 2 - 0.5 * ((elev[:, None] - elev) / vertical) ** 2)


# --- spatial consistency test -------------------------------------------------------------------------------------


def sct(net: Network, p: dict[str, Any], unknown: np.ndarray | None = None, margin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flags and gross-error scores.  net: pos, neg, eps2, wanted beside the common arrays.

    unknown, margin: of a part of the stations, see CircleTest.
    """
    n = len(net["x"])
    flags, score = np.where(np.isfinite(net["elev"]), 0, 1), np.zeros(n)
    places, wanted = Near(net, p["outer_radius"], p["num_max"]), net["wanted"]
    unknown = np.zeros(n, bool) if unknown is None else unknown
    for _ in range(p["num_iterations"]):
        thrown, checked = 0, ~wanted | (flags != 0)
        for i in range(n):
            if (checked[i] or flags[i]) and not (unknown[i] and wanted[i]):
                continue
            box, d = places.around(i, p["num_max"], (flags == 0) & ~unknown if unknown.any() else flags == 0)
            free = flags[box] == 0
            if margin is not None:
                sure = np.sort(d[free & ~unknown[box]])
                reach = sure[p["num_max"] - 1] if 0 < p["num_max"] <= len(sure) else p["outer_radius"]
                if unknown[i] or reach >= margin[i] or unknown[box[d <= reach]].any():
                    unknown[box[(d <= reach) & free]] = unknown[i] = True
                    continue
            box, d = closest(box[free], d[free], p["num_max"])
            if len(box) < p["num_min"]:
                checked[i] = True
                continue
            judged = _optimal_interpolation(net, box, p)
            if judged is None:
                continue
            cvres, error = judged
            if not wanted[box].all():
                checked[i] = True
            inner = (d <= p["inner_radius"]) & wanted[box]
            at, e = box[inner], error[inner]
            score[at] = np.maximum(score[at], e)
            bad = np.where(cvres[inner] < 0, e > net["pos"][at], e > net["neg"][at])
            flags[at[bad]] = 1
            thrown += int(bad.sum())
            checked[at] = True
        if not thrown and not unknown.any():
            break
    return flags, score


def _optimal_interpolation(net: Network, box: np.ndarray, p: dict[str, Any]) -> tuple[np.ndarray, np.ndarray] | None:
    """Leave-one-out residuals and gross-error scores of the box; None for a singular matrix."""
    lat, lon, elev, value, eps2 = (net[k][box] for k in ("lat", "lon", "elev", "value", "eps2"))
    if not (np.isfinite(value).all() and np.isfinite(elev).all()):
        raise ValueError("the spatial consistency test needs valid values")
    if p["num_min_prof"] >= 0:
        expected = vertical_profile(elev, value, elev, p["num_min_prof"], p["min_elev_diff"])
    else:
        expected = np.full(len(box), value.mean())
    distances = great_circles(lat, lon)
    # a tenth of each station's distances, one of which is its own 0
    scale = max(np.quantile(distances, 0.1, axis=1).mean(), p["min_horizontal_scale"])
    s = correlations(lat, lon, elev, scale, p["vertical_scale"], distances)
    inverse = invert(s + np.diag(eps2))
    if inverse is None:
        return None
    innovation = value - expected
    q = inverse @ innovation
    cvres, ares = -q / np.diag(inverse), -eps2 * q
    return cvres, cvres * ares / max(np.mean(-innovation * ares), 0.01)


# --- tests in inner and outer circles -------------------------------------------------------------------------------


@dataclass
class State:
    flags: np.ndarray
    score: np.ndarray


class CircleTest:
    """Frame of the tests that look at an outer circle to judge an inner one.

    First pass: each station not yet settled is a centroid; all unsettled stations of its inner circle are judged
    together.  Second: those still unsettled are judged alone.  Third: those flagged bad are judged alone once more.

    Of a part of the stations, margin says how far around each all are there.  A station whose circle goes beyond that, or
    holds one that is unknown, becomes unknown, with all that judging it could have changed; what is left is as it would
    be among all stations.
    """

    needs_two_inside = True
    plausible_only = False

    def __init__(self, net: Network, p: dict[str, Any], unknown: np.ndarray | None = None, margin: np.ndarray | None = None):
        self.net, self.p, self.margin = net, p, margin
        self.unknown = np.zeros(len(net["x"]), bool) if unknown is None else unknown
        self.places = Near(net, p["outer_radius"], p["num_max_outer"])
        self.wanted = net["wanted"]
        accepted = p.get("accept_isolated", False)
        self.outer_flag, self.inner_flag = (GOOD, GOOD) if accepted else (ISOLATED_OUTER, ISOLATED_INNER)

    def circles(self, i: int, flags: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stations of the outer circle; places in it of the inner circle's; and of those to test."""
        found, d = closest(*self.places.around(i, self.p["num_max_outer"]), self.p["num_max_outer"])
        use = flags[found] != BAD
        if alone:
            use &= found != i
        outer = found[use]
        inner = np.flatnonzero(d[use] <= self.p["inner_radius"])
        if alone:
            outer = np.append(outer, i)
            inner = np.append(inner, len(outer) - 1)
            return outer, inner, np.array([len(outer) - 1])
        f = flags[outer[inner]]
        return outer, inner, inner[(f != GOOD) & self.wanted[outer[inner]]]

    def judge(self, i: int, state: State, alone: bool, settle: bool) -> int:
        """Judge around centroid i; the number newly flagged bad."""
        flags = state.flags
        if self.margin is not None and self.leads_out(i, flags, alone):
            return 0
        outer, inner, test = self.circles(i, flags, alone)
        if len(outer) < self.p["num_min_outer"]:
            flags[i] = self.outer_flag
            return 0
        if self.needs_two_inside and len(inner) < 2:
            flags[i] = self.inner_flag
            return 0
        expected = self.expected(outer)
        if self.evidently_good(outer, test, expected, alone):
            flags[outer[test]] = GOOD
            return 0
        verdict = self.verdict(outer, inner, test, expected)
        if verdict is None:
            flags[i] = NOT_INVERTIBLE
            return 0
        bad, score, undecided = verdict
        flags[outer[bad]] = BAD
        if score is not None:
            state.score[outer[bad]] = score
        if not len(bad) and settle and not undecided:
            flags[outer[test]] = GOOD
        return len(bad)

    def leads_out(self, i: int, flags: np.ndarray, alone: bool) -> bool:
        """Whether the verdict depends on what isn't known; then it and what it may change isn't known either."""
        most = self.p["num_max_outer"]
        found, d = closest(*self.places.around(i, most), most)
        reach = d.max() if len(found) == most else self.p["outer_radius"]
        if reach < self.margin[i] and not self.unknown[i] and not self.unknown[found].any():
            return False
        if not alone:
            self.unknown[found[(flags[found] != GOOD) & (flags[found] != BAD)]] = True
        self.unknown[i] = True
        return True

    def first_pass(self, state: State, iteration: int) -> int:
        return sum(self.judge(i, state, False, iteration > 0) for i in range(len(state.flags)) if self.wanted[i] and (state.flags[i] < 0 or self.unknown[i]))

    def last_passes(self, state: State) -> None:
        for i in range(len(state.flags)):
            if self.wanted[i] and (state.flags[i] < 0 or self.unknown[i]):
                self.judge(i, state, True, True)
        value = self.net["value"]
        for i in range(len(state.flags)):
            if self.wanted[i] and state.flags[i] == BAD:
                if self.plausible_only and (value[i] < self.p["lowest"] or value[i] > self.p["highest"]):
                    continue
                self.judge(i, state, True, True)

    def expected(self, outer: np.ndarray) -> np.ndarray | None:
        external = self.net["background"][outer] if "background" in self.net else None
        return background(self.net["elev"][outer], self.net["value"][outer], self.p["background_type"], self.p["num_min_prof"], self.p["min_elev_diff"], self.p["lowest"], self.p["highest"], external)

    def evidently_good(self, outer: np.ndarray, test: np.ndarray, expected: np.ndarray, alone: bool) -> bool:
        low, high, e = self.net["minv"][outer[test]], self.net["maxv"][outer[test]], expected[test]
        return bool(((e > low) & (e < high)).all() if alone else not ((e < low) | (e > high)).any())

    def verdict(self, outer: np.ndarray, inner: np.ndarray, test: np.ndarray, expected: np.ndarray | None) -> tuple[np.ndarray, float | None, bool] | None:
        """Places found bad, their score, and whether nothing can be said; None where a matrix can't be inverted."""
        raise NotImplementedError

    def worst(self, outer: np.ndarray, inner: np.ndarray, test: np.ndarray, expected: np.ndarray, chi: np.ndarray, spread: np.ndarray, estimate: np.ndarray) -> tuple[np.ndarray, float | None, bool]:
        """The station to test that is farthest out, if its z score passes its threshold.

        chi, spread, estimate: of the outer circle.  Statistics are taken over inner stations with an admissible estimate;
        without any, all stations to test are bad.  Only those with an estimate outside the valid range can be flagged.
        """
        net = self.net
        admissible = inner[(estimate[inner] >= net["mina"][outer[inner]]) & (estimate[inner] <= net["maxa"][outer[inner]])]
        if not len(admissible):
            return test, None, False
        z = chi[test]
        if not self.p["basic"]:
            some, other = chi[admissible], spread[admissible]
            sigma = max(quantile(0.75, some) - quantile(0.25, some), quantile(0.75, other) - quantile(0.25, other))
            if sigma == 0:
                return test[:0], None, True
            z = (z - quantile(0.5, some)) / (sigma + sigma / np.sqrt(len(admissible)))
        outside = (estimate[test] < net["minv"][outer[test]]) | (estimate[test] > net["maxv"][outer[test]])
        z = np.where(outside & (z > -10000), z, -np.inf)
        k = int(z.argmax()) if len(z) else -1
        if k < 0 or z[k] == -np.inf:
            return test[:0], None, False
        g = outer[test[k]]
        threshold = net["tpos"][g] if net["value"][g] - expected[test[k]] >= 0 else net["tneg"][g]
        return (test[k : k + 1], float(z[k]), False) if z[k] > threshold else (test[:0], None, False)

    def horizontal_scale(self, distances: np.ndarray) -> float:
        """Mean distance to the k-th closest, itself the first, within bounds."""
        k = min(self.p["kth_closest"], len(distances))
        return float(np.clip(np.sort(distances, axis=1)[:, k - 1].mean(), self.p["min_horizontal_scale"], self.p["max_horizontal_scale"]))


class ResistantTest(CircleTest):
    plausible_only = True

    def verdict(self, outer: np.ndarray, inner: np.ndarray, test: np.ndarray, expected: np.ndarray) -> tuple[np.ndarray, float | None, bool] | None:
        net, p = self.net, self.p
        lat, lon, elev, value, eps2 = (net[k][outer] for k in ("lat", "lon", "elev", "value", "eps2"))
        distances = great_circles(lat, lon)
        s = correlations(lat, lon, elev, self.horizontal_scale(distances), p["vertical_scale"], distances)
        inverse = invert(s + np.diag(eps2))
        if inverse is None:
            return None
        q = inverse @ (value - expected)
        analysis = np.clip(value - eps2 * q, p["lowest"], p["highest"])
        left_out = np.clip(value - q / np.diag(inverse), p["lowest"], p["highest"])
        with np.errstate(invalid="ignore"):
            chi = np.sqrt((value - analysis) * (value - left_out))
        spread = np.sqrt(eps2 / (1 + eps2)) * (net["maxv"][outer] - net["minv"][outer])
        return self.worst(outer, inner, test, expected, chi, spread, left_out)


class FirstGuessTest(CircleTest):
    plausible_only = True

    def verdict(self, outer: np.ndarray, inner: np.ndarray, test: np.ndarray, expected: np.ndarray) -> tuple[np.ndarray, float | None, bool]:
        chi = np.abs(self.net["value"][outer] - expected) / self.net["uncertainty"][outer]
        return self.worst(outer, inner, test, expected, chi, self.net["maxv"][outer] - self.net["minv"][outer], expected)


class DualTest(CircleTest):
    """Yes or no events: a station whose neighbours of the other kind explain its place better than those of its own."""

    needs_two_inside = False
    #: Least leave-one-out influence for a judgement, own noise, floor of the own kind's influence (fixed values).
    influence, noise, floor = 0.45, 0.1, 0.001

    def __init__(self, net: Network, p: dict[str, Any], unknown: np.ndarray | None = None, margin: np.ndarray | None = None):
        super().__init__(net, p, unknown, margin)
        v, t = net["value"], net["event_threshold"]
        compare = {ConditionType.Eq: v == t, ConditionType.Gt: v > t, ConditionType.Geq: v >= t, ConditionType.Lt: v < t, ConditionType.Leq: v <= t}
        self.event = compare[member(ConditionType, p["condition"])]

    def expected(self, outer: np.ndarray) -> None:
        return None

    def evidently_good(self, outer: np.ndarray, test: np.ndarray, expected: None, alone: bool) -> bool:
        events = self.event[outer]
        return bool(events.all() or not events.any())

    def verdict(self, outer: np.ndarray, inner: np.ndarray, test: np.ndarray, expected: None) -> tuple[np.ndarray, float | None, bool] | None:
        net = self.net
        event = self.event[outer]
        lat, lon, elev = (net[k][outer] for k in ("lat", "lon", "elev"))
        distances = great_circles(lat, lon)
        s = correlations(lat, lon, elev, self.horizontal_scale(distances), self.p["vertical_scale"], distances)
        weight, own = np.zeros(len(outer)), np.zeros(len(outer))
        for kind in (event, ~event):
            inverse = invert(s[np.ix_(kind, kind)] + self.noise * np.eye(int(kind.sum())))
            if inverse is None:
                return None
            weight[kind] = inverse.sum(axis=1)
            own[kind] = 1 - weight[kind] / np.diag(inverse)
        own = np.where(own <= 0, self.floor, own)
        other = np.where(event, s @ np.where(event, 0, weight), s @ np.where(event, weight, 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            z = other * np.log(other / own)
        e, o, z = own[test], other[test], z[test]
        bad = ((e >= self.influence) | (o >= self.influence)) & (o > e) & (z > net["test_threshold"][outer[test]])
        if not bad.any():
            return test[:0], None, False
        k = int(np.where(bad, z, -np.inf).argmax())
        return test[k : k + 1], None, False


TESTS: dict[str, type[CircleTest]] = {"resistant": ResistantTest, "first_guess": FirstGuessTest, "dual": DualTest}


def start(n: int) -> State:
    return State(np.full(n, NOT_CHECKED), np.full(n, float(NOT_CHECKED)))
