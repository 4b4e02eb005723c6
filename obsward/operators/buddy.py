"""Buddy checks: a station against its neighbours of the previous round."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from obsward.functions.validity import Param, clean, is_scalar, is_valid, param, sure
from obsward.operators import regions
from obsward.operators.spatial_join import largest, located, numbers, placed, tiled
from obsward.stages import stored
from obsward.types import DEFAULT, Columns, CoordinateType


def _checked(df: DataFrame, radius: Param, num_min: Param, obs_to_check: Param | None, kind: CoordinateType | int | str, cols: Columns, elevated: bool, compat: str, once: bool) -> tuple[DataFrame, DataFrame]:
    """df with _good, whether a row begins unflagged; and the placed stations.

    Rows with invalid values begin flagged: under compat "exact" with a scalar num_min only the first row is looked at,
    else all are.
    """
    number = param(num_min)
    if is_scalar(num_min):
        if num_min <= 0:
            raise RuntimeError("num_min must be positive")
    elif df.where(number <= 0).limit(1).count():
        raise RuntimeError("num_min must be positive")
    good = is_valid(cols.value)
    if compat == "exact" and is_scalar(num_min):
        least = df.agg(F.min(cols.id))  # a subquery of the only job, unless later jobs build on its result
        good = good | sure(F.col(cols.id) != (least.scalar() if once else F.lit(least.first()[0])))
    df = df.withColumn("_good", good)
    value = param(cols.value).cast("double")
    return df, placed(df, kind, cols).select(
        cols.id, "x", "y", "z", "_good",
        F.when(~F.isnan(value), value).alias("raw"),
        (clean(cols.elev) if elevated else F.lit(None).cast("double")).alias("elev"),
        param(radius).cast("double").alias("radius"), number.alias("num_min"),
        (F.lit(True) if obs_to_check is None else sure(param(obs_to_check) == 1)).alias("wanted"),
    )


def _rounds(df: DataFrame, stations: DataFrame, radius: Param, max_elev_diff: float, num_iterations: int, cols: Columns, judge: Callable[[_Buddies], np.ndarray]) -> DataFrame:
    """The rounds that both checks share.

    judge: which stations of a tile are bad.  A round reads the flags of the one before it, so the order of the rows
    doesn't matter.  The rounds end early when no flag is added.
    """
    edge = float(radius) if is_scalar(radius) else largest(stations, F.col("radius"))
    points = stations.where("_good").select(cols.id, "x", "y", "z", "raw", "elev")
    queries = stations.where("_good AND wanted").select(cols.id, "x", "y", "z", "raw", "elev", "radius", F.col("num_min").cast("double").alias("num_min"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = a.column(cols.id)
        bad = judge(_Buddies(a, b, max_elev_diff)) if a.num_rows else np.zeros(0, bool)
        return pa.table({cols.id: ids.filter(pa.array(bad))})

    def judged(queries: DataFrame, points: DataFrame) -> DataFrame:
        return tiled(queries, points.drop(cols.id), edge, run, StructType([queries.schema[cols.id]]))

    gone = judged(queries, points)
    if num_iterations > 1:
        new = gone = stored(gone)
        for _ in range(1, num_iterations):
            if new.isEmpty():
                break
            queries, points = queries.join(new, cols.id, "left_anti"), points.join(new, cols.id, "left_anti")
            new = stored(judged(queries, points))
            gone = gone.unionByName(new)
    marked = df.drop(cols.flag).join(gone.withColumn("_now", F.lit(True)), cols.id, "left")
    return marked.withColumn(cols.flag, F.when(F.col("_good") & F.col("_now").isNull(), 0).otherwise(1)).drop("_good", "_now")


class _Buddies:
    """A tile's stations to judge and the points around them; with max_elev_diff > 0 those of both with an elevation."""

    def __init__(self, a: pa.Table, b: pa.Table, max_elev_diff: float):
        self.n, self.elevated, self.most = a.num_rows, max_elev_diff > 0, max_elev_diff
        at, points = located(a), located(b)
        raw, elev, radius, num_min = numbers(a, "raw", "elev", "radius", "num_min")
        other, height = numbers(b, "raw", "elev")
        on, off = np.arange(self.n), slice(None)
        if self.elevated:
            on, off = np.flatnonzero(~np.isnan(elev)), ~np.isnan(height)
        self.on, self.at, self.raw, self.elev, self.radius, self.num_min = on, at[on], raw[on], elev[on], radius[on], num_min[on]
        self.points, self.other, self.height = points[off], other[off], height[off]

    def sides(self, some: np.ndarray | slice = slice(None)) -> list[regions.Side]:
        if not self.elevated:
            return []
        elev = self.elev[some]
        return [regions.within(self.height, elev, self.most, regions.scale(self.radius, np.full(1, float(self.most))))]

    def tree(self, sums: np.ndarray) -> regions.Tree:
        return regions.Tree(self.points, sums, self.sides())

    def all(self, bad: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, bool)
        out[self.on] = bad
        return out


def buddy_check(df: DataFrame, radius: Param, num_min: Param, threshold: float, max_elev_diff: float, elev_gradient: float, min_std: float, num_iterations: int, obs_to_check: Param | None = None, kind: CoordinateType | int | str = CoordinateType.Geodetic, cols: Columns = DEFAULT, compat: str = "exact") -> DataFrame:
    """Flag 1 where a value lies more than threshold standard deviations off the mean of its unflagged neighbours.

    With max_elev_diff > 0 neighbours need a valid elevation within it and their values are carried to the station's by
    the gradient.  The deviation is that of the population, widened for the mean's own error, at least min_std.
    An invalid neighbour leaves its station unflagged.  radius, num_min: scalars or columns.
    """
    df, stations = _checked(df, radius, num_min, obs_to_check, kind, cols, max_elev_diff > 0, compat, num_iterations == 1)

    def judge(b: _Buddies) -> np.ndarray:
        """A station is decided as soon as bounds say so: of what a box on the edge may add, its whole sums bound the
        change of the mean and of the deviation (by Cauchy and Schwarz)."""
        carried = elev_gradient if b.elevated else 0.0
        v, w = b.raw - carried * b.elev if b.elevated else b.raw, b.other - carried * b.height if b.elevated else b.other
        fine = np.isfinite(w)
        centre = float(np.mean(w[fine])) if fine.any() else 0.0
        v, w = v - centre, np.where(fine, w - centre, 0.0)
        bad = np.zeros(len(v), bool)

        def settled(i: np.ndarray, sure: np.ndarray, more: np.ndarray) -> np.ndarray:
            n, c = sure[:, 0], more[:, 0]
            never = (sure[:, 1] > 0) | (n + c < b.num_min[i]) | (n + c == 0) | np.isnan(v[i])
            some = np.maximum(n, 1)
            mean = sure[:, 2] / some
            var = np.maximum(sure[:, 3] / some - mean * mean, 0.0)
            off = np.abs(v[i] - mean)
            sd = np.maximum(np.sqrt(var + var / some), min_std)
            exact = c == 0
            bad[i] = exact & ~never & (n >= b.num_min[i]) & (off > threshold * sd)
            if threshold >= 0:
                moved = np.maximum(more[:, 3] - 2 * mean * more[:, 2] + c * mean * mean, 0.0) * (1 + 1e-6)
                added = np.minimum(c, n)  # as many points as can move the mean farthest
                shift = np.sqrt(added * moved) / (some + added) + 1e-9 * (np.abs(mean) + np.sqrt(var))
                low, high = var * n / np.maximum(n + c, 1) * (1 - 1e-9), (var + moved / some) * (1 + 1e-9)
                least = np.maximum(np.sqrt(low + low / np.maximum(n + c, 1)), min_std)
                greatest = np.maximum(np.sqrt(high + high / some), min_std)
                never |= (n > 0) & ~exact & (off + shift < threshold * least)
                surely = (n > 0) & ~exact & ~never & (n >= b.num_min[i]) & (more[:, 1] == 0) & (off - shift > threshold * greatest)
                bad[i] |= surely
                exact |= surely
            return exact | never

        b.tree(np.column_stack([np.ones(len(w)), ~fine, w, w * w])).visit(b.at, b.radius, True, settled)
        return b.all(bad)

    return _rounds(df, stations, radius, max_elev_diff, num_iterations, cols, judge)


def buddy_event_check(df: DataFrame, radius: Param, num_min: Param, event_threshold: float, threshold: float, max_elev_diff: float, elev_gradient: float, num_iterations: int, obs_to_check: Param | None = None, kind: CoordinateType | int | str = CoordinateType.Geodetic, cols: Columns = DEFAULT, compat: str = "exact") -> DataFrame:
    """Flag 1 where few neighbours share a station's event, value < event_threshold, or its absence.

    threshold below 1: a fraction of the neighbours, else a number of them.  Invalid values are no events.
    """
    df, stations = _checked(df, radius, num_min, obs_to_check, kind, cols, max_elev_diff > 0, compat, num_iterations == 1)

    def judge(b: _Buddies) -> np.ndarray:
        carried = elev_gradient if b.elevated else 0.0
        if not carried:
            return b.all(_by_events(b, b.raw < event_threshold, b.other < event_threshold, threshold))
        bad = np.zeros(len(b.raw), bool)
        own = b.raw < event_threshold
        for event in (True, False):
            some = np.flatnonzero(own == event)
            if len(some):
                bad[some] = _by_carried_events(b, some, event, event_threshold, carried, threshold)
        return b.all(bad)

    return _rounds(df, stations, radius, max_elev_diff, num_iterations, cols, judge)


def _few(alike: np.ndarray, n: np.ndarray, own: np.ndarray, threshold: float) -> np.ndarray:
    """Few of n neighbours are like the station itself."""
    if threshold < 1:
        events = np.where(own, alike, n - alike)
        return np.where(own, events / np.maximum(n, 1) <= threshold, 1 - events / np.maximum(n, 1) <= threshold)
    return alike <= threshold


def _by_events(b: _Buddies, own: np.ndarray, event: np.ndarray, threshold: float) -> np.ndarray:
    """Bad stations where each neighbour is an event or none, whoever asks; decided as soon as bounds say so."""
    bad = np.zeros(len(own), bool)

    def settled(i: np.ndarray, sure: np.ndarray, more: np.ndarray) -> np.ndarray:
        n, c = sure[:, 0], more[:, 0]
        alike, may = (np.where(own[i], s[:, 1], s[:, 0] - s[:, 1]) for s in (sure, more))
        exact, enough = c == 0, n >= b.num_min[i]
        never = (n + c < b.num_min[i]) | (n + c == 0)
        low, high = alike, alike + may
        if threshold < 1:
            low, high = alike / np.maximum(n + c - may, 1), (alike + may) / np.maximum(n + may, 1)
        never |= low > threshold + 1e-9
        surely = ~exact & (n > 0) & enough & (high < threshold - 1e-9)
        bad[i] = ~never & (surely | exact & enough & _few(alike, n, own[i], threshold))
        return exact | never | surely

    b.tree(np.column_stack([np.ones(len(event)), event])).visit(b.at, b.radius, True, settled)
    return bad


def _by_carried_events(b: _Buddies, some: np.ndarray, event: bool, event_threshold: float, gradient: float, threshold: float) -> np.ndarray:
    """Bad ones of some stations, which all are events or all none, where neighbours' values are carried to the station's
    elevation: those like it are a range of the values carried to elevation 0."""
    at, radius, num_min, elev = b.at[some], b.radius[some], b.num_min[some], b.elev[some]
    whole = np.full(len(some), np.inf)
    raw = np.where(np.isnan(b.other), np.inf, b.other)
    value, limit = raw - gradient * b.height, event_threshold - gradient * elev
    room = 1e-9 * (np.max(np.abs(value[np.isfinite(value)]), initial=0.0) + np.max(np.abs(limit), initial=0.0))
    low, high = (-whole, limit + room) if event else (limit - room, whole)

    def alike(p: np.ndarray, i: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
        return (sides[2] + (elev[i, None] - sides[0]) * gradient < event_threshold) == event

    spread = value[np.isfinite(value)]
    wide = float(np.std(spread)) * 4 if len(spread) else 0.0
    sides = b.sides(some)
    of_kind = regions.Side(value, low, high, alike, regions.scale(radius, np.full(1, wide)), room)
    carried_along = regions.Side(raw, -whole, whole, lambda p, i, sides: True, 0.0)
    number = threshold >= 1
    n = regions.counts(at, b.points, radius, True, num_min if number else None, sides)
    like = regions.counts(at, b.points, radius, True, np.full(len(some), np.floor(threshold) + 1) if number else None, [*sides, of_kind, carried_along])
    return (n > 0) & (n >= num_min) & _few(like, n, np.full(len(some), event), threshold)
