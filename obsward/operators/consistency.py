"""Spatial consistency and first-guess tests on DataFrames.

Results depend on the order of station ids, so a network that could influence itself stays together: stations are
grouped into components under the outer radius, which exchange nothing.  The spatial consistency test runs each
component to its own end.  The tests in circles share one thing, whether any station of any component was flagged in a
round; so their first pass runs in rounds over all components, with the sum taken in between.

Of many stations a component may be all.  They are dealt to tiles instead, each with the stations around it, and a tile
keeps track of what it can't know (operators.kernels); where that reaches its own stations, all is done again with tiles
that see twice as far, at last everything.  So results are those of one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsward.functions.validity import Param, clean, param, sure
from obsward.operators import kernels
from obsward.operators.spatial_join import components, placed, tiled
from obsward.stages import cut, stored
from obsward.types import BAD, DEFAULT, GOOD, NOT_CHECKED, BackgroundType, Columns, ConditionType, member

_SCHEMA = "station_id bigint, flag int, score double"
#: Stations up to which components are run, each in one task.
SERIAL = 20_000
#: How far a tile sees first, for each neighbour of a circle, in typical distances to the last of them: in a scan of
#: random order the longest chain of stations that see each other has about e steps for each neighbour.
STEPS = 3


def _network(df: DataFrame, radius: float, columns: dict[str, Column], obs_to_check: Param | None, cols: Columns) -> DataFrame:
    """station_id, component, x, y, z, lat, lon and the given columns; rows without a valid place are left out."""
    wanted = F.lit(True) if obs_to_check is None else sure(param(obs_to_check) == 1)
    stations = placed(df, cols=cols).select(F.col(cols.id).cast("long").alias("station_id"), "x", "y", "z", param(cols.lat).cast("double").alias("lat"), param(cols.lon).cast("double").alias("lon"), wanted.alias("wanted"), *[c.cast("double").alias(k) for k, c in columns.items()])
    stations = cut(stations)
    if stations.count() > SERIAL:
        return stations
    labels = components(stations, radius, Columns(id="station_id"))
    return cut(stations.join(labels, "station_id"))


def _run(net: DataFrame, run: Callable[..., tuple[np.ndarray, np.ndarray]], radius: float, most: int) -> DataFrame:
    """station_id, flag, score by run(network, unknown, margin), over components or tiles."""
    if "component" in net.columns:
        return net.groupBy("component").applyInPandas(_per_component(lambda n: run(n, None, None)), _SCHEMA)
    size = net.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    sides = sorted(size[c] for c in "xyz")
    halo = (STEPS * most + 1) * min(radius, (sides[1] * sides[2] * most / (np.pi * size["n"])) ** 0.5) + 1.0
    while True:
        whole = halo > 2 * sides[2]
        done = stored(tiled(net.select("station_id", "x", "y", "z"), net.withColumnRenamed("station_id", "other"), halo, _in_tile(run, halo, whole), _SCHEMA + ", known boolean", bounds=True))
        if whole or done.where("NOT known").isEmpty():
            return done.drop("known")
        halo *= 2


def _in_tile(run: Callable[..., tuple[np.ndarray, np.ndarray]], halo: float, whole: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def apply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({"station_id": pa.array([], pa.int64()), "flag": pa.array([], pa.int32()), "score": pa.array([], pa.float64()), "known": pa.array([], pa.bool_())})
        b = b.sort_by("other")
        net = {c: b.column(c).to_numpy().copy() for c in b.column_names if not c.startswith("_t")}
        edge = a.column("_edge")[0].as_py()
        margin = np.full(b.num_rows, np.inf)
        for t, c in zip(("_tx", "_ty", "_tz"), "xyz", strict=True):
            low = a.column(t)[0].as_py() * edge
            margin = np.minimum(margin, np.minimum(net[c] - (low - halo), low + edge + halo - net[c]))
        unknown = np.zeros(b.num_rows, bool)
        flags, score = run(net, unknown, None if whole else margin)
        at = np.searchsorted(net["other"], a.column("station_id").to_numpy())
        return pa.table({"station_id": a.column("station_id"), "flag": pa.array(flags[at].astype(np.int32)), "score": pa.array(score[at]), "known": pa.array(~unknown[at])})

    return apply


def _arrays(pdf: pd.DataFrame) -> kernels.Network:
    return {c: pdf[c].to_numpy() for c in pdf.columns}


def _per_component(run: Callable[[kernels.Network], tuple[np.ndarray, np.ndarray]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("station_id", kind="stable").reset_index(drop=True)
        flags, score = run(_arrays(pdf))
        return pd.DataFrame({"station_id": pdf["station_id"], "flag": flags.astype("int32"), "score": score})

    return apply


def _with_flags(df: DataFrame, found: DataFrame, otherwise: int, score: str, cols: Columns) -> DataFrame:
    """df with its flag and score; stations without a valid place have the flag `otherwise`."""
    named = found.select(F.col("station_id").alias(cols.id), F.col("flag").alias("_flag"), F.col("score").alias("_score"))
    out = df.drop(cols.flag, score).join(named, cols.id, "left")
    return out.withColumns({cols.flag: F.coalesce("_flag", F.lit(otherwise)), score: F.coalesce("_score", F.lit(0.0))}).drop("_flag", "_score")


def _positive(**values: float) -> None:
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be positive")


def sct(df: DataFrame, num_min: int, num_max: int, inner_radius: float, outer_radius: float, num_iterations: int, num_min_prof: int, min_elev_diff: float, min_horizontal_scale: float, vertical_scale: float, pos: Param, neg: Param, eps2: Param, obs_to_check: Param | None = None, cols: Columns = DEFAULT) -> DataFrame:
    """Spatial consistency test by optimal interpolation: flag, prob_gross_error and rep (always 0).

    Around each station not yet checked a box of the closest unflagged stations is interpolated; those of its inner
    circle whose gross-error score passes pos (value above the analysis without it) or neg are flagged, and the rounds
    go on until none is.  Stations without a valid elevation or place are flagged.  A box must hold valid values.
    """
    if num_min < 0 or num_max < num_min:
        raise ValueError("num_min must not be negative nor above num_max")
    if num_iterations < 1 or inner_radius < 0 or outer_radius < inner_radius or min_elev_diff <= 0:
        raise ValueError("iterations must be positive, radii must not be negative nor the inner above the outer one, min_elev_diff must be positive")
    _positive(min_horizontal_scale=min_horizontal_scale, vertical_scale=vertical_scale)
    for name, value, least in (("pos", pos, 0.0), ("neg", neg, 0.0), ("eps2", eps2, 0.0)):
        if isinstance(value, (int, float)) and (value < least or name == "eps2" and value == 0):
            raise ValueError(f"{name} must be positive")
    p = {"num_min": num_min, "num_max": num_max, "inner_radius": inner_radius, "outer_radius": outer_radius, "num_iterations": num_iterations, "num_min_prof": num_min_prof, "min_elev_diff": min_elev_diff, "min_horizontal_scale": min_horizontal_scale, "vertical_scale": vertical_scale}
    columns = {"elev": clean(cols.elev), "value": clean(cols.value), "pos": param(pos), "neg": param(neg), "eps2": param(eps2)}
    net = _network(df, outer_radius, columns, obs_to_check, cols)
    found = _run(net, lambda n, unknown, margin: kernels.sct(n, p, unknown, margin), outer_radius, num_max)
    return _with_flags(df, found, BAD, "prob_gross_error", cols).withColumn("rep", F.lit(0.0))


def _circle_test(test: str, df: DataFrame, p: dict[str, Any], columns: dict[str, Column], obs_to_check: Param | None, cols: Columns) -> DataFrame:
    net = _network(df, p["outer_radius"], columns, obs_to_check, cols)
    state = cut(net.select("station_id", F.lit(NOT_CHECKED).alias("flag"), F.lit(float(NOT_CHECKED)).alias("score")))

    def step(last: bool, iteration: int) -> DataFrame:
        def run(n: kernels.Network, unknown: np.ndarray | None, margin: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            held = kernels.State(n["flag"].copy(), n["score"].copy())
            kernel = kernels.TESTS[test](n, p, unknown, margin)
            if last:
                kernel.last_passes(held)
            else:
                kernel.first_pass(held, iteration)
            return held.flags, held.score

        return _run(net.join(state, "station_id"), run, p["outer_radius"], p["num_max_outer"])

    for iteration in range(p["num_iterations"]):
        before = state.select("station_id", F.col("flag").alias("old"))
        state = cut(step(False, iteration))
        # a flag that turned bad in this round; bad ones never turn back in the first pass
        if not state.join(before, "station_id").where(f"flag = {BAD} AND old <> {BAD}").limit(1).count():
            if iteration == 0:
                wanted = net.select("station_id", "wanted")
                state = cut(state.join(wanted, "station_id").select("station_id", F.when(F.col("wanted") & (F.col("flag") == NOT_CHECKED), GOOD).otherwise(F.col("flag")).alias("flag"), "score"))
            break
    found = step(True, 0)
    out = _with_flags(df, found, NOT_CHECKED, "score", cols)
    return out


def _circle_parameters(num_min_outer: int, num_max_outer: int, inner_radius: float, outer_radius: float, num_iterations: int, accept_isolated: bool) -> dict[str, Any]:
    if num_min_outer <= 1 or num_max_outer < num_min_outer:
        raise ValueError("num_min_outer must be above 1 and not above num_max_outer")
    if inner_radius < 0 or outer_radius < inner_radius or num_iterations < 1:
        raise ValueError("radii must not be negative nor the inner above the outer one, iterations must be positive")
    return {"num_min_outer": num_min_outer, "num_max_outer": num_max_outer, "inner_radius": inner_radius, "outer_radius": outer_radius, "num_iterations": num_iterations, "accept_isolated": accept_isolated}


def _scales(kth_closest: int, min_horizontal_scale: float, max_horizontal_scale: float, vertical_scale: float) -> dict[str, Any]:
    _positive(kth_closest=kth_closest, min_horizontal_scale=min_horizontal_scale, vertical_scale=vertical_scale)
    if max_horizontal_scale < min_horizontal_scale:
        raise ValueError("max_horizontal_scale must not be below min_horizontal_scale")
    return {"kth_closest": kth_closest, "min_horizontal_scale": min_horizontal_scale, "max_horizontal_scale": max_horizontal_scale, "vertical_scale": vertical_scale}


def _backgrounds(df: DataFrame, kind: BackgroundType | int | str, num_min_prof: int, min_elev_diff: float, mina: Param, maxa: Param, values: Param | None) -> tuple[dict[str, Any], dict[str, Column]]:
    """The plausible range is that of the admissible ranges of all stations: one aggregate."""
    kind = member(BackgroundType, kind)
    if kind == BackgroundType.External and values is None:
        raise ValueError("an external background needs its values")
    ends = df.agg(F.min(param(mina)).alias("a"), F.max(param(maxa)).alias("b")).first()
    p = {"background_type": int(kind), "num_min_prof": num_min_prof, "min_elev_diff": min_elev_diff, "lowest": float(ends["a"] if ends["a"] is not None else np.nan), "highest": float(ends["b"] if ends["b"] is not None else np.nan)}
    return p, {"background": param(values)} if values is not None else {}


def sct_resistant(df: DataFrame, num_min_outer: int, num_max_outer: int, inner_radius: float, outer_radius: float, num_iterations: int, num_min_prof: int, min_elev_diff: float, min_horizontal_scale: float, max_horizontal_scale: float, kth_closest: int, vertical_scale: float, mina: Param, maxa: Param, minv: Param, maxv: Param, eps2: Param, tpos: Param, tneg: Param, basic: bool = False, background_type: BackgroundType | int | str = BackgroundType.VerticalProfile, background_values: Param | None = None, obs_to_check: Param | None = None, accept_isolated: bool = False, cols: Columns = DEFAULT) -> DataFrame:
    """Outlier-resistant spatial consistency test: flag (0, 1, 11, 12, 100, -999) and score.

    mina, maxa: admissible values; minv, maxv: values that count as good; eps2: noise against background; tpos, tneg:
    thresholds.  All scalars or columns.  accept_isolated: stations with too few neighbours are good.
    """
    p = _circle_parameters(num_min_outer, num_max_outer, inner_radius, outer_radius, num_iterations, accept_isolated) | _scales(kth_closest, min_horizontal_scale, max_horizontal_scale, vertical_scale) | {"basic": basic}
    more, extra = _backgrounds(df, background_type, num_min_prof, min_elev_diff, mina, maxa, background_values)
    names = {"mina": mina, "maxa": maxa, "minv": minv, "maxv": maxv, "eps2": eps2, "tpos": tpos, "tneg": tneg}
    columns = {"elev": param(cols.elev), "value": param(cols.value)} | {k: param(v) for k, v in names.items()} | extra
    return _circle_test("resistant", df, p | more, columns, obs_to_check, cols)


def fgt(df: DataFrame, num_min_outer: int, num_max_outer: int, inner_radius: float, outer_radius: float, num_iterations: int, num_min_prof: int, min_elev_diff: float, mina: Param, maxa: Param, minv: Param, maxv: Param, tpos: Param, tneg: Param, basic: bool = False, background_type: BackgroundType | int | str = BackgroundType.VerticalProfile, background_values: Param | None = None, background_uncertainties: Param = 1.0, obs_to_check: Param | None = None, cols: Columns = DEFAULT) -> DataFrame:
    """First-guess test: as the resistant test, with deviations from the background in place of an interpolation."""
    p = _circle_parameters(num_min_outer, num_max_outer, inner_radius, outer_radius, num_iterations, False) | {"basic": basic}
    more, extra = _backgrounds(df, background_type, num_min_prof, min_elev_diff, mina, maxa, background_values)
    names = {"mina": mina, "maxa": maxa, "minv": minv, "maxv": maxv, "tpos": tpos, "tneg": tneg, "uncertainty": background_uncertainties}
    columns = {"elev": param(cols.elev), "value": param(cols.value)} | {k: param(v) for k, v in names.items()} | extra
    return _circle_test("first_guess", df, p | more, columns, obs_to_check, cols)


def sct_dual(df: DataFrame, event_thresholds: Param, condition: ConditionType | int | str, num_min_outer: int, num_max_outer: int, inner_radius: float, outer_radius: float, num_iterations: int, min_horizontal_scale: float, max_horizontal_scale: float, kth_closest: int, vertical_scale: float, test_thresholds: Param, obs_to_check: Param | None = None, accept_isolated: bool = False, cols: Columns = DEFAULT) -> DataFrame:
    """Spatial consistency test of yes/no events: flag."""
    p = _circle_parameters(num_min_outer, num_max_outer, inner_radius, outer_radius, num_iterations, accept_isolated) | _scales(kth_closest, min_horizontal_scale, max_horizontal_scale, vertical_scale) | {"condition": int(member(ConditionType, condition))}
    columns = {"elev": param(cols.elev), "value": param(cols.value), "event_threshold": param(event_thresholds), "test_threshold": param(test_thresholds)}
    return _circle_test("dual", df, p, columns, obs_to_check, cols).drop("score")
