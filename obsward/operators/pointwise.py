"""Checks that look at one row alone; they run on streaming DataFrames as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsward.functions.validity import Param, clean, is_valid, param, sure
from obsward.types import DEFAULT, Columns

# Climatology: latitudes and mean temperatures, latitudes and seasonal ranges, monthly weights (fixed values).
MEAN_LATS = [90, 60, 50, 45, 40, 30, 15, 0, -15, -30, -35, -40, -45, -60, -90]
MEAN_TEMPS = [-15, 5, 10, 15, 20, 25, 30, 30, 25, 21, 20, 15, 10, 0, -25]
SEASON_LATS = [90, 75, 60, 45, 30, 15, 0, -15, -30, -45, -60, -75, 90]
SEASON_RANGES = [40, 32, 30, 23, 13, 3, 0, 4, 7, 6, 11, 26, 31]
MONTH_WEIGHTS = [-1, -0.6, -0.3, 0, 0.3, 0.6, 1, 0.6, 0.3, 0, -0.3, -0.6]


def range_check(df: DataFrame, minimum: Param, maximum: Param, cols: Columns = DEFAULT) -> DataFrame:
    """Flag 1 for values that are invalid or outside [minimum, maximum]; bounds are scalars or columns."""
    v = clean(cols.value)
    return df.withColumn(cols.flag, F.when(v.isNull() | sure(v < param(minimum)) | sure(v > param(maximum)), 1).otherwise(0))


def _ladder(lat: Column, lats: list[float], values: list[float]) -> Column:
    """Linear between table rows; null where no bracket of latitudes is found."""
    out = F.lit(None).cast("double")
    for i in range(len(lats) - 1, 0, -1):
        a, b = lats[i - 1], lats[i]
        if b < a:
            out = F.when(lat > b, values[i - 1] + (lat - a) * ((values[i] - values[i - 1]) / (b - a))).otherwise(out)
    return F.when(lat <= lats[0], out)


def climatology(lat: Param, unixtime: Param, compat: str = "exact") -> Column:
    """Expected temperature for a latitude in the month of a time in seconds.

    compat "exact" keeps the table's last seasonal latitude at +90, so latitudes from -75 down have no seasonal range
    and no expectation outside April and October; "fixed" takes it as -90.
    """
    la = clean(lat)
    season_lats = SEASON_LATS if compat == "exact" else [*SEASON_LATS[:-1], -90.0001]
    mean_lats = MEAN_LATS if compat == "exact" else [*MEAN_LATS[:-1], -90.0001]
    month = F.month(F.date_from_unix_date(F.floor(param(unixtime) / 86400).cast("int")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in MONTH_WEIGHTS]), month)
    mean = _ladder(la, [float(x) for x in mean_lats], [float(x) for x in MEAN_TEMPS])
    season = _ladder(la, [float(x) for x in season_lats], [float(x) for x in SEASON_RANGES])
    return mean + F.when(weight == 0, 0.0).otherwise(season / 2 * weight)


def range_check_climatology(df: DataFrame, unixtime: Param, pos: Param, neg: Param, cols: Columns = DEFAULT, compat: str = "exact") -> DataFrame:
    """Flag 1 for values that are invalid or outside [climatology + neg, climatology + pos].  Without an expectation only invalid values are flagged."""
    v, t = clean(cols.value), climatology(cols.lat, unixtime, compat)
    return df.withColumn(cols.flag, F.when(v.isNull() | sure(v < t + param(neg)) | sure(v > t + param(pos)), 1).otherwise(0))


def metadata_check(df: DataFrame, check_lat: bool = True, check_lon: bool = True, check_elev: bool = True, check_laf: bool = True, cols: Columns = DEFAULT) -> DataFrame:
    """Flag 1 where one of the enabled fields is invalid; a column that df lacks counts as invalid."""
    bad = F.lit(False)
    for on, name in ((check_lat, cols.lat), (check_lon, cols.lon), (check_elev, cols.elev), (check_laf, cols.laf)):
        if on:
            bad = bad | (~is_valid(name) if name in df.columns else F.lit(True))
    return df.withColumn(cols.flag, F.when(bad, 1).otherwise(0))


def dem_check(df: DataFrame, dem: Param, max_elev_diff: float, cols: Columns = DEFAULT) -> DataFrame:
    """Flag 1 where elevation and terrain model differ by more; other flags stay."""
    flag = F.col(cols.flag) if cols.flag in df.columns else F.lit(0)
    return df.withColumn(cols.flag, F.when(sure(F.abs(clean(cols.elev) - clean(dem)) > max_elev_diff), 1).otherwise(flag))


def external_check(df: DataFrame, external: Param, cols: Columns = DEFAULT) -> DataFrame:
    """Flag 1 where an external flag is positive."""
    return df.withColumn(cols.flag, F.when(sure(param(external) > 0), 1).otherwise(0))


def count_flags(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Rows for each flag."""
    return df.groupBy(cols.flag).agg(F.count("*").alias("n"))
