"""Isolation check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from obsward.functions.validity import Param, clean, is_scalar, is_valid, param, sure
from obsward.operators import regions
from obsward.operators.spatial_join import largest, located, numbers, placed, tiled
from obsward.types import DEFAULT, Columns, CoordinateType


def neighbour_counts(df: DataFrame, radius: Param, vertical_radius: Param | None = None, kind: CoordinateType | int | str = CoordinateType.Geodetic, cols: Columns = DEFAULT, enough: Param | None = None) -> DataFrame:
    """station_id, n: stations at other places within the radius, and within the vertical one if there is one.

    Stations without any may be left out.  enough: a number from which on n needn't be all of them; below it n may be
    less, but on the same side of it.
    """
    vertical = param(vertical_radius) if vertical_radius is not None else F.lit(None).cast("double")
    elev = clean(cols.elev) if vertical_radius is not None else F.lit(None).cast("double")
    most = param(enough).cast("double") if enough is not None else F.lit(float("nan"))
    rows = placed(df, kind, cols).select(cols.id, "x", "y", "z", elev.alias("_elev"), clean(param(radius)).alias("_radius"), clean(vertical).alias("_vertical"), most.alias("_most"))

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        at, points = located(a), located(b)
        reach, height, z, most = numbers(a, "_radius", "_vertical", "_elev", "_most")
        (other,) = numbers(b, "_elev")
        n, level = np.zeros(len(at)), np.isnan(height)
        n[level] = regions.counts(at[level], points, reach[level], True, most[level]) if level.any() else 0
        tall = ~level & ~np.isnan(z)
        if tall.any():
            on = ~np.isnan(other)
            scale = regions.scale(reach[tall], height[tall])
            n[tall] = regions.counts(at[tall], points[on], reach[tall], True, most[tall], [regions.within(other[on], z[tall], height[tall], scale)])
        return pa.table({cols.id: a.column(cols.id), "n": pa.array(n.astype(np.int64))})

    schema = StructType([rows.schema[cols.id], StructField("n", LongType())])
    found = tiled(rows, rows.select("x", "y", "z", "_elev"), largest(rows, F.col("_radius")) if not is_scalar(radius) else float(radius), count, schema)
    return found.groupBy(cols.id).agg(F.sum("n").alias("n"))


def isolation_check(df: DataFrame, num_min: Param, radius: Param, vertical_radius: Param | None = None, kind: CoordinateType | int | str = CoordinateType.Geodetic, cols: Columns = DEFAULT) -> DataFrame:
    """Flag 1 for stations with fewer than num_min neighbours, without a valid place, or, where a vertical radius is
    valid, without a valid elevation.  Parameters are scalars or columns."""
    counts = neighbour_counts(df, radius, vertical_radius, kind, cols, num_min).withColumnRenamed("n", "_n")
    bad = ~is_valid(cols.lat) | ~is_valid(cols.lon) | sure(F.coalesce("_n", F.lit(0)) < param(num_min))
    if vertical_radius is not None:
        bad = bad | (is_valid(vertical_radius) & ~is_valid(cols.elev))
    return df.join(counts, cols.id, "left").withColumn(cols.flag, F.when(bad, 1).otherwise(0)).drop("_n")
