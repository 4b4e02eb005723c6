"""Spatial joins by cells: each query looks at the cells of a cubic grid that its radius reaches, an equi-join.

What only sums or counts the neighbours doesn't pair them: queries and points are dealt to tiles (`tiled`), where a tree
answers them (operators.regions).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from obsward.functions.geo import chord, xyz
from obsward.functions.validity import Param, is_scalar, is_valid, param
from obsward.operators import regions
from obsward.stages import cut
from obsward.types import DEFAULT, Columns, CoordinateType

#: Least edge in metres of the cells that components are found on.
LEAST_EDGE = 1.0
#: Room around a radius, in the unit of the coordinates (metres or degrees), so that one of 0 has cells too.
ROOM = 1e-6
#: Points that a tile is made for, where its edge isn't given by the radius.
TILE = 50_000
#: Estimated bytes of queries up to which they are dealt over the cores before they are joined.
SMALL = 256 << 20
#: Estimated bytes of points up to which they are broadcast.
SENT = 16 << 20


def placed(df: DataFrame, kind: CoordinateType | int | str = CoordinateType.Geodetic, cols: Columns = DEFAULT) -> DataFrame:
    """df with x, y, z, without rows that have no valid place."""
    x, y, z = xyz(cols.lat, cols.lon, kind)
    return df.where(is_valid(cols.lat) & is_valid(cols.lon)).withColumns({"x": x, "y": y, "z": z})


def _cell(edge: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(edge)) for c in "xyz"]


def _key(x: Column, y: Column, z: Column) -> Column:
    return F.xxhash64(x, y, z)


def largest(df: DataFrame, radius: Param) -> float:
    """The greatest radius: the scalar itself, or one aggregate."""
    if is_scalar(radius):
        return float(radius)
    return float(df.agg(F.max(param(radius))).first()[0] or 0.0)


def _estimated(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def near(queries: DataFrame, points: DataFrame, radius: float, condition: Column, by: str) -> DataFrame:
    """Inner join of placed queries (alias q) and points (alias p) under a condition that no pair further apart meets.

    Cells have twice the radius as edge, so a query looks at one or two of them along each axis, three and a half on
    average; a point has one, so no pair comes twice.  Dense cells are left to adaptive skew joins.

    Few queries are dealt by `by` first: a scan may be one split, whose pairs one core would make alone.  Few points are
    broadcast, so that the queries stay dealt like that, and an aggregate by that column shuffles nothing.  Both look at
    the estimated size, and only change the plan.
    """
    reach = radius * (1 + 1e-9) + ROOM
    edge = F.lit(2 * reach)
    if _estimated(queries) <= SMALL:
        queries = queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    for c in "xyz":
        queries = queries.withColumn(f"_{c}", F.explode(F.sequence(F.floor((F.col(c) - reach) / edge), F.floor((F.col(c) + reach) / edge))))
    q = queries.withColumn("_cell", _key(F.col("_x"), F.col("_y"), F.col("_z"))).drop("_x", "_y", "_z").alias("q")
    p = points.withColumn("_cell", _key(*[F.floor(F.col(c) / edge) for c in "xyz"]))
    p = (F.broadcast(p) if _estimated(points) <= SENT else p).alias("p")
    return q.join(p, (F.col("q._cell") == F.col("p._cell")) & condition)


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as doubles, null as NaN."""
    return [table.column(n).cast(pa.float64()).to_numpy() if table.num_rows else np.zeros(0) for n in names]


def located(table: pa.Table) -> np.ndarray:
    return np.column_stack(numbers(table, "x", "y", "z"))


def tiled(queries: DataFrame, points: DataFrame, radius: float, run: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType | str, bounds: bool = False) -> DataFrame:
    """run(queries, points) for each tile that holds queries, with all points in the reach of these.

    queries, points: placed.  A tile's edge is at least twice the radius, so a point goes to three and a half tiles on
    average, eight at most; where the points lie less densely, edges grow to hold about TILE points.  A task holds
    one tile, so its memory grows with the points in a square of four times the radius and not with their pairs.
    bounds: the queries carry the tile's edge and its numbers along x, y, z.
    """
    reach = radius * (1 + 1e-9) + ROOM
    spark = points.sparkSession
    size = points.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    sides = sorted((size[c] or 0.0) for c in "xyz")
    wanted = min(TILE, max(1000, size["n"] // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    edge = F.lit(max(2 * reach, (sides[2] * max(sides[1], sides[2] / 1000) * wanted / max(size["n"], 1)) ** 0.5))
    tile = ["_tx", "_ty", "_tz"]
    q = queries.withColumns({t: F.floor(F.col(c) / edge) for t, c in zip(tile, "xyz", strict=True)})
    if bounds:
        q = q.withColumn("_edge", edge)
    points = points.select(*[F.col(c).alias(c) for c in points.columns])  # columns of its own: queries may be the same rows
    for t, c in zip(tile, "xyz", strict=True):
        points = points.withColumn(t, F.explode(F.sequence(F.floor((F.col(c) - reach) / edge), F.floor((F.col(c) + reach) / edge))))
    return q.groupBy(*tile).cogroup(points.groupBy(*tile)).applyInArrow(run, schema)


def within(radius: Column) -> Column:
    return chord("q", "p") <= radius


def elsewhere() -> Column:
    """Not at one place: co-located stations are no neighbours of each other."""
    return reduce(lambda a, b: a | b, [F.col(f"q.{c}") != F.col(f"p.{c}") for c in "xyz"])


def neighbours(queries: DataFrame, points: DataFrame, radius: Param, include_match: bool = True, kind: CoordinateType | int | str = CoordinateType.Geodetic, cols: Columns = DEFAULT, query_id: str = "query_id") -> DataFrame:
    """query_id, station_id, dist of all points within a radius (inclusive) of the queries.

    queries: query_id, lat, lon and whatever `radius` names.  include_match=False leaves out points at the very place of
    the query.
    """
    qcols = Columns(id=query_id, lat=cols.lat, lon=cols.lon)
    q = placed(queries, kind, qcols).withColumn("_radius", param(radius))
    condition = within(F.col("q._radius"))
    if not include_match:
        condition = condition & elsewhere()
    found = near(q.select(query_id, "x", "y", "z", "_radius"), placed(points, kind, cols).select(cols.id, "x", "y", "z"), largest(queries, radius), condition, query_id)
    return found.select(F.col(f"q.{query_id}").alias(query_id), F.col(f"p.{cols.id}").alias(cols.id), chord("q", "p").alias("dist"))


def num_neighbours(queries: DataFrame, points: DataFrame, radius: Param, include_match: bool = True, kind: CoordinateType | int | str = CoordinateType.Geodetic, cols: Columns = DEFAULT, query_id: str = "query_id") -> DataFrame:
    """queries with n, the number of their neighbours."""
    q = placed(queries, kind, Columns(id=query_id, lat=cols.lat, lon=cols.lon)).select(query_id, "x", "y", "z", param(radius).cast("double").alias("_radius"))
    p = placed(points, kind, cols).select("x", "y", "z")

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        n = regions.counts(located(a), located(b), *numbers(a, "_radius"), not include_match)
        return pa.table({query_id: a.column(query_id), "n": pa.array(n.astype(np.int64))})

    schema = StructType([q.schema[query_id], StructField("n", LongType())])
    found = tiled(q, p, largest(queries, radius), count, schema).groupBy(query_id).agg(F.sum("n").alias("n"))
    return queries.join(found, query_id, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def closest_neighbours(queries: DataFrame, points: DataFrame, num: int, include_match: bool = True, kind: CoordinateType | int | str = CoordinateType.Geodetic, cols: Columns = DEFAULT, query_id: str = "query_id", start: float | None = None) -> DataFrame:
    """query_id, rank, station_id, dist of the num nearest points of each query, ties by station id.

    Rings grow: queries with num points within the radius are done, the others look four times as far, until the radius
    spans everything.  `start` is the first radius; by default a guess from the density of the points.
    """
    q = placed(queries, kind, Columns(id=query_id, lat=cols.lat, lon=cols.lon)).select(query_id, "x", "y", "z")
    p = cut(placed(points, kind, cols).select(cols.id, "x", "y", "z"))
    size = p.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    if not size["n"]:
        return q.select(query_id, F.lit(0).alias("rank"), F.lit(0).cast("long").alias(cols.id), F.lit(0.0).alias("dist")).where("false")
    ends = q.select("x", "y", "z").union(p.select("x", "y", "z")).agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    whole = max(1.0, sum((ends[c] or 0.0) ** 2 for c in "xyz") ** 0.5)
    radius = start or max(size[c] for c in "xyz") * (2 * num / size["n"]) ** 0.5 or whole
    different = F.lit(True) if include_match else elsewhere()
    order = Window.partitionBy(query_id).orderBy("dist", cols.id)
    done: list[DataFrame] = []
    while True:
        last = radius >= whole
        found = near(q, p, radius, within(F.lit(radius)) & different, query_id).select(F.col(f"q.{query_id}").alias(query_id), F.col(f"p.{cols.id}").alias(cols.id), chord("q", "p").alias("dist"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= num).select(query_id, "rank", cols.id, "dist")
        if last:
            return reduce(DataFrame.unionByName, [*done, ranked])
        ranked = cut(ranked)
        full = ranked.where(F.col("rank") == num).select(query_id)
        done.append(ranked.join(full, query_id, "left_semi"))
        q = cut(q.join(full, query_id, "left_anti"))
        if q.isEmpty():
            return reduce(DataFrame.unionByName, done)
        radius *= 4


def nearest_neighbour(queries: DataFrame, points: DataFrame, include_match: bool = True, kind: CoordinateType | int | str = CoordinateType.Geodetic, cols: Columns = DEFAULT, query_id: str = "query_id") -> DataFrame:
    """queries with the id of the nearest point; -1 where there is none."""
    found = closest_neighbours(queries, points, 1, include_match, kind, cols, query_id).select(query_id, cols.id)
    return queries.join(found, query_id, "left").withColumn(cols.id, F.coalesce(cols.id, F.lit(-1)))


def interpolate_to_points(grid: DataFrame, points: DataFrame, cols: Columns = DEFAULT, grid_id: tuple[str, str] = ("gy", "gx")) -> DataFrame:
    """points with the value of the nearest grid point (columns gy, gx, lat, lon, value); of equally near ones the first in row order."""
    numbered = grid.select(F.struct(*grid_id).alias("_cell_id"), cols.lat, cols.lon, F.col(cols.value).alias("_value"))
    found = closest_neighbours(points, numbered, 1, cols=Columns(id="_cell_id", lat=cols.lat, lon=cols.lon), query_id=cols.id)
    values = found.join(numbered.select("_cell_id", "_value"), "_cell_id").select(cols.id, F.col("_value").alias(cols.value))
    return points.drop(cols.value).join(values, cols.id, "left")


def components(df: DataFrame, radius: float, cols: Columns = DEFAULT) -> DataFrame:
    """station_id, component: stations within the radius of each other, directly or in steps, share one.

    Found on occupied cells instead of stations: adjacent cells are linked, so a component may hold more than one
    network but never half of one.  Labels take the least among neighbours and follow labels until nothing changes.
    """
    edge = max(radius, LEAST_EDGE)
    located = placed(df, cols=cols).select(cols.id, *[c.alias(f"c{k}") for k, c in zip("xyz", _cell(edge), strict=True)])
    here = _key(F.col("cx"), F.col("cy"), F.col("cz"))
    stations = located.withColumn("cell", here)
    cells = cut(stations.select("cell", "cx", "cy", "cz").distinct())
    around = F.array(*[_key(F.col("cx") + a, F.col("cy") + b, F.col("cz") + c) for a, b, c in product((-1, 0, 1), repeat=3)])
    links = cut(cells.select("cell", F.explode(around).alias("other")).join(cells.select(F.col("cell").alias("other")), "other"))
    labels = cut(links.groupBy("cell").agg(F.min("other").alias("component")))
    while True:
        seen = links.join(labels.withColumnRenamed("cell", "other"), "other").groupBy("cell").agg(F.min("component").alias("component"))
        above = seen.select(F.col("cell").alias("component"), F.col("component").alias("above"))
        new = cut(seen.join(above, "component").select("cell", F.col("above").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "cell").where("component <> old").limit(1).count()
        labels = new
        if not changed:
            return stations.join(labels, "cell").select(cols.id, "component")
