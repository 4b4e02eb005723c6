"""Registered queries over the driver's tables, and the SQL that states the same results.

Stations are made from customers, a second network from suppliers, series from events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsward.functions import calc_distance, calc_distance_fast, compute_quantile, convert_coordinates, find_k_closest
from obsward.operators import buddy, consistency, duplicate, isolation, pointwise, spatial_join, timeseries
from obsward.operators.background_frame import theil_sen, vertical_profiles
from obsward.plans import consistency_sql
from obsward.plans.pipeline import QCPipeline
from obsward.types import Columns

STATIONS = """
  SELECT c_custkey AS station_id,
    55 + ((c_custkey * 7919) % 5003) / CAST(1000.6 AS DOUBLE) AS lat,
    5 + ((c_custkey * 104729) % 4999) / CAST(999.8 AS DOUBLE) AS lon,
    CAST((c_custkey * 31) % 2500 AS DOUBLE) AS elev,
    CAST((c_custkey * 13) % 11 AS DOUBLE) / 10 AS laf,
    30 - CAST(0.0065 AS DOUBLE) * ((c_custkey * 31) % 2500) + c_acctbal / 1000 + CASE WHEN c_custkey % 37 = 0 THEN CAST(40 AS DOUBLE) ELSE 0 END AS value
  FROM customer"""
RADIUS = 30_000.0
PARTS = "cos(radians(lat)) * cos(radians(lon)) * 6378137e0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6378137e0 AS y, sin(radians(lat)) * 6378137e0 AS z"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STATIONS.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second network: suppliers as query points."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("query_id"), F.expr("55 + ((s_suppkey * 6007) % 4801) / CAST(1000.6 AS DOUBLE)").alias("lat"), F.expr("5 + ((s_suppkey * 90001) % 4703) / CAST(999.8 AS DOUBLE)").alias("lon"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value").select("user_id", "us", (F.col("us") / 1e6).alias("t"), "value")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buddy.buddy_check(stations(spark, sf_dir), 100_000.0, 5, 3, 0, 0, 1, 2).select("station_id", "flag")


def _flags(df: DataFrame) -> DataFrame:
    return df.select("station_id", F.col("flag").cast("int").alias("flag"))


def range_check(spark: SparkSession, d: str) -> DataFrame:
    return _flags(pointwise.range_check(stations(spark, d), 10, 50))


def climatology_check(spark: SparkSession, d: str) -> DataFrame:
    return _flags(pointwise.range_check_climatology(stations(spark, d), F.expr("station_id * 86400 * 11"), 25, -15))


def metadata_check(spark: SparkSession, d: str) -> DataFrame:
    df = stations(spark, d).withColumn("laf", F.when(F.col("station_id") % 5 > 0, F.col("laf")))
    return _flags(pointwise.metadata_check(df))


def dem_check(spark: SparkSession, d: str) -> DataFrame:
    return _flags(pointwise.dem_check(stations(spark, d), F.expr("CAST(station_id * 31 % 2400 AS DOUBLE)"), 50))


def external_check(spark: SparkSession, d: str) -> DataFrame:
    return _flags(QCPipeline(stations(spark, d)).external_check(F.expr("station_id % 7 - 5")).df)


def isolation_check(spark: SparkSession, d: str) -> DataFrame:
    return _flags(isolation.isolation_check(stations(spark, d), 2, 10_000.0))


def isolation_check_vertical(spark: SparkSession, d: str) -> DataFrame:
    df = stations(spark, d).withColumns({"r": F.expr("CAST(8000 + station_id % 5 * 1000 AS DOUBLE)"), "v": F.expr("CAST(500 + station_id % 3 * 200 AS DOUBLE)")})
    return _flags(isolation.isolation_check(df, 2, "r", "v"))


def duplicate_check(spark: SparkSession, d: str) -> DataFrame:
    return _flags(duplicate.duplicate_check(stations(spark, d), 8_000.0))


def buddy_check(spark: SparkSession, d: str) -> DataFrame:
    return _flags(buddy.buddy_check(stations(spark, d), RADIUS, 5, 3, 0, 0, 1, 1))


def buddy_check_elevation(spark: SparkSession, d: str) -> DataFrame:
    return _flags(buddy.buddy_check(stations(spark, d), RADIUS, 3, 3, 800, -0.0065, 1, 2))


def buddy_event_check(spark: SparkSession, d: str) -> DataFrame:
    return _flags(buddy.buddy_event_check(stations(spark, d), RADIUS, 5, 30, 0.1, 0, 0, 1))


def sct(spark: SparkSession, d: str) -> DataFrame:
    found = consistency.sct(stations(spark, d), 3, 5, 15_000, 30_000, 3, -1, 100, 10_000, 200, 2, 2, 0.5)
    return found.select("station_id", F.col("flag").cast("int").alias("flag"), F.round("prob_gross_error", 4).alias("prob_gross_error"))


def _ranges(df: DataFrame, admissible: float, tolerance: float) -> DataFrame:
    v = F.col("value")
    return df.withColumns({"mina": v - admissible, "maxa": v + admissible, "minv": v - tolerance, "maxv": v + tolerance})


def sct_resistant(spark: SparkSession, d: str) -> DataFrame:
    df = _ranges(stations(spark, d), 20, 1)
    return _flags(consistency.sct_resistant(df, 3, 5, 10_000, 20_000, 2, 10, 100, 10_000, 100_000, 3, 200, "mina", "maxa", "minv", "maxv", 0.5, 2, 2, background_type="MedianOuterCircle"))


def sct_dual(spark: SparkSession, d: str) -> DataFrame:
    return _flags(consistency.sct_dual(stations(spark, d), 25, "Gt", 3, 5, 10_000, 20_000, 2, 10_000, 100_000, 3, 2000, 0.2))


def first_guess(spark: SparkSession, d: str) -> DataFrame:
    df = _ranges(stations(spark, d), 20, 1)
    return _flags(consistency.fgt(df, 3, 20, 10_000, 20_000, 2, 10, 100, "mina", "maxa", "minv", "maxv", 2, 2, background_type="MedianOuterCircle"))


def lag_reduction(spark: SparkSession, d: str) -> DataFrame:
    done = timeseries.lag_reduction_filter(series(spark, d), "user_id", "t", "value")
    return done.select("user_id", "us", F.round("filtered", 4).alias("filtered"))


def radius_neighbours(spark: SparkSession, d: str) -> DataFrame:
    found = spatial_join.neighbours(posts(spark, d), stations(spark, d), RADIUS)
    return found.select("query_id", "station_id", F.round("dist", 3).alias("dist"))


def neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.num_neighbours(posts(spark, d), stations(spark, d), 15_000.0).select("query_id", F.col("n").cast("long").alias("n"))


def closest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    found = spatial_join.closest_neighbours(posts(spark, d), stations(spark, d), 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "station_id", F.round("dist", 3).alias("dist"))


def nearest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.nearest_neighbour(posts(spark, d), stations(spark, d)).select("query_id", "station_id")


def interpolate(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(51 * 51).select(F.expr("CAST(id DIV 51 AS INT)").alias("gy"), F.expr("CAST(id % 51 AS INT)").alias("gx")).selectExpr("gy", "gx", "55 + gy / 10D AS lat", "5 + gx / 10D AS lon", "CAST(gy * 100 + gx AS DOUBLE) AS value")
    return spatial_join.interpolate_to_points(grid, stations(spark, d)).select("station_id", "value")


def distances(spark: SparkSession, d: str) -> DataFrame:
    s = stations(spark, d)
    x, y, z = convert_coordinates("lat", "lon")
    return s.select("station_id", F.round(calc_distance("lat", "lon", 57.5, 7.5), 3).alias("great_circle"), F.round(calc_distance_fast("lat", "lon", 57.5, 7.5), 3).alias("fast"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


def array_statistics(spark: SparkSession, d: str) -> DataFrame:
    grouped = series(spark, d).groupBy("user_id").agg(F.collect_list("value").alias("a"))
    return grouped.select("user_id", F.round(compute_quantile(0.25, "a"), 6).alias("q25"), F.round(compute_quantile(0.5, "a"), 6).alias("q50"), F.round(find_k_closest("a", 3), 6).alias("third"))


def theil_sen_profile(spark: SparkSession, d: str) -> DataFrame:
    df = stations(spark, d).withColumn("area", F.floor("lat").cast("int"))
    return theil_sen(df, "area", 5, 100).select("area", F.round("slope", 8).alias("slope"), F.round("intercept", 4).alias("intercept"))


def vertical_profile(spark: SparkSession, d: str) -> DataFrame:
    df = stations(spark, d).withColumn("area", F.floor("lat").cast("int"))
    return vertical_profiles(df, "area", 20, 100).select("station_id", F.round("background", 4).alias("background"))


def pipeline_of_checks(spark: SparkSession, d: str) -> DataFrame:
    p = QCPipeline(stations(spark, d)).metadata_check().range_check(-20, 70).isolation_check(2, RADIUS).buddy_check(RADIUS, 5, 3, 0, 0, 1, 1)
    return _flags(p.df)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "range_check": range_check, "range_check_climatology": climatology_check, "metadata_check": metadata_check, "dem_check": dem_check, "external_check": external_check,
    "isolation_check": isolation_check, "isolation_check_vertical": isolation_check_vertical, "duplicate_check": duplicate_check,
    "buddy_check": buddy_check, "buddy_check_elevation": buddy_check_elevation, "buddy_event_check": buddy_event_check,
    "sct": sct, "sct_resistant": sct_resistant, "sct_dual": sct_dual, "first_guess_test": first_guess, "lag_reduction_filter": lag_reduction,
    "radius_neighbours": radius_neighbours, "neighbour_counts": neighbour_counts, "closest_neighbours": closest_neighbours, "nearest_neighbour": nearest_neighbour,
    "interpolate_to_points": interpolate, "distances": distances, "array_statistics": array_statistics, "theil_sen_profile": theil_sen_profile, "vertical_profile": vertical_profile, "check_pipeline": pipeline_of_checks,
}

_S = f"WITH s AS ({STATIONS}), g AS (SELECT *, {PARTS} FROM s)"
_POSTS = "q0 AS (SELECT s_suppkey AS query_id, 55 + ((s_suppkey * 6007) % 4801) / CAST(1000.6 AS DOUBLE) AS lat, 5 + ((s_suppkey * 90001) % 4703) / CAST(999.8 AS DOUBLE) AS lon FROM supplier), q AS (SELECT *, " + PARTS + " FROM q0)"
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_PAIRS = f"SELECT a.station_id AS a, b.station_id AS b, a.value AS va, b.value AS vb, a.elev AS ea, b.elev AS eb FROM g a JOIN g b ON (a.x <> b.x OR a.y <> b.y OR a.z <> b.z) AND {_DIST} <= {{}}"


def _buddy_sql(flags: str, new: str, k: int, num_min: int, adjusted: str, where: str) -> str:
    return f"""{new} AS (SELECT f.station_id, CASE WHEN f.flag = 1 OR (t.n >= {num_min} AND abs(t.v - t.m) > 3 * greatest(sqrt(t.p + t.p / t.n), 1)) THEN 1 ELSE 0 END AS flag
  FROM {flags} f LEFT JOIN (SELECT a, any_value(va) AS v, count(*) AS n, avg({adjusted}) AS m, var_pop({adjusted}) AS p FROM pairs
    JOIN {flags} fa ON fa.station_id = a AND fa.flag = 0 JOIN {flags} fb ON fb.station_id = b AND fb.flag = 0 WHERE {where} GROUP BY a) t ON t.a = f.station_id)"""


_ZERO = "f0 AS (SELECT station_id, 0 AS flag FROM g)"


# Expected temperatures at latitudes 55 to 60, written out: lines between tabled latitudes, a weight by month.
_CLIMATE = "(5 - (lat - 60) / 2) + (30 + (lat - 60) * 7 / 15)"
_MONTHS = """CASE month(DATE '1970-01-01' + CAST(station_id * 11 AS INTEGER)) WHEN 1 THEN -1 WHEN 2 THEN -0.6 WHEN 3 THEN -0.3 WHEN 4 THEN 0 WHEN 5 THEN 0.3
  WHEN 6 THEN 0.6 WHEN 7 THEN 1 WHEN 8 THEN 0.6 WHEN 9 THEN 0.3 WHEN 10 THEN 0 WHEN 11 THEN -0.3 ELSE -0.6 END"""

ORACLE_SQL: dict[str, str] = {
    "range_check": f"{_S} SELECT station_id, CAST(CASE WHEN value < 10 OR value > 50 THEN 1 ELSE 0 END AS INTEGER) AS flag FROM s",
    "range_check_climatology": f"{_S}, c AS (SELECT station_id, value, {_CLIMATE} / 2 * CAST({_MONTHS} AS DOUBLE) AS t FROM s) SELECT station_id, CAST(CASE WHEN value < t - 15 OR value > t + 25 THEN 1 ELSE 0 END AS INTEGER) AS flag FROM c",
    "metadata_check": f"{_S} SELECT station_id, CAST(CASE WHEN station_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS flag FROM s",
    "dem_check": f"{_S} SELECT station_id, CAST(CASE WHEN abs(elev - station_id * 31 % 2400) > 50 THEN 1 ELSE 0 END AS INTEGER) AS flag FROM s",
    "external_check": f"{_S} SELECT station_id, CAST(CASE WHEN station_id % 7 - 5 > 0 THEN 1 ELSE 0 END AS INTEGER) AS flag FROM s",
    "isolation_check": f"{_S}, pairs AS ({_PAIRS.format(10000)}) SELECT station_id, CAST(CASE WHEN coalesce(n, 0) < 2 THEN 1 ELSE 0 END AS INTEGER) AS flag FROM s LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) ON a = station_id",
    "isolation_check_vertical": f"{_S}, pairs AS ({_PAIRS.format('8000 + a.station_id % 5 * 1000')} AND abs(a.elev - b.elev) <= 500 + a.station_id % 3 * 200) SELECT station_id, CAST(CASE WHEN coalesce(n, 0) < 2 THEN 1 ELSE 0 END AS INTEGER) AS flag FROM s LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) ON a = station_id",
    "buddy_check": f"{_S}, pairs AS ({_PAIRS.format(30000)}), {_ZERO}, {_buddy_sql('f0', 'f1', 1, 5, 'vb', 'TRUE')} SELECT station_id, CAST(flag AS INTEGER) AS flag FROM f1",
    "buddy_check_elevation": f"{_S}, pairs AS ({_PAIRS.format(30000)}), {_ZERO}, {_buddy_sql('f0', 'f1', 1, 3, 'vb + (ea - eb) * -0.0065', 'abs(ea - eb) <= 800')}, {_buddy_sql('f1', 'f2', 2, 3, 'vb + (ea - eb) * -0.0065', 'abs(ea - eb) <= 800')} SELECT station_id, CAST(flag AS INTEGER) AS flag FROM f2",
    "buddy_event_check": f"""{_S}, pairs AS ({_PAIRS.format(30000)}), t AS (SELECT a, any_value(va) < 30 AS own, count(*) AS n, count(*) FILTER (WHERE vb < 30) AS e FROM pairs GROUP BY a)
SELECT station_id, CAST(CASE WHEN n >= 5 AND (own AND e / n <= 0.1 OR NOT own AND 1 - e / n <= 0.1) THEN 1 ELSE 0 END AS INTEGER) AS flag FROM s LEFT JOIN t ON a = station_id""",
    "radius_neighbours": f"{_S}, {_POSTS} SELECT query_id, station_id, round({_DIST}, 3) AS dist FROM q a JOIN g b ON {_DIST} <= 30000",
    "neighbour_counts": f"{_S}, {_POSTS} SELECT query_id, count(b.station_id) AS n FROM q a LEFT JOIN g b ON {_DIST} <= 15000 GROUP BY query_id",
    "closest_neighbours": f"{_S}, {_POSTS}, r AS (SELECT query_id, station_id, {_DIST} AS d, row_number() OVER (PARTITION BY query_id ORDER BY {_DIST}, station_id) AS rank FROM q a CROSS JOIN g b) SELECT query_id, CAST(rank AS INTEGER) AS rank, station_id, round(d, 3) AS dist FROM r WHERE rank <= 5",
    "nearest_neighbour": f"{_S}, {_POSTS}, r AS (SELECT query_id, station_id, row_number() OVER (PARTITION BY query_id ORDER BY {_DIST}, station_id) AS rank FROM q a CROSS JOIN g b) SELECT query_id, station_id FROM r WHERE rank = 1",
    "interpolate_to_points": f"{_S}, p0 AS (SELECT gy, gx, 55 + gy / 10 AS lat, 5 + gx / 10 AS lon, CAST(gy * 100 + gx AS DOUBLE) AS value FROM range(51) y(gy), range(51) x(gx)), p AS (SELECT *, {PARTS} FROM p0), r AS (SELECT a.station_id, b.value, row_number() OVER (PARTITION BY a.station_id ORDER BY {_DIST}, b.gy, b.gx) AS rank FROM g a JOIN p b ON abs(a.lat - b.lat) < 0.2 AND abs(a.lon - b.lon) < 0.2) SELECT station_id, value FROM r WHERE rank = 1",
    "distances": f"""{_S} SELECT station_id, round(acos(least(1, greatest(-1, cos(radians(lat)) * cos(radians(57.5e0)) * cos(radians(lon - 7.5)) + sin(radians(lat)) * sin(radians(57.5e0))))) * 6378137e0, 3) AS great_circle,
  round(sqrt(pow((radians(7.5e0) - radians(lon)) * cos((radians(lat) + radians(57.5e0)) / 2), 2) + pow(radians(57.5e0) - radians(lat), 2)) * 6378137e0, 3) AS fast,
  round(cos(radians(lat)) * cos(radians(lon)) * 6370000e0, 3) AS x, round(cos(radians(lat)) * sin(radians(lon)) * 6370000e0, 3) AS y, round(sin(radians(lat)) * 6370000e0, 3) AS z FROM s""",
    "array_statistics": "SELECT user_id, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(list_sort(list(value))[least(3, count(*))], 6) AS third FROM events GROUP BY user_id",
    "theil_sen_profile": f"""{_S}, t AS (SELECT *, CAST(floor(lat) AS INTEGER) AS area FROM s),
m AS (SELECT a.area, median(CASE WHEN abs(a.elev - b.elev) < 1 THEN 0 ELSE (a.value - b.value) / (a.elev - b.elev) END) AS slope FROM t a JOIN t b ON a.area = b.area AND a.station_id < b.station_id GROUP BY a.area)
SELECT area, round(slope, 8) AS slope, round(median(value - slope * elev), 4) AS intercept FROM t JOIN m USING (area) GROUP BY area, slope""",
    "sct": consistency_sql.spatial_consistency(STATIONS, PARTS, 3, 5, 15_000, 30_000, 3, 10_000, 200, 2, 0.5),
    "sct_resistant": consistency_sql.resistant(STATIONS, PARTS, 3, 5, 10_000, 20_000, 2, (10_000, 100_000, 3, 200), 20, 1, 0.5, 2),
    "sct_dual": consistency_sql.dual(STATIONS, PARTS, "p.v > 25", 3, 5, 10_000, 20_000, 2, (10_000, 100_000, 3, 2000), 0.2),
    "first_guess_test": consistency_sql.first_guess(STATIONS, PARTS, 3, 20, 10_000, 20_000, 2, 20, 1, 2),
    "vertical_profile": consistency_sql.profiles(STATIONS, "CAST(floor(lat) AS INTEGER)"),
    "check_pipeline": f"""{_S}, pairs AS ({_PAIRS.format(30000)}), r AS (SELECT station_id, CASE WHEN value < -20 OR value > 70 THEN 1 ELSE 0 END AS flag FROM g),
i AS (SELECT r.station_id, CASE WHEN r.flag = 1 OR coalesce(n, 0) < 2 THEN 1 ELSE 0 END AS flag FROM r LEFT JOIN (SELECT a, count(*) AS n FROM pairs JOIN r x ON x.station_id = a AND x.flag = 0 JOIN r y ON y.station_id = b AND y.flag = 0 GROUP BY a) ON a = r.station_id),
{_buddy_sql('i', 'f1', 1, 5, 'vb', 'TRUE')} SELECT station_id, CAST(flag AS INTEGER) AS flag FROM f1""",
    "duplicate_check": f"""WITH RECURSIVE s AS ({STATIONS}), g AS (SELECT *, {PARTS} FROM s),
e AS (SELECT a.station_id AS id, list(b.station_id) AS earlier FROM g a JOIN g b ON b.station_id < a.station_id AND {_DIST} <= 8000 GROUP BY a.station_id),
o AS MATERIALIZED (SELECT station_id, row_number() OVER (ORDER BY station_id) AS k, coalesce(earlier, []) AS earlier FROM g LEFT JOIN e ON id = station_id),
w AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT o.k, CASE WHEN len(list_intersect(o.earlier, w.kept)) = 0 THEN list_append(w.kept, o.station_id) ELSE w.kept END FROM w JOIN o ON o.k = w.k + 1)
SELECT station_id, CAST(CASE WHEN list_contains((SELECT kept FROM w ORDER BY k DESC LIMIT 1), station_id) THEN 0 ELSE 1 END AS INTEGER) AS flag FROM g""",
    "lag_reduction_filter": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS k FROM events),
d AS MATERIALIZED (SELECT a.user_id, a.us, a.k, b.value AS f0, a.value AS f1, (a.value - b.value) / (a.t - b.t) AS slope FROM e a JOIN e b ON a.user_id = b.user_id AND a.k = b.k + 1),
r AS (SELECT user_id, us, k, value AS filtered FROM e WHERE k = 1 UNION ALL
  SELECT d.user_id, d.us, d.k, list_reduce([r.filtered, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], lambda c, i: c + 0.05 * (
    4 * (0.5 * d.slope + 0.0625 * (d.f0 + i * 0.1 * (d.f1 - d.f0) - c)) + 4 * (0.5 * d.slope + 0.0625 * (d.f0 + (i + 1) * 0.1 * (d.f1 - d.f0) - c))))
  FROM r JOIN d ON d.user_id = r.user_id AND d.k = r.k + 1)
SELECT user_id, us, round(filtered, 4) AS filtered FROM r""",
}
