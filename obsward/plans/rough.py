"""Registered queries over stations with invalid numbers and shared places, and over parameters that others leave out.

The SQL states the same results; invalid numbers are null, NaN and the infinities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsward import __version__
from obsward.functions import arrays, geo, validity
from obsward.operators import background_frame, buddy, duplicate, isolation, pointwise, spatial_join
from obsward.plans import stations
from obsward.plans.pipeline import QCPipeline
from obsward.types import Columns


def _spoilt(expression: str, every: int, shift: int) -> str:
    """The expression, at some stations null, NaN or infinite."""
    return f"""CASE (c_custkey + {shift}) % {every} WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE)
      WHEN 2 THEN CAST('Infinity' AS DOUBLE) WHEN 3 THEN CAST('-Infinity' AS DOUBLE) ELSE {expression} END"""


#: Stations of which three in thirty share a place; some numbers of every kind are invalid.
ROUGH = f"""
  SELECT c_custkey AS station_id,
    {_spoilt("55 + ((place * 7919) % 5003) / CAST(1000.6 AS DOUBLE)", 61, 7)} AS lat,
    {_spoilt("5 + ((place * 104729) % 4999) / CAST(999.8 AS DOUBLE)", 67, 11)} AS lon,
    {_spoilt("CAST((c_custkey * 31) % 2500 AS DOUBLE)", 43, 5)} AS elev,
    {_spoilt("CAST((c_custkey * 13) % 11 AS DOUBLE) / 10", 37, 2)} AS laf,
    {_spoilt("30 - CAST(0.0065 AS DOUBLE) * ((c_custkey * 31) % 2500) + c_acctbal / 1000", 53, 3)} AS value
  FROM (SELECT *, CASE WHEN c_custkey % 30 < 3 THEN c_custkey - c_custkey % 30 ELSE c_custkey END AS place
        FROM customer) c"""


def rough(spark: SparkSession, d: str) -> DataFrame:
    customer = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal")
    return spark.sql(ROUGH.replace("FROM customer", "FROM {customer}"), customer=customer)


def _flags(df: DataFrame) -> DataFrame:
    return df.select("station_id", F.col("flag").cast("int").alias("flag"))


def invalid_range(spark: SparkSession, d: str) -> DataFrame:
    return _flags(pointwise.range_check(rough(spark, d), 10, "elev"))


def invalid_metadata(spark: SparkSession, d: str) -> DataFrame:
    df = rough(spark, d)
    every, some = pointwise.metadata_check(df), pointwise.metadata_check(df, check_lat=False, check_elev=False)
    return every.select("station_id", "flag").join(some.select("station_id", F.col("flag").alias("some")), "station_id")


def invalid_terrain(spark: SparkSession, d: str) -> DataFrame:
    return _flags(pointwise.dem_check(rough(spark, d), F.expr("IF(station_id % 9 = 0, DOUBLE('NaN'), elev + station_id % 100)"), 50))


def invalid_isolation(spark: SparkSession, d: str) -> DataFrame:
    vertical = F.expr("CASE station_id % 5 WHEN 0 THEN NULL WHEN 1 THEN DOUBLE('NaN') ELSE 300 + station_id % 7 * 100 END")
    df = rough(spark, d).withColumns({"r": F.expr("CAST(9000 + station_id % 4 * 2000 AS DOUBLE)"), "v": vertical})
    return _flags(isolation.isolation_check(df, 2, "r", "v"))


def invalid_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _flags(duplicate.duplicate_check(rough(spark, d), 8_000.0, 700.0))


def buddy_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Radius, number and choice of stations by column; all invalid values begin flagged."""
    df = rough(spark, d).withColumns({"r": F.expr("CAST(20000 + station_id % 3 * 8000 AS DOUBLE)"), "m": F.expr("3 + station_id % 4"), "chosen": F.expr("CAST(station_id % 5 > 0 AS INT)")})
    return _flags(buddy.buddy_check(df, "r", "m", 2, 900, -0.0065, 1, 3, "chosen"))


def buddy_invalid_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """With one number for all, only the first row is looked at for an invalid value."""
    return _flags(buddy.buddy_check(rough(spark, d), 20_000.0, 3, 2, 0, 0, 1, 1))


def buddy_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _flags(buddy.buddy_check(rough(spark, d), 20_000.0, 3, 2, 0, 0, 1, 1, compat="fixed"))


def buddy_event_counts(spark: SparkSession, d: str) -> DataFrame:
    df = rough(spark, d).withColumn("chosen", F.expr("CAST(station_id % 6 > 0 AS INT)"))
    return _flags(buddy.buddy_event_check(df, 25_000.0, 4, 20, 1, 1500, -0.0065, 1, "chosen"))


def other_places(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours at other places, of the stations themselves."""
    df = rough(spark, d)
    queries = df.select(F.col("station_id").alias("query_id"), "lat", "lon")
    return spatial_join.num_neighbours(queries, df, 12_000.0, include_match=False).select("query_id", F.col("n").cast("long").alias("n"))


def in_the_plane(spark: SparkSession, d: str) -> DataFrame:
    """Cartesian coordinates: the three nearest and their distances, the place itself left out."""
    df = rough(spark, d)
    queries = df.where("station_id % 10 = 0").select(F.col("station_id").alias("query_id"), "lat", "lon")
    near = spatial_join.closest_neighbours(queries, df, 3, include_match=False, kind="Cartesian")
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "station_id", F.round("dist", 9).alias("dist"))


def units(spark: SparkSession, d: str) -> DataFrame:
    valid = [validity.is_valid(c).alias(f"valid_{c}") for c in ("lat", "lon", "elev", "laf", "value")]
    angle = F.col("station_id") % 360
    return rough(spark, d).select("station_id", *valid, F.round(geo.deg2rad(angle), 9).alias("radians"), F.round(geo.rad2deg(angle / 57.0), 9).alias("degrees"))


def version(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.lit(__version__).alias("version"))


def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return pointwise.count_flags(pointwise.range_check(rough(spark, d), 10, 30)).select(F.col("flag").cast("int").alias("flag"), "n")


def chosen_rows(spark: SparkSession, d: str) -> DataFrame:
    """Flags kept from before; unflagged rows, those with the ids, gathered and scattered."""
    df = rough(spark, d).withColumn("flag", F.expr("CAST(station_id % 4 = 0 AS INT)"))
    ids = df.where("station_id % 3 = 0").select("station_id")
    p = QCPipeline(df, keep_flags=True)
    mark = lambda some, name: some.select("station_id").withColumn(name, F.lit(1))
    out = df.select("station_id")
    sets = {"unflagged": p.unflagged(), "valid": p.valid_subset(ids), "none": p.valid_subset([]), "every": p.valid_subset([-1]), "gathered": arrays.subset(df, ids), "whole": arrays.subset(df, [])}
    for name, some in sets.items():
        out = arrays.unsubset(mark(some, name), out, name)
    return out.select("station_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in sets])


def backgrounds(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and external backgrounds of areas, held within bounds."""
    df = rough(spark, d).withColumn("area", F.expr("CAST(station_id % 13 AS INT)"))
    out = df.select("station_id")
    for kind in ("MeanOuterCircle", "MedianOuterCircle", "External"):
        found = background_frame.group_background(df, "area", kind, lowest=18.0, highest=22.5, external="value")
        out = out.join(found.select("station_id", F.round("background", 6).alias(kind)), "station_id")
    return out.select("station_id", F.col("MeanOuterCircle").alias("mean"), F.col("MedianOuterCircle").alias("median"), F.expr("IF(isnan(External) OR External IS NULL, 18.0D, External)").alias("external"))


def checks_with_ids(spark: SparkSession, d: str) -> DataFrame:
    """A chain on chosen stations: range, climatology, then duplicates among all that are left."""
    df = stations.stations(spark, d)
    odd = df.where("station_id % 2 = 1").select("station_id")
    p = QCPipeline(df).range_check(0, 60, ids=odd).range_check_climatology(F.expr("station_id * 86400 * 11"), 25, -15, ids=list(range(1, 900)))
    return _flags(p.duplicate_check(9_000.0, ids=odd).df)


def climatology_everywhere(spark: SparkSession, d: str) -> DataFrame:
    """All latitudes and months, bounds by column."""
    df = rough(spark, d).withColumns({"lat": F.expr("(station_id * 7919 % 1801 - 900) / 10D"), "above": F.expr("CAST(10 + station_id % 7 AS DOUBLE)"), "below": F.expr("CAST(-5 - station_id % 11 AS DOUBLE)")})
    return _flags(pointwise.range_check_climatology(df, F.expr("station_id * 86400 * 17"), "above", "below"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "invalid_range": invalid_range, "invalid_metadata": invalid_metadata, "invalid_terrain": invalid_terrain,
    "invalid_isolation": invalid_isolation, "invalid_duplicates": invalid_duplicates, "buddy_vectors": buddy_vectors,
    "buddy_invalid_neighbours": buddy_invalid_neighbours, "buddy_fixed": buddy_fixed, "buddy_event_counts": buddy_event_counts,
    "other_places": other_places, "in_the_plane": in_the_plane, "units": units, "version": version,
    "flag_counts": flag_counts, "chosen_rows": chosen_rows, "backgrounds": backgrounds, "checks_with_ids": checks_with_ids,
    "climatology_everywhere": climatology_everywhere,
}

_R = f"""WITH RECURSIVE r AS ({ROUGH}),
v AS (SELECT *, coalesce(isfinite(value), FALSE) AS ok, CASE WHEN isfinite(elev) THEN elev END AS e FROM r),
p AS (SELECT * FROM v WHERE isfinite(lat) AND isfinite(lon)),
g AS (SELECT *, {stations.PARTS} FROM p)"""
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_OTHER = "(a.x <> b.x OR a.y <> b.y OR a.z <> b.z)"
_FLAG = "CAST(CASE WHEN {} THEN 1 ELSE 0 END AS INTEGER) AS {}"


def _buddies(radius: str, more: str, adjusted: str) -> str:
    return f"""w AS (SELECT a.station_id AS a, b.station_id AS b, a.value AS va, a.ok AS oka, b.ok AS okb, {adjusted} AS vb
  FROM g a JOIN g b ON {_OTHER} AND {_DIST} <= {radius} {more})"""


def _turn(k: int, num_min: str, threshold: int, chosen: str) -> str:
    """A round of the buddy check on the flags f{k-1}; without a finite mean no station is flagged."""
    return f"""t{k} AS (SELECT a, any_value(va) AS va, count(*) AS n, bool_and(okb) AS fine, avg(CASE WHEN okb THEN vb END) AS m, var_pop(CASE WHEN okb THEN vb END) AS p
  FROM w JOIN f{k - 1} x ON x.station_id = a AND x.flag = 0 JOIN f{k - 1} y ON y.station_id = b AND y.flag = 0 WHERE {chosen} GROUP BY a),
f{k} AS (SELECT f.station_id, CASE WHEN f.flag = 1 THEN 1 WHEN n >= {num_min} AND fine AND va IS NOT NULL AND NOT isnan(va)
  AND abs(va - m) / greatest(sqrt(p + p / n), 1) > {threshold} THEN 1 ELSE 0 END AS flag FROM f{k - 1} f LEFT JOIN t{k} ON a = f.station_id)"""


_FIRST = "f0 AS (SELECT station_id, CASE WHEN NOT ok AND {} THEN 1 ELSE 0 END AS flag FROM v)"
_STATIONS = f"WITH RECURSIVE s AS ({stations.STATIONS}), g AS (SELECT *, {stations.PARTS} FROM s)"
_GREEDY = """o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k, earlier FROM n),
u AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT o.k, CASE WHEN len(list_intersect(o.earlier, u.kept)) = 0 THEN list_append(u.kept, o.id) ELSE u.kept END FROM u JOIN o ON o.k = u.k + 1),
l AS MATERIALIZED (SELECT kept FROM u ORDER BY k DESC LIMIT 1)"""
_BETWEEN = "greatest(least({}, 22.5), 18)"

# Expected temperatures, written out: lines between the tabled latitudes, and a weight by month.
_MEAN = """CASE WHEN lat > 60 THEN -15 + (lat - 90) * 20 / -30 WHEN lat > 50 THEN 5 + (lat - 60) * 5 / -10 WHEN lat > 45 THEN 10 + (lat - 50) * 5 / -5
  WHEN lat > 40 THEN 15 + (lat - 45) * 5 / -5 WHEN lat > 30 THEN 20 + (lat - 40) * 5 / -10 WHEN lat > 15 THEN 25 + (lat - 30) * 5 / -15
  WHEN lat > 0 THEN 30 WHEN lat > -15 THEN 30 + lat * 5 / 15 WHEN lat > -30 THEN 25 + (lat + 15) * 4 / 15 WHEN lat > -35 THEN 21 + (lat + 30) / 5
  WHEN lat > -40 THEN 20 + (lat + 35) WHEN lat > -45 THEN 15 + (lat + 40) WHEN lat > -60 THEN 10 + (lat + 45) * 10 / 15 WHEN lat > -90 THEN (lat + 60) * 25 / 30 END"""
_SEASON = """CASE WHEN lat > 75 THEN 40 + (lat - 90) * 8 / 15 WHEN lat > 60 THEN 32 + (lat - 75) * 2 / 15 WHEN lat > 45 THEN 30 + (lat - 60) * 7 / 15
  WHEN lat > 30 THEN 23 + (lat - 45) * 10 / 15 WHEN lat > 15 THEN 13 + (lat - 30) * 10 / 15 WHEN lat > 0 THEN 3 + (lat - 15) * 3 / 15
  WHEN lat > -15 THEN lat * -4 / 15 WHEN lat > -30 THEN 4 - (lat + 15) * 3 / 15 WHEN lat > -45 THEN 7 + (lat + 30) / 15
  WHEN lat > -60 THEN 6 - (lat + 45) * 5 / 15 WHEN lat > -75 THEN 11 - (lat + 60) END"""
_WEIGHT = """CASE month(DATE '1970-01-01' + CAST(station_id * {} AS INTEGER)) WHEN 1 THEN -1e0 WHEN 2 THEN -0.6e0 WHEN 12 THEN -0.6e0 WHEN 3 THEN -0.3e0 WHEN 11 THEN -0.3e0
  WHEN 5 THEN 0.3e0 WHEN 9 THEN 0.3e0 WHEN 6 THEN 0.6e0 WHEN 8 THEN 0.6e0 WHEN 7 THEN 1e0 ELSE 0 END"""

ORACLE_SQL: dict[str, str] = {
    "invalid_range": f"{_R} SELECT station_id, {_FLAG.format('NOT ok OR value < 10 OR NOT isnan(elev) AND value > elev', 'flag')} FROM v",
    "invalid_metadata": f"""{_R} SELECT station_id, {_FLAG.format('NOT coalesce(isfinite(lat) AND isfinite(lon) AND isfinite(elev) AND isfinite(laf), FALSE)', 'flag')},
  {_FLAG.format('NOT coalesce(isfinite(lon) AND isfinite(laf), FALSE)', 'some')} FROM v""",
    "invalid_terrain": f"{_R} SELECT station_id, {_FLAG.format('e IS NOT NULL AND station_id % 9 > 0 AND station_id % 100 > 50', 'flag')} FROM v",
    "invalid_isolation": f"""{_R}, c AS (SELECT a.station_id AS a, count(*) AS n FROM g a JOIN g b ON {_OTHER} AND {_DIST} <= 9000 + a.station_id % 4 * 2000
    AND (a.station_id % 5 < 2 OR abs(a.e - b.e) <= 300 + a.station_id % 7 * 100) GROUP BY a.station_id)
SELECT v.station_id, {_FLAG.format('x IS NULL OR coalesce(n, 0) < 2 OR v.station_id % 5 > 1 AND v.e IS NULL', 'flag')} FROM v LEFT JOIN g ON g.station_id = v.station_id LEFT JOIN c ON a = v.station_id""",
    "invalid_duplicates": f"""{_R}, h AS (SELECT * FROM g WHERE e IS NOT NULL),
n AS (SELECT a.station_id AS id, coalesce(list(b.station_id) FILTER (WHERE b.station_id IS NOT NULL), []) AS earlier
  FROM h a LEFT JOIN h b ON b.station_id < a.station_id AND {_DIST} <= 8000 AND abs(a.e - b.e) <= 700 GROUP BY a.station_id),
{_GREEDY} SELECT v.station_id, {_FLAG.format('v.e IS NULL OR g.station_id IS NOT NULL AND NOT list_contains((FROM l), v.station_id)', 'flag')} FROM v LEFT JOIN g ON g.station_id = v.station_id""",
    "buddy_vectors": f"""{_R}, {_buddies('20000 + a.station_id % 3 * 8000', 'AND abs(a.e - b.e) <= 900', 'b.value + (a.e - b.e) * -0.0065')}, {_FIRST.format('TRUE')},
{_turn(1, '3 + f.station_id % 4', 2, 'a % 5 > 0')}, {_turn(2, '3 + f.station_id % 4', 2, 'a % 5 > 0')}, {_turn(3, '3 + f.station_id % 4', 2, 'a % 5 > 0')} SELECT station_id, CAST(flag AS INTEGER) AS flag FROM f3""",
    "buddy_invalid_neighbours": f"{_R}, {_buddies('20000', '', 'b.value')}, {_FIRST.format('station_id = (SELECT min(station_id) FROM v)')}, {_turn(1, '3', 2, 'TRUE')} SELECT station_id, CAST(flag AS INTEGER) AS flag FROM f1",
    "buddy_fixed": f"{_R}, {_buddies('20000', '', 'b.value')}, {_FIRST.format('TRUE')}, {_turn(1, '3', 2, 'TRUE')} SELECT station_id, CAST(flag AS INTEGER) AS flag FROM f1",
    "buddy_event_counts": f"""{_R}, {_buddies('25000', 'AND abs(a.e - b.e) <= 1500', 'b.value + (a.e - b.e) * -0.0065')}, {_FIRST.format('station_id = (SELECT min(station_id) FROM v)')},
t AS (SELECT a, coalesce(any_value(va) < 20, FALSE) AS own, count(*) AS n, count(*) FILTER (WHERE vb < 20) AS events
  FROM w JOIN f0 x ON x.station_id = a AND x.flag = 0 JOIN f0 y ON y.station_id = b AND y.flag = 0 WHERE a % 6 > 0 GROUP BY a)
SELECT f0.station_id, {_FLAG.format('flag = 1 OR n >= 4 AND CASE WHEN own THEN events <= 1 ELSE n - events <= 1 END', 'flag')} FROM f0 LEFT JOIN t ON a = f0.station_id""",
    "other_places": f"{_R}, c AS (SELECT a.station_id AS a, count(*) AS n FROM g a JOIN g b ON {_OTHER} AND {_DIST} <= 12000 GROUP BY a.station_id) SELECT station_id AS query_id, coalesce(n, 0) AS n FROM v LEFT JOIN c ON a = station_id",
    "in_the_plane": f"""{_R}, c AS (SELECT a.station_id AS query_id, b.station_id, sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS dist
  FROM p a JOIN p b ON (a.lat <> b.lat OR a.lon <> b.lon) WHERE a.station_id % 10 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, station_id) AS rank FROM c)
SELECT query_id, CAST(rank AS INTEGER) AS rank, station_id, round(dist, 9) AS dist FROM k WHERE rank <= 3""",
    "units": f"""{_R} SELECT station_id, coalesce(isfinite(lat), FALSE) AS valid_lat, coalesce(isfinite(lon), FALSE) AS valid_lon, e IS NOT NULL AS valid_elev, coalesce(isfinite(laf), FALSE) AS valid_laf, ok AS valid_value,
  round(station_id % 360 * pi() / 180, 9) AS radians, round(station_id % 360 / 57 * 180 / pi(), 9) AS degrees FROM v""",
    "version": "SELECT '0.1.0' AS version",
    "flag_counts": f"{_R} SELECT {_FLAG.format('NOT ok OR value < 10 OR value > 30', 'flag')}, count(*) AS n FROM v GROUP BY ALL",
    "chosen_rows": """SELECT c_custkey AS station_id, CAST(c_custkey % 4 > 0 AS INTEGER) AS unflagged, CAST(c_custkey % 4 > 0 AND c_custkey % 3 = 0 AS INTEGER) AS valid,
  0 AS "none", CAST(c_custkey % 4 > 0 AS INTEGER) AS every, CAST(c_custkey % 3 = 0 AS INTEGER) AS gathered, 1 AS whole FROM customer""",
    "backgrounds": f"""{_R}, c AS (SELECT station_id % 13 AS area, avg(value) AS m, median(value) AS d FROM v WHERE ok GROUP BY area)
SELECT station_id, round({_BETWEEN.format('m')}, 6) AS mean, round({_BETWEEN.format('d')}, 6) AS median, CASE WHEN isnan(value) THEN 22.5 WHEN value IS NULL THEN 18 ELSE round({_BETWEEN.format('value')}, 6) END AS external
  FROM v JOIN c ON area = station_id % 13""",
    "checks_with_ids": f"""{_STATIONS}, c AS (SELECT *, {_MEAN} + ({_SEASON}) / 2 * {_WEIGHT.format(11)} AS t FROM g),
f AS (SELECT *, station_id % 2 = 1 AND (value < 0 OR value > 60) OR station_id BETWEEN 1 AND 899 AND (value < t - 15 OR value > t + 25) AS bad FROM c),
h AS (SELECT * FROM f WHERE NOT bad),
n AS (SELECT a.station_id AS id, coalesce(list(b.station_id) FILTER (WHERE b.station_id IS NOT NULL), []) AS earlier
  FROM h a LEFT JOIN h b ON b.station_id < a.station_id AND {_DIST} <= 9000 GROUP BY a.station_id),
{_GREEDY} SELECT station_id, {_FLAG.format('bad OR station_id % 2 = 1 AND NOT list_contains((FROM l), station_id)', 'flag')} FROM f""",
    "climatology_everywhere": f"""{_R}, m AS (SELECT station_id, value, ok, (station_id * 7919 % 1801 - 900) / 10e0 AS lat FROM v),
c AS (SELECT *, {_WEIGHT.format(17)} AS w FROM m), k AS (SELECT *, {_MEAN} + CASE WHEN w = 0 THEN 0 ELSE ({_SEASON}) / 2 * w END AS t FROM c)
SELECT station_id, {_FLAG.format('NOT ok OR t IS NOT NULL AND (value < t - 5 - station_id % 11 OR value > t + 10 + station_id % 7)', 'flag')} FROM k""",
}
