import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsward.functions import calc_distance, compute_quantile, find_k_closest, is_valid, subset
from obsward.operators import spatial_join as sj
from obsward.operators.buddy import buddy_check, buddy_event_check
from obsward.operators.duplicate import duplicate_check
from obsward.operators.isolation import isolation_check, neighbour_counts
from obsward.sources import from_arrays
from obsward.types import CoordinateType

N = math.nan
CARTESIAN = CoordinateType.Cartesian


def flags(df):
    return [r.flag for r in df.orderBy("station_id").collect()]


@pytest.mark.parametrize(("vertical", "expected"), [(None, [0, 0, 0, 1, 1, 1, 1, 0, 0]), (100.0, [0, 0, 0, 1, 1, 1, 1, 1, 1])])
def test_isolation_with_invalid_places(spark, vertical, expected):
    df = from_arrays(spark, [0, 1, 2, N, N, 5, 6, 7, 8], [0, 1, 2, 3, 4, N, N, 7, 8], [0, 1, 2, 3, 4, 5, 6, N, N])
    assert flags(isolation_check(df, 1, 160_000, vertical)) == expected


@pytest.mark.parametrize(
    ("num", "radius", "vertical", "expected"),
    [(2, 15000, None, [0, 0, 0, 0, 0, 1]), (2, 15000, 100.0, [0, 0, 0, 0, 1, 1]), (2, 15000, 0.0, [1, 0, 0, 0, 1, 1]), (4, 15000, None, [1, 1, 0, 1, 1, 1]), (1, 1000, None, [1] * 6)],
)
def test_isolation(spark, num, radius, vertical, expected):
    df = from_arrays(spark, [60] * 5 + [70], [10, 10.1, 10.2, 10.3, 10.4, 10], [0, 50, 50, 50, 400, 500])
    assert flags(isolation_check(df, num, radius, vertical)) == expected


@pytest.mark.parametrize(("vertical", "expected"), [("v", [1, 2, 2, 2, 1, 2]), (None, [2, 2, 4, 2, 2, 5])])
def test_neighbour_counts_per_station(spark, vertical, expected):
    df = from_arrays(spark, [60] * 5 + [70], [10, 10.1, 10.2, 10.3, 10.4, 10], [0, 100, 200, 100, 0, 100])
    own = spark.createDataFrame([(i, float(r), float(v)) for i, (r, v) in enumerate(zip([12000, 8000, 12000, 8000, 12000, 1e7], [110, 110, 110, 200, 100, 50]))], "station_id long, r double, v double")  # noqa: B905
    got = {r.station_id: r.n for r in neighbour_counts(df.join(own, "station_id"), "r", vertical).collect()}
    assert [got.get(i, 0) for i in range(6)] == expected


@pytest.mark.parametrize(
    ("lats", "lons", "elevs", "radius", "vertical", "expected"),
    [
        ([0, 0, 0, 0, 1, 1.001, 1], [0, 0, 0, 1, 1, 1.001, 0], [0, 0, 1, 0, 0, 0, 0], 10000, None, [0, 1, 1, 0, 0, 1, 0]),
        ([0, 0, 0, 0, 1, 1.001, 1], [0, 0, 0, 1, 1, 1.001, 0], [0, 0, 1, 0, 0, 0, 0], 1, None, [0, 1, 1, 0, 0, 0, 0]),
        ([0, 0, 0, 0, 1, 1.001, 1], [0, 0, 0, 1, 1, 1.001, 0], [0, 0, 1, 0, 0, 0, 0], 10000, 0, [0, 1, 0, 0, 0, 1, 0]),
        ([0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1], [N, 0, 100, 0, N, 100], 10000, 50, [1, 0, 0, 0, 1, 0]),
        ([0, N, 0, 1, 1, 1], [0, 0, 0, 1, 1, N], [0] * 6, 10000, 50, [0, 0, 1, 0, 1, 0]),
        ([0, 0, 1, 1], [0, 1, 1, 1], None, 0, None, [0, 0, 0, 1]),
        ([0, 0, 1, 1.1], [0, 1, 1, 1], None, 12000, None, [0, 0, 0, 1]),
        ([0, 0, 1, 1.1], [0, 1, 1, 1], None, 10000, None, [0, 0, 0, 0]),
    ],
)
def test_duplicate(spark, lats, lons, elevs, radius, vertical, expected):
    assert flags(duplicate_check(from_arrays(spark, lats, lons, elevs), radius, vertical)) == expected


def test_duplicate_is_greedy_in_order(spark):
    r = random.Random(4)
    lats, lons = [r.uniform(0, 1) for _ in range(150)], [r.uniform(0, 1) for _ in range(150)]
    df = from_arrays(spark, lats, lons)
    near = {(x.query_id, x.station_id) for x in sj.neighbours(df.withColumnRenamed("station_id", "query_id"), df, 12000).collect()}
    kept = []
    for i in range(150):
        if not any((i, j) in near for j in kept):
            kept.append(i)
    assert flags(duplicate_check(df, 12000)) == [int(i not in kept) for i in range(150)]


BUDDY = {"radius": 10000, "num_min": 1, "threshold": 1, "max_elev_diff": 200, "elev_gradient": -0.0065, "min_std": 0.01, "num_iterations": 2}


def line(spark, last=0.0, v=(0,) * 8 + (0.1, 1)):
    return from_arrays(spark, [0] * 10, np.linspace(0, 100, 10).tolist(), [0.0] * 9 + [last], None, list(v))


@pytest.mark.parametrize(("change", "expected"), [({}, [0] * 8 + [1, 1]), ({"min_std": 0.3}, [0] * 9 + [1]), ({"min_std": 1}, [0] * 10), ({"num_min": 20}, [0] * 10)])
def test_buddy_geodetic(spark, change, expected):
    df = from_arrays(spark, [60] * 10, [10.001 + i / 1000 for i in range(10)], [0] * 10, None, [0] * 8 + [0.1, 1])
    assert flags(buddy_check(df, **BUDDY | change)) == expected


@pytest.mark.parametrize(
    ("last", "change", "expected"),
    [
        (0.0, {"num_iterations": 1}, [0] * 9 + [1]),
        (0.0, {"num_iterations": 2}, [0] * 8 + [1, 1]),
        (-153.8, {"elev_gradient": 0}, [0] * 8 + [1, 1]),
        (-153.8, {"elev_gradient": -0.0065}, [0] * 8 + [1, 0]),
        (100.0, {"max_elev_diff": 1}, [0] * 8 + [1, 0]),
    ],
)
def test_buddy_cartesian(spark, last, change, expected):
    assert flags(buddy_check(line(spark, last), **BUDDY | change, kind=CARTESIAN)) == expected


def test_buddy_own_radius_invalid_values_and_errors(spark):
    own = line(spark).withColumn("r", F.when(F.col("station_id") == 9, 1.0).otherwise(10000.0))
    assert flags(buddy_check(own, **BUDDY | {"radius": "r"}, kind=CARTESIAN)) == [0] * 10
    first = line(spark, v=(N,) + (0,) * 7 + (0.1, 1))
    assert flags(buddy_check(first, **BUDDY | {"threshold": 1e-4, "max_elev_diff": 1}, kind=CARTESIAN)) == [1] * 10
    with pytest.raises(RuntimeError):
        buddy_check(own, **BUDDY | {"num_min": 0})
    df = from_arrays(spark, [60, 60.1, 60.2], [10] * 3, values=[0, 1, -111])
    assert flags(buddy_check(df, 50000, 2, 2, 200, -0.0065, 1, 5)) == flags(buddy_check(df.orderBy(F.desc("station_id")), 50000, 2, 2, 200, -0.0065, 1, 5))


@pytest.mark.parametrize(("v", "threshold", "expected"), [([0] * 8 + [1] * 2, 0.2, [0] * 8 + [1] * 2), ([N] + [0] * 7 + [1] * 2, 0.9, [1] * 10)])
def test_buddy_event(spark, v, threshold, expected):
    df = from_arrays(spark, [60] * 10, np.linspace(60, 60.001, 10).tolist(), [0] * 10, None, v)
    assert flags(buddy_event_check(df, 10000, 1, 0.5, threshold, -1, 0, 1)) == expected


def test_index_queries(spark):
    points = from_arrays(spark, [60] * 5 + [70], [10, 10.1, 10.2, 10.3, 10.4, 10])
    asked = spark.createDataFrame([(0, 60.0, 10.101), (1, 60.0, 10.1)], "query_id long, lat double, lon double")
    got = sj.neighbours(asked, points, 10000).collect()
    assert {r.station_id for r in got if r.query_id == 0} == {0, 1, 2}
    d = [r.dist for r in got if r.query_id == 0]
    assert min(d) == pytest.approx(55.67, abs=0.1) and max(d) == pytest.approx(5621.6, abs=1)
    other = sj.neighbours(asked, points, 10000, include_match=False).collect()
    assert {r.station_id for r in other if r.query_id == 1} == {0, 2}
    assert [r.n for r in sj.num_neighbours(asked, points, 100.0).orderBy("query_id").collect()] == [1, 1]
    assert [r.station_id for r in sj.nearest_neighbour(asked, points).orderBy("query_id").collect()] == [1, 1]
    assert sj.nearest_neighbour(asked, points.where("false")).first().station_id == -1


def test_joins_against_brute_force(spark):
    r = random.Random(9)
    lats, lons = [r.uniform(-89, 89) for _ in range(300)], [r.uniform(-180, 180) for _ in range(300)]
    df = from_arrays(spark, lats, lons)
    xyz = np.array([[math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a)] for a, o in zip(np.radians(lats), np.radians(lons))]) * 6378137  # noqa: B905
    d = np.sqrt(((xyz[:, None] - xyz) ** 2).sum(-1))
    asked = df.select(F.col("station_id").alias("query_id"), "lat", "lon")
    got = {(x.query_id, x.station_id) for x in sj.neighbours(asked, df, 900_000).collect()}
    assert got == {(i, j) for i in range(300) for j in range(300) if d[i, j] <= 900_000}
    closest = {}
    for x in sj.closest_neighbours(asked, df, 4, start=200_000).collect():
        closest.setdefault(x.query_id, {})[x.rank] = x.station_id
    assert all([closest[i][k + 1] for k in range(4)] == np.argsort(d[i], kind="stable")[:4].tolist() for i in range(300))
    labels = {x.station_id: x.component for x in sj.components(df, 500_000).collect()}
    assert all(labels[i] == labels[j] for i in range(300) for j in range(300) if d[i, j] <= 500_000)


def test_interpolation(spark):
    grid = spark.range(101 * 101).selectExpr("CAST(id DIV 101 AS INT) AS gy", "CAST(id % 101 AS INT) AS gx").selectExpr("gy", "gx", "50 + gy * 0.3D AS lat", "10 + gx / 100D AS lon").withColumn("value", F.col("lat") + F.col("lon"))
    got = sj.interpolate_to_points(grid, from_arrays(spark, [70.1, 70], [10.7, 10])).orderBy("station_id").collect()
    assert [r.value for r in got] == pytest.approx([80.8, 80], abs=0.2)


def test_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, N, 4.0], 1)], "a array<double>, k int")
    row = df.select(compute_quantile(0.5, "a").alias("m"), compute_quantile(0.25, "a").alias("q"), find_k_closest(F.array(F.lit(3), F.lit(1)), 5).alias("k"), is_valid(F.lit(N)).alias("n"), is_valid(F.lit(-1.0)).alias("v"), calc_distance(60.0, 10.0, 60.0, 10.0).alias("d")).first()
    assert (row.m, row.q, row.k, row.n, row.v, row.d) == (2, 1.5, 3, False, True, 0)
    points = from_arrays(spark, [0, 1, 2], [0, 0, 0])
    assert subset(points, [1]).count() == 1 and subset(points, []).count() == 3
