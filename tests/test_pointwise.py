import math

import pytest
from pyspark.sql import functions as F

from obsward.operators import pointwise
from obsward.plans.pipeline import QCPipeline
from obsward.sources import from_arrays

N = math.nan


def flags(df):
    return [r.flag for r in df.orderBy("station_id").collect()]


def values(spark, v, **more):
    n = len(v)
    return from_arrays(spark, [60.0] * n, [10.0 + i for i in range(n)], values=v, **more)


@pytest.mark.parametrize(
    ("low", "high", "expected"),
    [([0] * 9, [0.5] * 9, [0, 1, 1, 0, 1, 1, 1, 1, 1]), ([1] * 9, [1, 1, 3, 3, 1, 1, 1, 1, 1], [1, 0, 1, 1, 1, 0, 1, 0, 1])],
)
def test_range(spark, low, high, expected):
    df = values(spark, [0, 1, N, 0, N, 1, N, 1, N])
    bounds = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(low, high))], "station_id long, low double, high double")  # noqa: B905
    assert flags(pointwise.range_check(df.join(bounds, "station_id"), "low", "high")) == expected


def test_range_scalar_infinite_and_empty(spark):
    assert flags(pointwise.range_check(values(spark, [4, 2, 2, math.inf, -math.inf, None]), 3, 5)) == [0, 1, 1, 1, 1, 1]
    assert flags(pointwise.range_check(values(spark, []), 0, 1)) == []


@pytest.mark.parametrize(
    ("off", "expected"),
    [(None, [0, 1, 1, 1, 1]), ("lat", [0, 0, 1, 1, 1]), ("lon", [0, 1, 0, 1, 1]), ("elev", [0, 1, 1, 0, 1]), ("laf", [0, 1, 1, 1, 0])],
)
def test_metadata(spark, off, expected):
    df = from_arrays(spark, [60, N, 62, 63, 64], [10, 11, N, 13, 14], [0, 0, 0, N, 0], [0, 0, 0, 0, N])
    assert flags(pointwise.metadata_check(df, **({f"check_{off}": False} if off else {}))) == expected


def test_climatology_matches_its_tables(spark):
    day = 86400
    df = spark.createDataFrame([(0, 60.0, 0), (1, 52.5, 195 * day), (2, 0.0, 100 * day), (3, -80.0, 10 * day), (4, -80.0, 100 * day)], "station_id long, lat double, t long")
    got = [r.c for r in df.select("station_id", pointwise.climatology("lat", "t").alias("c")).orderBy("station_id").collect()]
    assert got[0] == pytest.approx(5 - 30 / 2)  # January at a table latitude
    assert got[1] == pytest.approx(8.75 + 26.5 / 2)  # July between 60 and 50, and between 60 and 45
    assert got[2] == pytest.approx(30)  # April
    assert got[3] is None and got[4] == pytest.approx(0 - 25 * 20 / 30)
    flagged = pointwise.range_check_climatology(df.withColumn("value", F.lit(-80.0)), "t", 30, -30)
    assert flags(flagged) == [1, 1, 1, 0, 1]


def test_dem_and_external_overwrite(spark):
    df = from_arrays(spark, [60, 60, 60], [1, 2, 3], [10, 500, N]).withColumn("dem", F.lit(0.0))
    assert flags(pointwise.dem_check(df, "dem", 100)) == [0, 1, 0]
    assert flags(QCPipeline(df).external_check(F.col("station_id") - 1).df) == [0, 0, 1]


def test_pipeline_indices(spark):
    p = QCPipeline(values(spark, [1, 2, 3, 4, 5])).range_check(-100, -100, ids=[0, 1, 2])
    assert flags(p.df) == [1, 1, 1, 0, 0]
    assert flags(p.range_check(-100, -100, ids=[1, 2, 4]).df) == [1, 1, 1, 0, 1]
    assert flags(p.range_check(-100, -100, ids=[]).df) == [1, 1, 1, 0, 0]


def test_external_then_isolation(spark):
    df = from_arrays(spark, [60] * 4, [10, 10.1, 10.2, 12], values=[0] * 4)
    outside = spark.createDataFrame([(i, f) for i, f in enumerate([0, 1, 0, 0])], "station_id long, flag int")
    assert flags(QCPipeline(df).external_check(outside).isolation_check(1, 100_000).df) == [0, 1, 0, 1]
    with pytest.raises(ValueError):
        QCPipeline(df).external_check(outside.limit(2))
