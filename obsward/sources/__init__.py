"""Readers and writers of stations, observations and golden cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATION_SCHEMA = T.StructType([T.StructField("station_id", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("lat", "lon", "elev", "laf", "value")])


def from_arrays(spark: SparkSession, lats: list, lons: list, elevs: list | None = None, lafs: list | None = None, values: list | None = None) -> DataFrame:
    """Stations from parallel arrays, numbered from 0; None stands for a missing number, missing arrays for missing numbers."""
    n = len(lats)
    given = [lats, lons, elevs or [None] * n, lafs or [None] * n, [None] * n if values is None else values]
    if any(len(x) != n for x in given):
        raise ValueError("arrays of stations must be of one size")
    rows = [(i, *(None if v is None else float(v) for v in row)) for i, row in enumerate(zip(*given, strict=True))]
    return spark.createDataFrame(rows, STATION_SCHEMA)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated text with a header (lat;lon;elev;value and maybe laf, station_id).

    Without station_id, rows are numbered in the order of lat, lon, elev and value, which is stable however files are split.
    """
    names = spark.read.option("header", True).option("sep", ";").csv(path).columns
    schema = T.StructType([T.StructField(n, T.LongType() if n == "station_id" else T.DoubleType()) for n in names])
    df = spark.read.option("header", True).option("sep", ";").schema(schema).csv(path)
    if "station_id" not in names:
        ordered = df.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("station_id", F.monotonically_increasing_id())
        df = ordered.select("station_id", *names)
    return df


def read_stations(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Stations from parquet, orc, json or text."""
    if format == "text":
        return read_text(spark, path)
    reader = spark.read.schema(STATION_SCHEMA) if format == "json" else spark.read
    return reader.format(format).load(path)


def write_flags(df: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """Flags and scores; partitioned by flag, so that a reader of bad observations opens their files alone."""
    df.write.format(format).mode(mode).partitionBy("flag").save(path)
