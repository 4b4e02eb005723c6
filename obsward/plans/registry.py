"""All registered queries over the driver's tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obsward.plans import rough, stations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = stations.QUERIES | rough.QUERIES
ORACLE_SQL: dict[str, str] = stations.ORACLE_SQL | rough.ORACLE_SQL
