"""Array functions: as column expressions over arrays, and joins for gather and scatter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsward.functions.validity import Param, param


def compute_quantile(q: float, array: Param) -> Column:
    """Quantile of the valid elements, linear between neighbours; null for an array without any."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    kept = F.array_sort(F.filter(param(array), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    at = F.lit(q) * (F.size(kept) - 1)
    low = F.floor(at).cast("int")
    a = F.get(kept, low)
    b = F.coalesce(F.get(kept, low + 1), a)
    return F.when(F.size(kept) > 0, a + (b - a) * (at - low))


def find_k_closest(array: Param, k: int) -> Column:
    """The k-th smallest element (the largest, if there are fewer); null for an empty array."""
    ordered = F.array_sort(param(array))
    return F.get(ordered, F.least(F.lit(k), F.size(ordered)) - 1)


def subset(df: DataFrame, ids: list[int] | DataFrame | None, key: str = "station_id") -> DataFrame:
    """Rows with the given ids; no ids at all (None or an empty list) mean all rows."""
    if ids is None or (isinstance(ids, list) and not ids):
        return df
    if isinstance(ids, list):
        return df.where(F.col(key).isin(ids)) if len(ids) <= 1000 else df.join(df.sparkSession.createDataFrame([(i,) for i in ids], f"`{key}` bigint").distinct(), key, "left_semi")
    return df.join(ids.select(key).distinct(), key, "left_semi")


def unsubset(values: DataFrame, df: DataFrame, column: str, key: str = "station_id") -> DataFrame:
    """df with `column` taken from values where there is a row for the id, null elsewhere."""
    return df.drop(column).join(values.select(key, column), key, "left")
