"""Valid numbers: neither null, NaN nor infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Param = Column | str | float | int


def param(value: Param) -> Column:
    """A scalar as literal, a name as column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def is_scalar(value: Param) -> bool:
    return isinstance(value, (int, float))


def is_valid(value: Param) -> Column:
    c = param(value).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def clean(value: Param) -> Column:
    """The number as double, null where it isn't valid, so that comparisons with it are never true."""
    return F.when(is_valid(value), param(value).cast("double"))


def sure(condition: Column) -> Column:
    """False where the condition can't be decided."""
    return F.coalesce(condition, F.lit(False))
