"""Time-series filters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from obsward.functions.validity import Param, param
from obsward.stages import cut

#: Of a task's rows: the first; of the part with its series the rows, the last row and its sum; whether there is no other
#: series; the last row of all and its filtered value.
_SUMS = ["part", "s0", "t0", "v0", "n", "t1", "v1", "r1", "single", "s2", "t2", "v2", "r2"]


def lag_coefficients(a: float, b: float, k1: float, k2: float, n: int) -> tuple[float, float, float, float]:
    """What one interval makes of (value reached, earlier observation, difference, slope).

    The reconstruction follows dr/dτ = c[(k1 + k2) slope + k1 k2 (f0 + τ (f1 - f0) - r)] with c = 1 / (a k1 + b k2), in n
    trapezoid steps in which r counts as it was at the step's begin.  That is affine in all four, so n steps are as well.
    """
    c, dt = 1 / (a * k1 + b * k2), 1.0 / n
    pull = c * k1 * k2
    reached, earlier, difference, slope = 1.0, 0.0, 0.0, 0.0
    for s in range(1, n + 1):
        keep = 1 - dt * pull
        reached *= keep
        earlier = keep * earlier + dt * pull
        difference = keep * difference + dt * pull * (s + 0.5) * dt
        slope = keep * slope + dt * c * (k1 + k2)
    return reached, earlier, difference, slope


class _Fold:
    """The recurrence r = reached r + driven over rows in order, a new one for each series."""

    def __init__(self, coefficients: tuple[float, float, float, float], series: Any = None, last: tuple[float, float, float] | None = None):
        self.coefficients, self.series, self.last = coefficients, series, last

    def driven(self, t0: float, v0: float, t: float, v: float) -> float:
        """What an interval adds; NaN where it can't be told."""
        _, earlier, difference, slope = self.coefficients
        return earlier * v0 + difference * (v - v0) + slope * (v - v0) / (t - t0) if t != t0 else math.nan

    def step(self, series: Any, t: float, v: float) -> float:
        if self.last is None or series != self.series:
            r = v
        else:
            t0, v0, r0 = self.last
            r = self.coefficients[0] * r0 + self.driven(t0, v0, t, v)
        self.series, self.last = series, (t, v, r)
        return r


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[Any, float, float]]:
    """Series, time, value; null as NaN."""
    t, v = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_t", "_v"))
    return zip(batch.column("_s").to_pylist(), t, v, strict=True)


def lag_reduction_filter(df: DataFrame, series: str, time: Param, value: Param, a: float = 0.5, b: float = 0.5, k1: float = 0.25, k2: float = 0.25, n: int = 10) -> DataFrame:
    """df with `filtered`: the values of each series with the sensor's lag taken out.

    A series is one recurrence over its observations in the order of time (ties: of value).  Rows without a time are not
    filtered (null).  Where two times are equal the slope is undefined, and from there on the values are null, as after
    an invalid value.

    Rows are ranged by series and time, so a long series lies in several tasks.  As the recurrence is affine, a task's
    part of the series that began before it is summed up without its beginning; these sums, one for each task, are
    chained on the driver, and a second pass over the rows starts each task from where the one before it ends.
    """
    coefficients = lag_coefficients(a, b, k1, k2, n)
    rows = df.select(F.col(series).alias("_s"), param(time).cast("double").alias("_t"), param(value).cast("double").alias("_v"), F.struct("*").alias("_row"))
    order = ["_s", "_t", "_v"]
    ranged = cut(rows.where("_t IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order))
    key = rows.schema["_s"].dataType

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, head, count, first = _Fold(coefficients), None, 0, None
        for batch in batches:
            for s, t, v in _columns(batch):
                if count == 0:
                    first, fold = (s, t, v), _Fold(coefficients, s, (t, v, 0.0))  # r from 0: what the part adds
                    count = 1
                    continue
                if head is None and s != first[0]:
                    head = (count, *fold.last)
                fold.step(s, t, v)
                count += 1
        if count:
            head_ = head or (count, *fold.last)
            values = [TaskContext.get().partitionId(), first[0], *first[1:], *head_, head is None, fold.series, *fold.last]
            yield pa.RecordBatch.from_arrays([pa.array([x], batch.schema.field("_s").type if k in (1, 9) else None) for k, x in enumerate(values)], _SUMS)

    kinds = [LongType(), key, DoubleType(), DoubleType(), LongType(), DoubleType(), DoubleType(), DoubleType(), BooleanType(), key, DoubleType(), DoubleType(), DoubleType()]
    found = ranged.select("_s", "_t", "_v").mapInArrow(sums, StructType([StructField(c, k) for c, k in zip(_SUMS, kinds, strict=True)])).collect()
    before: dict[int, tuple[Any, tuple[float, float, float]]] = {}
    last: tuple[Any, tuple[float, float, float]] | None = None
    for row in sorted(found, key=lambda x: x.part):
        begun = last is not None and last[0] == row.s0
        if begun:
            before[row.part] = last
        start = _Fold(coefficients, *(last if begun else ())).step(row.s0, row.t0, row.v0)
        if row.single:
            last = row.s0, (row.t1, row.v1, row.r1 + coefficients[0] ** (row.n - 1) * start)
        else:
            last = row.s2, (row.t2, row.v2, row.r2)
    shared = df.sparkSession.sparkContext.broadcast(before)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(coefficients, *shared.value.get(TaskContext.get().partitionId(), ()))
        for batch in batches:
            out = np.array([fold.step(s, t, v) for s, t, v in _columns(batch)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, mask=np.isnan(out))], ["_row", "filtered"])

    done = ranged.mapInArrow(filtered, StructType([ranged.schema["_row"], StructField("filtered", DoubleType())])).select("_row.*", "filtered")
    return done.unionByName(rows.where("_t IS NULL").select("_row.*", F.lit(None).cast("double").alias("filtered")))
