"""Checks on streams of observations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from obsward.operators.timeseries import lag_coefficients


def check_batches(stream: DataFrame, check: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Run a check among neighbours on each micro-batch of observations; checks of single rows can be applied to the stream itself.

    sink gets the flagged batch and its number, which it can use to write each batch once.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda df, k: sink(check(df), k)).start()


def lag_reduction_stream(stream: DataFrame, series: str, time: str, value: str, a: float = 0.5, b: float = 0.5, k1: float = 0.25, k2: float = 0.25, n: int = 10) -> DataFrame:
    """series, t, value, filtered of a stream: the lag filter with the last observation of each series as state.

    Observations must arrive in the order of time across batches; one that is not later than the last has a null result.
    """
    reached, earlier, difference, slope = lag_coefficients(a, b, k1, k2, n)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["t", "value"], kind="stable")
        out: list[float | None] = []
        for t, v in zip(pdf["t"], pdf["value"], strict=True):
            if last is None:
                last = (float(t), float(v), float(v))
            elif t > last[0]:
                t0, f0, r = last
                last = (float(t), float(v), reached * r + earlier * f0 + difference * (v - f0) + slope * (v - f0) / (t - t0))
            else:
                out.append(None)
                continue
            out.append(last[2])
        if last is not None:
            state.update(last)
        yield pd.DataFrame({"series": [key[0]] * len(pdf), "t": pdf["t"].to_numpy(), "value": pdf["value"].to_numpy(), "filtered": pd.array(out, dtype="Float64")})

    rows = stream.selectExpr(f"`{series}` AS series", f"CAST({time} AS DOUBLE) AS t", f"CAST({value} AS DOUBLE) AS value")
    kind = rows.schema["series"].dataType.simpleString()
    return rows.groupBy("series").applyInPandasWithState(step, f"series {kind}, t double, value double, filtered double", "t double, v double, r double", "append", GroupStateTimeout.NoTimeout)
