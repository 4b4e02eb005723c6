"""Duplicate check: the first station of each neighbourhood stays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from obsward.functions.validity import clean, is_valid
from obsward.operators import regions
from obsward.operators.spatial_join import located, numbers, placed, tiled
from obsward.stages import cut, stored
from obsward.types import DEFAULT, Columns, CoordinateType

OPEN, KEPT, GONE = 0, 1, 2


def duplicate_check(df: DataFrame, radius: float, vertical_range: float | None = None, kind: CoordinateType | int | str = CoordinateType.Geodetic, cols: Columns = DEFAULT) -> DataFrame:
    """Flag 1 for a station that an earlier kept one lies within the radius of (and within the vertical range).

    In the order of ids a station is kept unless a kept one covers it: the lexicographically first maximal independent
    set.  It is found in rounds: who has no undecided earlier neighbour and no kept one is kept, who has a kept one goes.
    Stations at one place (and elevation) follow their first, so only that one is looked at.  With a
    vertical range, stations without a valid elevation are flagged and cover nothing; stations without a valid place
    are kept.
    """
    vertical = vertical_range is not None
    rows = placed(df, kind, cols).select(cols.id, "x", "y", "z", (clean(cols.elev) if vertical else F.lit(0.0)).alias("e"))
    if vertical:
        rows = rows.where("e IS NOT NULL")
    first = rows.groupBy("x", "y", "z", "e").agg(F.min(cols.id).alias("id"))
    gone = _covered(cut(first), float(radius), float(vertical_range) if vertical else None)
    kept = first.select("id").join(gone, "id", "left_anti").withColumnRenamed("id", cols.id).withColumn("_kept", F.lit(True))
    bad = F.col("_kept").isNull() & is_valid(cols.lat) & is_valid(cols.lon)
    if vertical:
        bad = bad | ~is_valid(cols.elev)
    return df.join(kept, cols.id, "left").withColumn(cols.flag, F.when(bad, 1).otherwise(0)).drop("_kept")


def _covered(first: DataFrame, radius: float, vertical: float | None) -> DataFrame:
    """Ids that a kept earlier neighbour covers.  first: id, x, y, z, e.

    Each tile goes as far as it can by itself; only what waits for an undecided station beyond its edge goes on to the
    next round, with the kept ones.  Whether a station has such neighbours is asked of trees, no pairs are made.
    """
    schema = StructType([*[first.schema[c] for c in ("id", "x", "y", "z", "e")], StructField("state", IntegerType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return a.select(["id", "x", "y", "z", "e"]).append_column("state", pa.array(_decided(a, b, radius, vertical), pa.int32()))

    open_, kept, gone = first, first.withColumn("state", F.lit(KEPT)).where("false"), first.select("id").where("false")
    while not open_.isEmpty():
        points = open_.withColumn("state", F.lit(OPEN)).unionByName(kept).select("x", "y", "z", "e", "state", F.col("id").alias("other"))
        done = stored(tiled(open_, points, radius, run, schema))
        open_ = done.where(F.col("state") == OPEN).drop("state")
        kept, gone = kept.unionByName(done.where(F.col("state") == KEPT)), gone.unionByName(done.where(F.col("state") == GONE).select("id"))
    return gone


def _decided(a: pa.Table, b: pa.Table, radius: float, vertical: float | None) -> np.ndarray:
    """States of a tile's stations a, given those around: b, with a among them."""
    if not a.num_rows:
        return np.zeros(0, dtype=np.int32)
    at, e, state = located(b), *(c.copy() for c in numbers(b, "e", "state"))
    ids, rank = np.unique(b.column("other").to_numpy(), return_inverse=True)
    mine = np.empty(len(ids), dtype=np.int64)
    mine[rank] = np.arange(len(rank))
    mine = mine[np.searchsorted(ids, a.column("id").to_numpy())]
    home = np.zeros(len(at), bool)
    home[mine] = True

    def reached(some: np.ndarray, by: np.ndarray, earlier: bool) -> np.ndarray:
        """Which of some stations have one of the others in reach."""
        sides = [] if vertical is None else [regions.within(e[by], e[some], vertical, regions.scale(np.full(1, radius), np.full(1, vertical)))]
        if earlier:
            r, q = rank[by].astype(float), rank[some].astype(float)
            sides.append(regions.Side(r, np.full(len(q), -np.inf), q - 1, lambda p, i, _: p < q[i, None], regions.scale(np.full(1, radius), np.full(1, len(ids) / 2))))
        return regions.counts(at[some], at[by], np.full(len(some), radius), False, np.ones(len(some)), sides) >= 1

    new = np.flatnonzero(state == KEPT)
    while True:
        waiting = np.flatnonzero(state == OPEN)
        state[waiting[reached(waiting, new, False)]] = GONE
        waiting = np.flatnonzero(state == OPEN)
        asked = waiting[home[waiting]]
        new = asked[~reached(asked, waiting, True)]
        if not len(new):
            return state[mine].astype(np.int32)
        state[new] = KEPT
