"""Background models of groups of stations as DataFrame operators."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from obsward.functions.validity import clean, is_valid
from obsward.operators.background import LAPSE, vertical_profile
from obsward.operators.slopes import median_slope
from obsward.types import DEFAULT, BackgroundType, Columns, member


def theil_sen(df: DataFrame, group: str, num_min_prof: int, min_elev_diff: float, cols: Columns = DEFAULT) -> DataFrame:
    """group, slope, intercept: median slope of all pairs (0 within a metre of elevation), median of what is left.

    Groups with few stations or on flat ground take the standard lapse rate.  Pairs are counted and not made
    (operators.slopes); each group's rows go to one task.
    """
    rows = df.where(is_valid(cols.elev) & is_valid(cols.value)).select(F.col(group).alias("_g"), F.col(cols.id).alias("_id"), clean(cols.elev).alias("_z"), clean(cols.value).alias("_v"))

    def slope(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        z, v = (t.column(c).to_numpy() for c in ("_z", "_v"))
        return pa.table({"_g": pa.array([group[0].as_py()], t.schema.field("_g").type), "_m": pa.array([median_slope(z, v)])})

    fields = StructType([rows.schema["_g"], StructField("_m", DoubleType())])
    slopes = rows.where("_g IS NOT NULL").select("_g", "_z", "_v").groupBy("_g").applyInArrow(slope, fields).withColumn("_m", F.nanvl("_m", F.lit(None).cast("double")))
    shape = rows.groupBy("_g").agg(F.count("*").alias("_n"), F.percentile("_z", F.array(F.lit(0.05), F.lit(0.95))).alias("_e"))
    flat = (F.col("_n") < num_min_prof) | (F.col("_e")[1] - F.col("_e")[0] < min_elev_diff) | (F.col("_e")[1] == F.col("_e")[0])
    fitted = shape.join(slopes, "_g", "left").select("_g", F.when(flat, LAPSE).otherwise(F.coalesce("_m", F.lit(LAPSE))).alias("slope"))
    return rows.join(fitted, "_g").groupBy(F.col("_g").alias(group), "slope").agg(F.percentile(F.col("_v") - F.col("slope") * F.col("_z"), F.lit(0.5)).alias("intercept"))


def vertical_profiles(df: DataFrame, group: str, num_min_prof: int, min_elev_diff: float, cols: Columns = DEFAULT) -> DataFrame:
    """station_id, background: the temperature profile of the station's group at its elevation.

    Fitted to valid rows, given for those with a valid elevation; each group's rows go to one task.
    """
    rows = df.where(is_valid(cols.elev)).select(F.col(cols.id).cast("long").alias("station_id"), F.col(group).alias("_g"), clean(cols.elev).alias("z"), clean(cols.value).alias("v"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["v"].notna()].sort_values("station_id")
        out = vertical_profile(known["z"].to_numpy(), known["v"].to_numpy(), pdf["z"].to_numpy(), num_min_prof, min_elev_diff) if len(known) else None
        return pd.DataFrame({"station_id": pdf["station_id"], "background": out})

    return rows.groupBy("_g").applyInPandas(fit, "station_id bigint, background double").withColumnRenamed("station_id", cols.id)


def group_background(df: DataFrame, group: str, kind: BackgroundType | int | str, num_min_prof: int = 5, min_elev_diff: float = 100.0, lowest: float | None = None, highest: float | None = None, external: str | None = None, cols: Columns = DEFAULT) -> DataFrame:
    """df with `background` by the group's model, held within [lowest, highest] where these are given."""
    kind = member(BackgroundType, kind)
    if kind == BackgroundType.External:
        if external is None:
            raise ValueError("an external background needs its values")
        out = df.withColumn("background", F.col(external).cast("double"))
    elif kind == BackgroundType.VerticalProfile:
        out = df.join(vertical_profiles(df, group, num_min_prof, min_elev_diff, cols), cols.id, "left")
    elif kind == BackgroundType.VerticalProfileTheilSen:
        lines = theil_sen(df, group, num_min_prof, min_elev_diff, cols)
        out = df.join(lines, group, "left").withColumn("background", F.col("intercept") + F.col("slope") * clean(cols.elev)).drop("slope", "intercept")
    else:
        v = clean(cols.value)
        centre = F.avg(v) if kind == BackgroundType.MeanOuterCircle else F.percentile(v, F.lit(0.5))
        out = df.join(df.groupBy(group).agg(centre.alias("background")), group, "left")
    if lowest is not None:
        out = out.withColumn("background", F.greatest("background", F.lit(float(lowest))))
    if highest is not None:
        out = out.withColumn("background", F.least("background", F.lit(float(highest))))
    return out
