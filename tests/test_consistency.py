
import numpy as np
import pytest
from pyspark.sql import functions as F

from obsward.operators import background as bg
from obsward.operators import kernels
from obsward.operators.background_frame import group_background
from obsward.operators.consistency import fgt, sct, sct_dual, sct_resistant
from obsward.operators.timeseries import lag_reduction_filter
from obsward.plans.pipeline import QCPipeline
from obsward.sources import from_arrays, read_text, write_flags
from obsward.streaming import check_batches, lag_reduction_stream

SCT = {"num_min": 3, "num_max": 10, "inner_radius": 10000, "outer_radius": 10000, "num_iterations": 1, "num_min_prof": 0, "min_elev_diff": 100, "min_horizontal_scale": 10000, "vertical_scale": 200, "pos": 2, "neg": 2, "eps2": 0.5}
RESISTANT = {"num_min_outer": 3, "num_max_outer": 10, "inner_radius": 50000, "outer_radius": 50000, "num_iterations": 2, "num_min_prof": 0, "min_elev_diff": 100, "min_horizontal_scale": 10000, "max_horizontal_scale": 100000, "kth_closest": 2, "vertical_scale": 200, "mina": "mina", "maxa": "maxa", "minv": "minv", "maxv": "maxv", "eps2": 0.5, "tpos": 16, "tneg": 16}


def flags(df):
    return [r.flag for r in df.orderBy("station_id").collect()]


def test_sct(spark):
    df = from_arrays(spark, [60] * 3, [10, 10.01, 10.02], [0] * 3, None, [0, 1, 100])
    assert flags(sct(df, **SCT)) == [0, 0, 1]
    assert {"prob_gross_error", "rep"} <= set(sct(df, **SCT).columns)
    six = from_arrays(spark, [60] * 6, [10, 10, 10.01, 10.01, 10.02, 10.02], [0] * 6, None, [0, 1, 1, 1, 100, 100])
    assert flags(sct(six, **SCT | {"pos": 1, "neg": 1}, obs_to_check=F.when(F.col("station_id").isin(0, 5), 0).otherwise(1))) == [0, 0, 0, 0, 1, 0]
    assert flags(QCPipeline(df).sct(**SCT).df) == [0, 0, 1]


@pytest.mark.parametrize("change", [{"num_min": -1}, {"num_max": 2}, {"inner_radius": -1}, {"outer_radius": 1}, {"num_iterations": 0}, {"min_elev_diff": -1}, {"min_horizontal_scale": 0}, {"vertical_scale": 0}, {"pos": -1}, {"eps2": 0}])
def test_sct_arguments(spark, change):
    with pytest.raises(ValueError):
        sct(from_arrays(spark, [60], [10], [0], None, [1]), **SCT | change)


def ten(spark, more=False):
    lats, lons, elevs, v = [60.0] * 10, np.linspace(60, 60.01, 10).tolist(), np.linspace(0, 90, 10).tolist(), [0] * 8 + [0.1, 1000]
    df = from_arrays(spark, lats + [70.0] * more, lons + [30.0] * more, elevs + [0.0] * more, None, v + [1.0] * more)
    return df.withColumns({"mina": F.col("value") - 20, "maxa": F.col("value") + 20, "minv": F.col("value") - 1, "maxv": F.col("value") + 1})


def test_resistant(spark):
    assert flags(sct_resistant(ten(spark), **RESISTANT, accept_isolated=True)) == [0] * 9 + [1]
    assert flags(sct_resistant(ten(spark), **RESISTANT)) == [12, 12] + [0] * 7 + [1]
    assert flags(sct_resistant(ten(spark, True), **RESISTANT, accept_isolated=True))[10] == 0
    assert flags(sct_resistant(ten(spark, True), **RESISTANT))[10] == 12
    with pytest.raises(ValueError):
        sct_resistant(ten(spark), **RESISTANT | {"num_min_outer": 1})


def clusters(n=60, seed=3):
    r = np.random.default_rng(seed)
    at = r.integers(0, 3, n)
    lat, lon = 60 + at * 2 + r.normal(0, 0.03, n), 10 + at * 3 + r.normal(0, 0.03, n)
    value = r.normal(0, 1, n) + np.where(r.random(n) < 0.1, r.choice([-50, 50], n), 0)
    return lat, lon, r.uniform(0, 300, n), value


def whole(test, net, p):
    """One scan over all stations, without components."""
    kernel, state = kernels.TESTS[test](net, p), kernels.start(len(net["x"]))
    for k in range(p["num_iterations"]):
        if not kernel.first_pass(state, k):
            if k == 0:
                state.flags[(state.flags == -999) & net["wanted"]] = 0
            break
    kernel.last_passes(state)
    return state.flags.tolist()


@pytest.mark.parametrize("test", ["resistant", "first_guess", "dual"])
def test_rounds_over_components_equal_one_scan(spark, test):
    lat, lon, elev, value = clusters()
    a, o = np.radians(lat), np.radians(lon)
    n = len(lat)
    p = {"num_min_outer": 3, "num_max_outer": 15, "inner_radius": 5000, "outer_radius": 15000, "num_iterations": 4, "num_min_prof": 5, "min_elev_diff": 100, "min_horizontal_scale": 1000, "max_horizontal_scale": 50000, "kth_closest": 3, "vertical_scale": 300, "basic": False, "background_type": 3, "lowest": value.min() - 20, "highest": value.max() + 20, "condition": 1}
    net = {"x": np.cos(a) * np.cos(o) * 6378137, "y": np.cos(a) * np.sin(o) * 6378137, "z": np.sin(a) * 6378137, "lat": lat, "lon": lon, "elev": elev, "value": value, "wanted": np.ones(n, bool)}
    net |= {"mina": value - 20, "maxa": value + 20, "minv": value - 1, "maxv": value + 1} | {k: np.full(n, x) for k, x in (("eps2", 0.5), ("tpos", 3.0), ("tneg", 3.0), ("uncertainty", 1.0), ("event_threshold", 10.0), ("test_threshold", 0.1))}
    df = from_arrays(spark, lat.tolist(), lon.tolist(), elev.tolist(), None, value.tolist())
    common = (3, 15, 5000, 15000, 4)
    ranges = [F.col("value") + d for d in (-20, 20, -1, 1)]
    got = {
        "resistant": lambda: sct_resistant(df, *common, 5, 100, 1000, 50000, 3, 300, *ranges, 0.5, 3, 3, background_type="MedianOuterCircle"),
        "first_guess": lambda: fgt(df, *common, 5, 100, *ranges, 3, 3, background_type="MedianOuterCircle"),
        "dual": lambda: sct_dual(df, 10, "Gt", *common, 1000, 50000, 3, 300, 0.1),
    }[test]()
    expected = whole(test, net, p)
    assert flags(got) == expected and len(set(expected)) > 1
    assert flags(QCPipeline(df).merge(got.select("station_id", "flag")).df) == expected


def test_backgrounds(spark):
    z, v = np.array([0.0, 10.0]), np.array([0.0, 10.0])
    assert bg.vertical_profile(z, v, np.array([20.0]), 1, 11) == pytest.approx([5])
    z = np.linspace(0, 1000, 30)
    assert bg.vertical_profile_theil_sen(z, 20 - 0.01 * z, z, 5, 100) == pytest.approx(20 - 0.01 * z)
    assert bg.vertical_profile_theil_sen(z, 20 - 0.01 * z, z, 50, 100)[-1] - bg.vertical_profile_theil_sen(z, 20 - 0.01 * z, z, 50, 100)[0] == pytest.approx(-6.5)
    assert bg.background(z, z, "MeanOuterCircle", 5, 100, highest=400).tolist() == [400] * 30
    assert bg.nelder_mead(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, [0, 0]) == pytest.approx([3, -1], abs=0.05)
    df = from_arrays(spark, [60] * 30, [10] * 30, z.tolist(), None, (20 - 0.01 * z).tolist()).withColumn("g", F.lit(1))
    for kind in ("MeanOuterCircle", "MedianOuterCircle", "VerticalProfileTheilSen"):
        expected = bg.background(z, 20 - 0.01 * z, kind, 5, 100)
        assert [r.background for r in group_background(df, "g", kind).orderBy("station_id").collect()] == pytest.approx(expected)


def reference_filter(t, v, a=0.5, b=0.5, k1=0.25, k2=0.25, n=10):
    c, dt, out = 1 / (a * k1 + b * k2), 1 / n, v[:1]
    for i in range(1, len(v)):
        slope, r = (v[i] - v[i - 1]) / (t[i] - t[i - 1]), out[-1]
        for s in range(n):
            f = [c * ((k1 + k2) * slope + k1 * k2 * (v[i - 1] + x * dt * (v[i] - v[i - 1]) - r)) for x in (s + 1, s + 2)]
            r += dt / 2 * sum(f)
        out = [*out, r]
    return out


def test_lag_filter(spark):
    t, v = [0.0, 1.0, 2.5, 4.0, 7.0], [1.0, 2.0, 1.5, 3.0, 2.0]
    df = spark.createDataFrame([("a", x, y) for x, y in zip(t, v)] + [("b", 0.0, 5.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("d", None, 1.0)], "s string, t double, value double")  # noqa: B905
    got = lag_reduction_filter(df, "s", "t", "value").orderBy("t").collect()
    assert [r.filtered for r in got if r.s == "a"] == pytest.approx(reference_filter(t, v))
    assert [r.filtered for r in got if r.s in "bd"] == [None, 5.0] and [r.filtered for r in got if r.s == "c"] == [1.0, None]


def test_streams(spark, tmp_path):
    t, v = [0.0, 1.0, 2.5, 4.0], [1.0, 2.0, 1.5, 3.0]
    df = spark.createDataFrame([("a", x, y) for x, y in zip(t, v)], "s string, t double, value double")  # noqa: B905
    df.where("t < 2").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.where("t > 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in")
    query = lag_reduction_stream(stream, "s", "t", "value").writeStream.format("memory").queryName("lags").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.filtered for r in spark.table("lags").orderBy("t").collect()] == pytest.approx(reference_filter(t, v))
    seen = []
    query = check_batches(stream, lambda d: d.where("value > 1.9"), lambda d, k: seen.append(d.count()), f"{tmp_path}/cp")
    query.awaitTermination()
    assert sum(seen) == 2


def test_text_source_and_flag_sink(spark, tmp_path):
    (tmp_path / "x.txt").write_text("lat;lon;elev;value\n60;10;0;1\n61;11;5;\n")
    df = read_text(spark, f"{tmp_path}/x.txt")
    assert df.count() == 2 and df.where("value IS NULL").count() == 1 and df.select("station_id").distinct().count() == 2
    write_flags(df.withColumn("flag", F.lit(1)), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("flag = 1").count() == 2
