"""What grew with the square of the stations: answers against brute force, and the work that they may take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsward.operators import buddy, consistency, duplicate, isolation, regions, slopes
from obsward.operators import spatial_join as sj
from obsward.operators.background_frame import theil_sen
from obsward.operators.isolation import isolation_check
from obsward.sources import from_arrays

R = 6378137.0


def places(n, seed=5, width=2.0):
    """Latitudes and longitudes, some at one place; distances; whether at different places."""
    r = np.random.default_rng(seed)
    lat, lon = 58 + r.uniform(0, width, n), 8 + r.uniform(0, width, n)
    lat[: n // 20], lon[: n // 20] = lat[0], lon[0]
    a, o = np.radians(lat), np.radians(lon)
    at = np.column_stack([R * np.cos(a) * np.cos(o), R * np.cos(a) * np.sin(o), R * np.sin(a)])
    return lat, lon, np.sqrt(((at[:, None] - at) ** 2).sum(-1)), (at[:, None] != at).any(-1), at


def no_pairs(monkeypatch):
    def fail(*args, **options):
        raise AssertionError("neighbours are paired")

    for module in (sj, isolation, buddy, duplicate):
        if hasattr(module, "near"):
            monkeypatch.setattr(module, "near", fail)


def test_closest_in_the_plane_looks_no_further_than_needed(spark, monkeypatch):
    r = np.random.default_rng(3)
    n = 1500
    lat, lon = r.uniform(0, 5, n), r.uniform(0, 5, n)
    df = from_arrays(spark, lat.tolist(), lon.tolist())
    radii, near = [], sj.near
    monkeypatch.setattr(sj, "near", lambda q, p, radius, *more: radii.append(radius) or near(q, p, radius, *more))
    asked = df.where("station_id < 100").select(F.col("station_id").alias("query_id"), "lat", "lon")
    got = {(x.query_id, x["rank"]): x.station_id for x in sj.closest_neighbours(asked, df, 3, include_match=False, kind="Cartesian").collect()}
    d = np.hypot(lat[:, None] - lat, lon[:, None] - lon) + np.where(np.eye(n) > 0, np.inf, 0)
    assert all([got[i, k] for k in (1, 2, 3)] == np.argsort(d[i])[:3].tolist() for i in range(100))
    assert radii[0] < 0.5  # a degree found a thirtieth of all stations


def test_counts_are_made_without_pairs(spark, monkeypatch):
    no_pairs(monkeypatch)
    lat, lon, d, other, _ = places(400)
    df = from_arrays(spark, lat.tolist(), lon.tolist())
    asked = df.select(F.col("station_id").alias("query_id"), "lat", "lon", F.expr("8000D + station_id % 3 * 9000").alias("r"))
    reach = 8000 + np.arange(400) % 3 * 9000
    for match in (True, False):
        got = {x.query_id: x.n for x in sj.num_neighbours(asked, df, "r", include_match=match).collect()}
        assert [got[i] for i in range(400)] == ((d <= reach[:, None]) & (other | match)).sum(axis=1).tolist()


def test_trees_open_few_boxes():
    """Work for a query grows with the edge of its reach; a number that is enough ends it at once."""
    looked = []
    for n in (4000, 64_000):
        at = np.column_stack([np.random.default_rng(1).uniform(0, 1e5, (n, 2)), np.zeros(n)])
        tree = regions.Tree(at, np.ones((n, 1)), [])
        leaves = tree._leaves
        seen = []
        tree._leaves = lambda *args, leaves=leaves, seen=seen: seen.append(len(args[-1])) or leaves(*args)
        asked = at[:50]
        got = tree.visit(asked, np.full(50, 2e4), False)[:, 0]
        assert got.tolist() == (((asked[:, None] - at) ** 2).sum(-1) <= 4e8).sum(axis=1).tolist()
        looked.append(sum(seen) * regions.LEAF / got.sum())
        seen.clear()
        enough = tree.visit(asked, np.full(50, 2e4), False, lambda i, sure, more: sure[:, 0] >= 3)[:, 0]
        assert (enough >= 3).all() and not seen
    assert looked[1] < 0.4 * looked[0]


@pytest.mark.parametrize("vertical", [None, "v"])
def test_isolation_is_decided_without_pairs(spark, monkeypatch, vertical):
    no_pairs(monkeypatch)
    lat, lon, d, other, _ = places(400)
    elev = np.random.default_rng(8).integers(0, 2000, 400).astype(float)
    elev[7] = np.nan
    df = from_arrays(spark, lat.tolist(), lon.tolist(), elev.tolist()).withColumns({"r": F.expr("6000D + station_id % 4 * 2000"), "v": F.expr("IF(station_id % 5 = 0, NULL, 300D + station_id % 7 * 100)")})
    i = np.arange(400)
    near = (d <= (6000 + i % 4 * 2000)[:, None]) & other
    bad = np.zeros(400, bool)
    if vertical:
        near &= (i % 5 == 0)[:, None] | (np.abs(elev[:, None] - elev) <= (300 + i % 7 * 100)[:, None])
        bad = (i % 5 > 0) & np.isnan(elev)
    expected = (bad | (near.sum(axis=1) < 4)).astype(int).tolist()
    assert [r.flag for r in isolation_check(df, 4, "r", vertical).orderBy("station_id").collect()] == expected and 0 < sum(expected) < 400


def buddy_flags(value, elev, near, num_min, bad, rounds, gradient=0.0):
    flags = np.zeros(len(value), int)
    for _ in range(rounds):
        seen = flags.copy()
        for i in np.flatnonzero(seen == 0):
            j = np.flatnonzero(near[i] & (seen == 0))
            if len(j) and len(j) >= num_min[i] and bad(value[i], value[j] + (elev[i] - elev[j]) * gradient):
                flags[i] = 1
    return flags.tolist()


@pytest.mark.parametrize(("elevated", "rounds", "threshold"), [(False, 1, 2), (True, 3, 1.5), (True, 2, 2.5)])
def test_buddies_are_judged_without_pairs(spark, monkeypatch, elevated, rounds, threshold):
    no_pairs(monkeypatch)
    lat, lon, d, other, _ = places(600)
    r = np.random.default_rng(4)
    elev = r.uniform(0, 2500, 600)
    value = 20 - 0.0065 * elev * elevated + r.normal(0, 2, 600) + np.where(r.random(600) < 0.05, 15, 0)
    df = from_arrays(spark, lat.tolist(), lon.tolist(), elev.tolist(), None, value.tolist()).withColumns({"r": F.expr("20000D + station_id % 3 * 8000"), "m": F.expr("3 + station_id % 4")})
    i = np.arange(600)
    near = (d <= (20000 + i % 3 * 8000)[:, None]) & other & (~np.array(elevated) | (np.abs(elev[:, None] - elev) <= 900))

    def bad(v, w):
        return abs(v - w.mean()) > threshold * max(np.sqrt(w.var() + w.var() / len(w)), 0.5)

    got = buddy.buddy_check(df, "r", "m", threshold, 900 * elevated, -0.0065, 0.5, rounds)
    expected = buddy_flags(value, elev, near, 3 + i % 4, bad, rounds, -0.0065 * elevated)
    assert [x.flag for x in got.orderBy("station_id").collect()] == expected and 5 < sum(expected) < 300


@pytest.mark.parametrize("elevated", [False, True])
@pytest.mark.parametrize("threshold", [0.2, 3])
def test_events_are_judged_without_pairs(spark, monkeypatch, elevated, threshold):
    no_pairs(monkeypatch)
    lat, lon, d, other, _ = places(500)
    r = np.random.default_rng(6)
    elev, value = r.uniform(0, 2500, 500), r.normal(18 if elevated else 21, 2, 500)
    df = from_arrays(spark, lat.tolist(), lon.tolist(), elev.tolist(), None, value.tolist())
    near = (d <= 22_000) & other & (~np.array(elevated) | (np.abs(elev[:, None] - elev) <= 1500))

    def bad(v, w):
        alike = (w < 20).sum() if v < 20 else (w >= 20).sum()
        return alike <= threshold if threshold >= 1 else alike / len(w) <= threshold

    got = buddy.buddy_event_check(df, 22_000.0, 4, 20, threshold, 1500 * elevated, -0.0035, 2)
    expected = buddy_flags(value, elev, near, np.full(500, 4), bad, 2, -0.0035 * elevated)
    assert [x.flag for x in got.orderBy("station_id").collect()] == expected and 0 < sum(expected) < 400


def test_buddies_are_decided_from_few_points(monkeypatch):
    """What is looked at for a station grows less than its neighbours."""
    looked, leaves = [], regions.Tree._leaves
    monkeypatch.setattr(regions.Tree, "_leaves", lambda self, *args: looked.append(len(args[-1])) or leaves(self, *args))
    r = np.random.default_rng(2)
    for n in (2000, 32_000):
        at = np.column_stack([r.uniform(0, 1e5, (n, 2)), np.zeros(n)])
        sums = np.column_stack([np.ones(n), r.normal(0, 1, (n, 1))])
        got = regions.Tree(at, sums, []).visit(at[:100], np.full(100, 3e4), True, lambda i, sure, more: more[:, 0] < 0.3 * sure[:, 0])
        assert (got[:, 0] > 0).all()
    assert sum(looked) < 100 * 32_000 // 100


@pytest.mark.parametrize("kind", ["steps", "fine", "near", "line", "level"])
def test_median_slope_without_pairs(monkeypatch, kind):
    """Of all pairs, of which a twentieth may be made at once."""
    monkeypatch.setattr(slopes, "MADE", 50_000)
    r = np.random.default_rng(1)
    n = 1500
    z = {"steps": lambda: r.integers(0, 2500, n).astype(float), "near": lambda: r.uniform(0, 4, n)}.get(kind, lambda: r.uniform(0, 2500, n))()
    v = {"line": lambda: 2 * z, "level": lambda: np.zeros(n)}.get(kind, lambda: np.round(30 - 0.0065 * z + r.uniform(-1, 10, n), 2))()
    i, j = np.triu_indices(n, 1)
    dz = z[i] - z[j]
    far = np.abs(dz) >= 1
    assert slopes.median_slope(z, v) == pytest.approx(np.median(np.where(far, (v[i] - v[j]) / np.where(far, dz, 1), 0)), abs=1e-13)


def test_theil_sen_of_a_large_group(spark):
    """Of 450 million pairs."""
    df = spark.range(30_000).selectExpr("id AS station_id", "1 AS g", "CAST(id * 31 % 2500 AS DOUBLE) AS elev", "20 - 0.01D * (id * 31 % 2500) + IF(id % 10 = 0, 50D, 0D) AS value")
    row = theil_sen(df, "g", 5, 100).first()
    assert row.slope == pytest.approx(-0.01, abs=1e-12) and row.intercept == pytest.approx(20, abs=1e-9)


@pytest.mark.parametrize("vertical", [None, 300.0])
def test_duplicates_are_found_without_pairs(spark, monkeypatch, vertical):
    """Over several tiles, so that stations wait for others beyond an edge."""
    no_pairs(monkeypatch)
    monkeypatch.setattr(sj, "TILE", 20)
    lat, lon, d, _, _ = places(500)
    elev = np.random.default_rng(8).integers(0, 1000, 500).astype(float)
    near = (d <= 9000) & (np.abs(elev[:, None] - elev) <= (vertical or 9e9))
    kept = []
    for i in range(500):
        if not near[i, kept].any():
            kept.append(i)
    got = duplicate.duplicate_check(from_arrays(spark, lat.tolist(), lon.tolist(), elev.tolist()), 9000.0, vertical)
    assert [r.flag for r in got.orderBy("station_id").collect()] == [int(i not in kept) for i in range(500)]


@pytest.mark.parametrize("test", ["sct", "resistant", "first_guess", "dual"])
def test_consistency_over_tiles_equals_one_scan(spark, monkeypatch, test):
    """One network without gaps, in tiles whose stations depend on each other."""
    n = 700
    lat, lon, _, _, _ = places(n)
    r = np.random.default_rng(3)
    value = r.normal(0, 1, n) + np.where(r.random(n) < 0.08, 30, 0)
    df = from_arrays(spark, lat.tolist(), lon.tolist(), r.uniform(0, 300, n).tolist(), None, value.tolist())
    ranges = [F.col("value") + d for d in (-20, 20, -1, 1)]
    common = (3, 5, 8000, 15000, 2)

    def flags():
        got = {
            "sct": lambda: consistency.sct(df, 3, 5, 8000, 15000, 3, -1, 100, 1000, 200, 2, 2, 0.5),
            "resistant": lambda: consistency.sct_resistant(df, *common, 5, 100, 1000, 50000, 3, 300, *ranges, 0.5, 3, 3, background_type="MedianOuterCircle"),
            "first_guess": lambda: consistency.fgt(df, *common, 5, 100, *ranges, 3, 3, background_type="MedianOuterCircle"),
            "dual": lambda: consistency.sct_dual(df, 10, "Gt", *common, 1000, 50000, 3, 300, 0.1),
        }[test]()
        return [x.flag for x in got.orderBy("station_id").collect()]

    expected = flags()
    tiles, tiled = [], consistency.tiled
    monkeypatch.setattr(consistency, "SERIAL", 10)
    monkeypatch.setattr(consistency, "STEPS", 1)
    monkeypatch.setattr(sj, "TILE", 50)
    monkeypatch.setattr(consistency, "tiled", lambda *args, **options: tiles.append(args[2]) or tiled(*args, **options))
    assert flags() == expected and len(set(expected)) > 1 and tiles
