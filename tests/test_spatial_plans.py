"""The spatial plans against plain loops: nothing multiplies a raster or pairs everything with everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.functions import solar, wind
from terragrid.operators import raster, spatial
from terragrid.plans import resource

from test_operators import array, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_least_by_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        at, x = np.sort(rng.choice(60, rng.integers(1, 40), replace=False)), np.sort(rng.choice(60, rng.integers(1, 20), replace=False))
        height = rng.integers(0, 400, len(x)) * 1000 + rng.integers(0, 1000, len(x))
        want = (1000 * (at[:, None] - x) ** 2 + height).min(axis=1)
        assert raster.least_by_distance(at, x, height, 1000).tolist() == want.tolist()


@pytest.mark.parametrize("tile", [4, 64])
def test_tiles_of_any_size(spark, tile):
    a = np.random.default_rng(3).integers(0, 4, (15, 11)).astype(float)
    got = array(raster.half_cell_shift(table(spark, a), tile=tile), a.shape)
    want = np.full(a.shape, np.nan)
    want[:-1, :-1] = (a[:-1, :-1] + a[1:, :-1] + a[:-1, 1:] + a[1:, 1:]) / 4
    assert np.allclose(got, want, equal_nan=True)
    pairs = {(r["r1"], r["r2"]) for r in raster.adjacency(table(spark, a.astype(int), "region", "int"), tile=tile).collect()}
    want = {(a[i, j], a[k, m]) for i in range(15) for j in range(11) for k in range(15) for m in range(11) if abs(i - k) <= 1 and abs(j - m) <= 1 and a[i, j] > 0 and a[k, m] > 0}
    assert pairs == want


def test_cubic_gives_parabolas_back(spark):
    x = np.arange(12.0)
    a = (x**2)[:, None] + 3 * x[None, :] + 1
    got = array(raster.bicubic(table(spark, a), 4, 12, 12), (48, 48))
    place = (np.arange(48) + 0.5) / 4 - 0.5
    want = (place**2)[:, None] + 3 * place[None, :] + 1
    assert np.allclose(got[8:-8, 8:-8], want[8:-8, 8:-8])


def test_downscaled_keeps_totals(spark):
    a = np.random.default_rng(5).random((9, 7)) * (np.random.default_rng(6).random((9, 7)) > 0.4)
    got = array(raster.downscaled(table(spark, a), 3, 9, 7), (27, 21))
    assert (got >= 0).all() and np.allclose(got.reshape(9, 3, 7, 3).sum(axis=(1, 3)), a)


def test_resized(spark):
    a = np.random.default_rng(7).random((10, 6))
    got = array(raster.resized(table(spark, a), 10, 6, 4, 3), (4, 3))
    wide = a.repeat(4, axis=0).repeat(3, axis=1).reshape(4, 10, 3, 6)
    assert np.allclose(got, wide.mean(axis=(1, 3)))


def test_holes_and_parts(spark):
    rings = [(1, [(0.0, 0.0), (10.0, 0.0), (10.0, -10.0), (0.0, -10.0)]), (1, [(3.0, -3.0), (7.0, -3.0), (7.0, -7.0), (3.0, -7.0)]), (1, [(12.0, -1.0), (14.0, -1.0), (14.0, -2.0), (12.0, -2.0)]), (2, [(0.0, 0.0), (20.0, 0.0), (5.0, -20.0)])]
    polygons = spark.createDataFrame(rings, "poly_id int, ring array<struct<x: double, y: double>>")

    def crossed(x, y, ring):
        return sum((b != d) and ((b > y) != (d > y)) and x < a + (y - b) * (c - a) / (d - b) for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True))

    def first(x, y):
        return next((p for p in (1, 2) if sum(crossed(x, y, r) for q, r in rings if q == p) % 2), 0)

    got = {(r["lon_idx"], r["lat_idx"]): r["poly_id"] for r in spatial.rasterized(polygons, 0.5, 0.0, 0.0).collect()}
    want = {(i, j): first((i - 0.5) / 2, -(j - 0.5) / 2) for i in range(1, 45) for j in range(1, 45)}
    assert got == {k: p for k, p in want.items() if p}
    points = spark.createDataFrame([(k, float(x) + 0.13, -float(y) - 0.17) for k, (x, y) in enumerate((x, y) for x in range(20) for y in range(20))], "point_id int, x double, y double")
    for r in spatial.point_in_polygons(points, polygons, 4.0).collect():
        assert r["poly_id"] == first(r["x"], r["y"])


@pytest.mark.parametrize("cell", [0.7, 5.0, 400.0])
def test_nearest_of_any_number(spark, cell):
    rng = np.random.default_rng(4)
    sites = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([rng.normal((40, 20), 2, (150, 2)), rng.normal((-90, 50), 1, (60, 2)), [(0.0, 0.0), (0.0, 0.0)]]))]
    points = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([rng.uniform((-180, -90), (180, 90), (120, 2)), rng.normal((40, 20), 3, (60, 2))]))]
    p, s = spark.createDataFrame(points, "point_id long, lon double, lat double"), spark.createDataFrame(sites, "site_id long, lon double, lat double")
    got = {r["point_id"]: (r["site_id"], r["km"]) for r in spatial.nearest_few(p, s, "point_id", "site_id", cell).collect()}
    for k, x, y in points:
        km, site = min((111.0 * math.hypot(x - a, y - b), i) for i, a, b in sites)
        assert got[k][0] == site and got[k][1] == pytest.approx(km)
    assert {r["site_id"] for r in spatial.nearest_few(p, s.limit(0), "point_id", "site_id", cell).collect()} == {None}


def test_no_pixel_meets_an_hour(spark):
    """With a factor per pixel, the plan joins no rows with hours: cells meet their weights in one group each."""
    px = spark.createDataFrame([("t", 1 + k % 2, 1, k % 3, 1.0 + k / 7) for k in range(40)] + [("t", 1, 1, 9, None)], "tech string, region int, class int, era_lon int, f double")
    cells = spark.createDataFrame([(c, h, 3.0 + c + h if h != 2 else None) for c in (0, 1, 2, 5) for h in range(5)], "era_lon int, hour int, value double")
    df = resource.hourly(px, cells, F.col("f"), wind.capacity_factor, ["era_lon"])
    assert "Join" not in plan(df) and "FlatMapCoGroupsInArrow" in plan(df)
    got = {(r["region"], r["hour"]): r["cf"] for r in df.collect()}
    want = px.join(cells, "era_lon").where("value is not null and f is not null").groupBy("region", "hour").agg(F.avg(wind.capacity_factor(F.col("value") * F.col("f"))).alias("cf")).collect()
    assert len(got) == len(want) == 8 and all(got[(r["region"], r["hour"])] == pytest.approx(r["cf"]) for r in want)


def test_sun_positions_agree(spark):
    rows = [(f"20{20 + k}-{1 + k % 12:02d}-11 {(5 * k) % 24:02d}:20:00", -60.0 + 9 * k, -170.0 + 27 * k) for k in range(12)]
    df = spark.createDataFrame(rows, "t string, lat double, lon double").select(F.col("t").cast("timestamp_ntz").alias("t"), "lat", "lon")
    args = [F.col(c) for c in ("t", "lat", "lon")]
    for r in df.select(solar.sun_position(*args).alias("a"), solar.sun_position_almanac(*args).alias("b"), solar.sun_position_mean(*args).alias("c")).collect():
        assert abs(r["a"]["declination"] - r["b"]["declination"]) < 0.02 and abs(r["a"]["zenith"] - r["b"]["zenith"]) < 0.05
        assert abs(r["a"]["declination"] - r["c"]["declination"]) < 1 and abs(r["a"]["zenith"] - r["c"]["zenith"]) < 1.5


def test_staged_irradiance_is_the_same(spark):
    rows = [(k, f"2024-{1 + k % 12:02d}-03 {k % 24:02d}:00:00", -70.0 + 6 * k, -180.0 + 13 * k, 1e6 * (k % 4), 6e5 * (k % 4)) for k in range(24)]
    df = spark.createDataFrame(rows, "k int, t string, lat double, lon double, ssrd double, fdir double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    x = solar.irradiance(F.col("ssrd"), F.col("fdir"), F.col("ts"), F.col("lat"), F.col("lon"))
    a = {r["k"]: (r["gti"], r["dni"]) for r in df.select("k", x.gti.alias("gti"), x.dni.alias("dni")).collect()}
    b = {r["k"]: (r["gti"], r["dni"]) for r in solar.with_irradiance(df, "ssrd", "fdir").collect()}
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_distances_are_dealt_to_many_tasks(spark):
    rows = [(k, float(k * 53 % 180) - 89.5, float(k * 37 % 360) - 179.5) for k in range(300)] + [(1000 + k, 10.5, 20.5) for k in range(40)] + [(7, 1.0, 2.0), (7, 1.0, 2.0), (None, 1.0, 2.0)]
    out = spatial.distances(spark.createDataFrame(rows, "region long, lat double, lon double"))
    got = [tuple(r) for r in out.collect()]

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return round(2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0))), 3)

    assert sorted((str(a), str(b), round(x, 3)) for a, b, x in got) == sorted((str(a[0]), str(b[0]), km(a, b)) for a in rows for b in rows)
    assert out.select(F.spark_partition_id().alias("t")).distinct().count() >= 16
