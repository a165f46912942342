"""Operators on small grids against numpy and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.operators import raster, regions, spatial
from terragrid.plans import demand, hydro, resource, turbines
from terragrid.sources import tables


def table(spark, a, name="value", kind="double"):
    return spark.createDataFrame([(i + 1, j + 1, a[i, j].item()) for i in range(a.shape[0]) for j in range(a.shape[1])], f"lon_idx int, lat_idx int, {name} {kind}")


def array(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["lon_idx"] - 1, r["lat_idx"] - 1] = r[name]
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).random((23, 17))


@pytest.mark.parametrize("radius", [0.4, 1.0, 2.5, 4.2])
def test_kernel(radius):
    k = raster.disk_kernel(radius)
    assert k.sum() == pytest.approx(1) and np.allclose(k, k.T) and np.allclose(k, k[::-1])
    assert k.max() == pytest.approx(1 / (np.pi * radius**2), rel=1e-9) or radius < 1.5


@pytest.mark.parametrize("tile", [5, 64])
def test_disk_mean(spark, noise, tile):
    k = raster.disk_kernel(2.3)
    n = len(k) // 2
    padded = np.pad(noise, n, mode="edge")
    want = sum(k[a, b] * padded[a : a + 23, b : b + 17] for a in range(len(k)) for b in range(len(k)))
    assert np.allclose(array(raster.disk_mean(table(spark, noise), 2.3, 23, 17, tile), noise.shape), want)
    assert np.allclose(array(raster.disk_mean_small(table(spark, noise), 2.3, 23, 17), noise.shape), want)


def test_bilinear(spark, noise):
    got = array(raster.bilinear(table(spark, noise), 2, 23, 17), (46, 34))
    padded = np.pad(noise, 1, mode="edge")
    for i, j in [(0, 0), (5, 7), (45, 33), (20, 1)]:
        x, y = (i + 0.5) / 2 - 0.5 + 1, (j + 0.5) / 2 - 0.5 + 1
        a, b = int(np.floor(x)), int(np.floor(y))
        u, v = x - a, y - b
        want = (1 - u) * (1 - v) * padded[a, b] + u * (1 - v) * padded[a + 1, b] + (1 - u) * v * padded[a, b + 1] + u * v * padded[a + 1, b + 1]
        assert got[i, j] == pytest.approx(want)


def test_nearest_fill(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((19, 14)) < 0.06, rng.integers(1, 5, (19, 14)), 0)
    a[3, 3] = 32767
    got = array(raster.nearest_fill(table(spark, a, "region", "int")), a.shape, "region")
    seeds = np.argwhere(a > 0)
    for i in range(19):
        for j in range(14):
            d = ((seeds - (i, j)) ** 2).sum(axis=1)
            assert got[i, j] == min(a[tuple(s)] for s, x in zip(seeds, d, strict=True) if x == d.min())
    assert (array(raster.nearest_fill(table(spark, np.zeros((3, 3), int), "region", "int")), (3, 3), "region") == 0).all()


def test_adjacency(spark):
    a = np.array([[1, 1, 0, 2], [1, 0, 0, 2], [0, 3, 3, 0], [32767, 0, 0, 2]])
    got = {tuple(r) for r in raster.adjacency(table(spark, a, "region", "int")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (1, 3), (3, 1), (2, 3), (3, 2)}


def test_sums_are_kept(spark, noise):
    assert raster.block_sum(table(spark, noise[:20, :16]), 4, 20, 16).agg(F.sum("value")).first()[0] == pytest.approx(noise[:20, :16].sum())


def test_mode(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (1, 2), (2, 0), (2, 0), (2, 5), (3, 0)], "cell int, region int")
    assert {tuple(r) for r in raster.mode_by(df, ["cell"], "region").collect()} == {(1, 2), (2, 0), (3, 0)}
    assert {tuple(r) for r in raster.mode_by(df, ["cell"], "region", skip=True).collect()} == {(1, 2), (2, 5), (3, 0)}


def test_population_centres(spark):
    a = np.zeros((10, 10))
    a[2, 2], a[2, 3], a[7, 7] = 9, 8, 5
    df = table(spark, a, "population").withColumn("region", F.lit(1))
    got = [(r["lon_idx"], r["lat_idx"]) for r in raster.population_centres(df, 3, 3.3).orderBy("centre").collect()]
    # three centres only fit when the distance has been halved twice
    assert got == [(3, 3), (3, 4), (8, 8)]
    got = [(r["lon_idx"], r["lat_idx"]) for r in raster.population_centres(df, 2, 3.3).orderBy("centre").collect()]
    assert got == [(3, 3), (8, 8)]


def test_polygons(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    inner = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    polys = spark.createDataFrame([(1, inner), (2, square)], "poly_id int, ring array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([(1, 1.5, 1.5), (2, 3.0, 3.0), (3, 5.0, 1.0), (4, -0.1, 0.0)], "point_id int, x double, y double")
    got = {r["point_id"]: r["poly_id"] for r in spatial.point_in_polygons(pts, polys, 1.5).collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 0}


def test_nearest(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(60)]
    sites = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(25)] + [(90, 0.0, 0.0), (91, 0.0, 0.0)]
    p, s = spark.createDataFrame(pts, "p long, lon double, lat double"), spark.createDataFrame(sites, "s long, lon double, lat double")
    best = {i: min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in sites) for i, x, y in pts}
    assert {r["p"]: r["s"] for r in spatial.nearest_few(p, s, "p", "s").collect()} == {i: k for i, (_, k) in best.items()}
    got = {r["p"]: r["s"] for r in spatial.nearest_within(p, s, "p", "s", 2.0).collect()}
    assert got == {i: (k if d < 4 else None) for i, (d, k) in best.items()}
    with pytest.raises(ValueError):
        spatial.few(p, 10)


def test_region_sets(spark):
    land = np.array([[1, 1, 0, 0], [1, 1, 0, 0], [1, 1, 1, 1]])
    region = np.array([[1, 1, 0, 0], [1, 0, 0, 0], [2, 2, 2, 2]])
    rows = [(i + 1, j + 1, int(region[i, j]), 7, int(land[i, j])) for i in range(3) for j in range(4)]
    px = spark.createDataFrame([(i, j, r, 0 if land_ == 0 else a, land_) for i, j, r, a, land_ in rows], "lon_idx int, lat_idx int, region int, admin_uid int, land int")
    got = {(r["lon_idx"], r["lat_idx"]): (r["region"], r["offshore"]) for r in regions.saved_regions(px).collect()}
    assert got[(2, 2)] == (32767, 0) and got[(1, 3)] == (0, 1) and got[(2, 4)] == (0, 2) and got[(3, 1)] == (2, 0)
    graph = regions.greedy_colours([(1, 2), (2, 3), (1, 3)], [1, 2, 3, 4], 3)
    assert len({graph[k] for k in (1, 2, 3)}) == 3


def test_painted_codes_stay(spark):
    defs = regions.definitions(spark, [("a", regions.Admin(("X",))), ("b", regions.Statistical(("Y1",))), ("c", (regions.Admin(("Z",), ("Z1",)), regions.Admin(("Z", "Z2"), ("Z3",))))])
    admin = spark.createDataFrame([(1, "X", "p", None), (2, "Z", "Z1", None), (3, "Z", "Z2", "Z3"), (4, "Z", "Z9", None), (78413, "X", None, None)], "uid int, n0 string, n1 string, n2 string")
    codes = spark.createDataFrame([(5, "Y123"), (6, "Y2")], "uid int, code string")
    px = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 1, 5), (1, 3, 2, 6), (1, 4, 3, 0), (1, 5, 4, 0), (1, 6, 78413, 0)], "lon_idx int, lat_idx int, admin_uid int, code_uid int")
    got = {r["lat_idx"]: r["region"] for r in regions.painted(px, admin, codes, defs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 0, 6: 0}


def test_hourly_weights_equal_pixels(spark):
    """Aggregating pixels before the hours changes nothing."""
    from terragrid.functions import wind

    px = spark.createDataFrame([("t", 1, 1, 1, 1.0 + k % 3) for k in range(10)] + [("t", 1, 1, 2, 2.0)], "tech string, region int, class int, era_lon int, f double")
    cells = spark.createDataFrame([(c, h, 3.0 + c + h) for c in (1, 2) for h in range(4)], "era_lon int, hour int, value double")
    got = {r["hour"]: r["cf"] for r in resource.hourly(px, cells, F.col("f"), wind.capacity_factor, ["era_lon"]).collect()}
    plain = px.join(cells, "era_lon").groupBy("hour").agg(F.avg(wind.capacity_factor(F.col("value") * F.col("f"))).alias("cf"))
    assert all(got[r["hour"]] == pytest.approx(r["cf"]) for r in plain.collect())


def test_shift_round_trip(spark):
    s = spark.createDataFrame([(1, h, float(h)) for h in range(24)], "region int, hour long, value double")
    there = demand.shifted(s, ["region"], F.lit(5.5), 24)
    back = demand.shifted(there, ["region"], -F.lit(5.5), 24)
    assert {r["hour"]: r["value"] for r in back.collect()} == {h: float(h) for h in range(24)}
    assert {r["hour"] for r in there.where("value = 0").collect()} == {6}


def test_hydro(spark):
    plants = spark.createDataFrame([("a", 453015.0, 1203000.0), ("b", 120.0, 45.0), ("c", 10.0, 20.0)], "n string, lat double, lon double")
    got = {r["n"]: (round(r["lat"], 4), round(r["lon"], 4)) for r in hydro.repaired(plants).collect()}
    assert got == {"a": (45.5042, 120.5), "b": (45.0, 120.0), "c": (10.0, 20.0)}


def test_turbine_tables(spark):
    px = spark.createDataFrame([(1, 0.5), (2, 3.0)], "pixel_id int, popdens double").withColumn("area_km2", F.lit(1.0))
    t = spark.createDataFrame([(1, 2000.0, 1995), (1, 1000.0, 1999)], "pixel_id int, capac_kw double, yr int")
    got = {r["pixel_id"]: tuple(r)[3:] for r in turbines.pixel_table(px, t).collect()}
    assert got == {1: (2, 1999, 3000.0), 2: (0, 0, 0.0)}


def test_sources(spark, tmp_path):
    cf = spark.createDataFrame([("PV", "R1", 1, h, 0.5 * h) for h in range(3)], "tech string, region_name string, class int, hour int, cf double")
    assert [r["value"] for r in tables.model_lines(cf).collect()] == ["R1  . PV1  . h0002   0.500000", "R1  . PV1  . h0003   1.000000"]
    long = spark.createDataFrame([(1, 1, h, float(h)) for h in range(4)], "era_lon int, era_lat int, hour int, value double")
    tables.series(long, ["era_lon", "era_lat"]).withColumn("year", F.lit(2018)).write.parquet(str(tmp_path / "cells"))
    assert sorted(tuple(r) for r in tables.hourly(spark, str(tmp_path / "cells"), 2018).collect()) == sorted(tuple(r) for r in long.collect())
    grid = tmp_path / "g.asc"
    grid.write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9\n1 2\n-9 4\n")
    assert {(r["lon_idx"], r["lat_idx"]): r["value"] for r in tables.ascii_grid(spark, str(grid)).collect()} == {(1, 1): 1.0, (2, 1): 2.0, (1, 2): None, (2, 2): 4.0}
    shape = tmp_path / "p.json"
    shape.write_text('{"features": [{"properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}')
    assert tables.geojson(spark, str(shape)).first()["ring"][1]["x"] == 1.0
    (tmp_path / "d.csv").write_text("country,demand\nNorway,1000\nWORLD,9\n")
    known = spark.createDataFrame([("Norway",)], "country string")
    assert [tuple(r) for r in tables.national_demand(spark, str(tmp_path / "d.csv"), known).collect()] == [("Norway", 1.0)]
    with pytest.raises(ValueError):
        tables.national_demand(spark, str(tmp_path / "d.csv"), known.limit(0))
    first = tables.write_if_absent(known, str(tmp_path / "once"))
    assert tables.write_if_absent(known.limit(0), str(tmp_path / "once")).count() == first.count() == 1
    box = spark.createDataFrame([(i, j, 1) for i in range(1, 361) for j in (1, 90, 180)], "lon_idx int, lat_idx int, value int")
    box.write.parquet(str(tmp_path / "r"))
    assert tables.raster(spark, str(tmp_path / "r"), (170, -5, -170, 5), 1.0).count() == 20
    assert tables.simulations(spark, [("s", "o", "m")], [2000, 2050], ["rcp45", "rcp85"]).count() == 3
