"""Sources and sinks: GeoTIFF, GeoJSON, workbooks, catalogues; and a whole run over a small folder."""

import json
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid import catalogue
from terragrid.operators import regions
from terragrid.options import SolarOptions, WindOptions, with_options
from terragrid.plans import demand, entry
from terragrid.sources import geotiff, tables
from terragrid.sources.tables import Data

from test_operators import array, table


def test_geotiff_round_trip(spark, tmp_path):
    a = np.random.default_rng(1).random((13, 9)).round(3)
    path = str(tmp_path / "tiffs")
    assert geotiff.write(table(spark, a), path, 0.5, tile=5) == 6
    got = array(geotiff.read(spark, path), a.shape)
    assert np.allclose(got, a, atol=1e-6)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_geotiff_strips(spark, tmp_path, order, packed):
    """Strips of two rows, either byte order, whole numbers with the predictor and a value for nothing."""
    a = np.arange(35, dtype=np.int16).reshape(5, 7) * 3 % 50
    rows = [a[k : k + 2] for k in range(0, 5, 2)]
    if packed:
        rows = [np.diff(r, axis=1, prepend=0) for r in rows]
    strips = [r.astype(f"{order}i2").tobytes() for r in rows]
    strips = [zlib.compress(s) for s in strips] if packed else strips
    at, body = [], b""
    for s in strips:
        at.append(8 + len(body))
        body += s + b"\0" * (len(s) % 2)
    fields = [(256, 3, [7]), (257, 3, [5]), (258, 3, [16]), (259, 3, [8 if packed else 1]), (273, 4, at), (278, 3, [2]), (279, 4, [len(s) for s in strips]), (317, 3, [2 if packed else 1]), (339, 3, [2]), (33550, 12, [1.0, 1.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 10.0, 20.0, 0.0]), (42113, 2, b"12\0")]
    start, entries, extra = 8 + len(body), b"", b""
    after = start + 2 + 12 * len(fields) + 4
    for tag, kind, v in fields:
        raw = v if kind == 2 else struct.pack(f"{order}{len(v)}{geotiff.FIELDS[kind][1]}", *v)
        entries += struct.pack(f"{order}HHI", tag, kind, len(v))
        if len(raw) > 4:
            entries += struct.pack(f"{order}I", after + len(extra))
            extra += raw
        else:
            entries += raw.ljust(4, b"\0")
    data = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, start) + body + struct.pack(f"{order}H", len(fields)) + entries + b"\0" * 4 + extra
    (tmp_path / "a.tif").write_bytes(data)
    got = {(r["lon_idx"], r["lat_idx"]): r["value"] for r in geotiff.read(spark, str(tmp_path / "a.tif")).collect()}
    assert got == {(i + 191, j + 71): float(a[j, i]) for i in range(7) for j in range(5) if a[j, i] != 12}


def test_geojson_parts_and_holes(spark, tmp_path):
    square = lambda x, n: [[x, 0.0], [x + n, 0.0], [x + n, n], [x, n]]
    shapes = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": [square(0.0, 9.0), square(1.0, 2.0)]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(20.0, 1.0)], [square(30.0, 5.0), square(31.0, 1.0)]]}},
    ]}
    (tmp_path / "s.json").write_text(json.dumps(shapes))
    got = [(r["poly_id"], r["properties"]["name"], r["ring"][0]["x"], len(r["ring"])) for r in tables.geojson(spark, str(tmp_path / "s.json")).collect()]
    assert sorted(got) == [(1, "a", 0.0, 4), (1, "a", 1.0, 4), (3, "c", 20.0, 4), (3, "c", 30.0, 4), (3, "c", 31.0, 4)]


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    df = spark.createDataFrame([(1, 2.5, "a & <b>"), (2, None, None)], "k int, v double, s string")
    tables.write_workbook({"2000-2004": df, "2005": df.limit(0)}, path)
    with zipfile.ZipFile(path) as z:
        one, two, book = (z.read(n).decode() for n in ("xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml", "xl/workbook.xml"))
    assert re.findall(r"<row>", one) == ["<row>"] * 3 and "<v>2.5</v>" in one and "a &amp; &lt;b&gt;" in one and "<c/>" in one
    assert two.count("<row>") == 1 and 'name="2000-2004"' in book
    with pytest.raises(ValueError):
        tables.write_workbook({"x": df}, path, 1)


def test_catalogue(spark):
    assert {len(catalogue.SETS[n]) for n in ("Europe8", "europe8")} == {8} and len(catalogue.SETS["europe13"]) == 13 and len(catalogue.SETS["syntheticdemandregions"]) == 44
    assert SolarOptions().gisregion in catalogue.SETS and WindOptions().gisregion in catalogue.SETS
    defs = regions.definitions(spark, catalogue.SETS["china6"])
    assert {r["n1"] for r in defs.where("name = 'CH_N'").collect()} == {"Beijing", "Tianjin", "Hebei", "Shanxi", "Nei Mongol"}
    two = catalogue.chosen(defs, [5, 1]).orderBy("region").select("region", "name").distinct().collect()
    assert {(r["region"], r["name"]) for r in two} == {(1, "CH_SW"), (2, "CH_N")}
    places = spark.createDataFrame([("B", "x"), ("A", "y"), ("B", "z"), ("", "")], "n0 string, n1 string")
    assert [(r["region"], r["name"]) for r in catalogue.each_country(places).orderBy("region").collect()] == [(1, "A"), (2, "B")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A country of two provinces and a neighbour on 60 by 40 pixels of a quarter of a degree around the equator."""
    d = str(tmp_path_factory.mktemp("data"))
    cells = spark.range(60 * 40).select((F.col("id") % 60 + 1).cast("int").alias("lon_idx"), (F.floor(F.col("id") / 60) + 1).cast("int").alias("lat_idx"))
    land = (F.col("lon_idx").between(6, 50) & F.col("lat_idx").between(4, 30)).alias("is_land")
    uid = F.when(~land, 0).when(F.col("lon_idx") <= 20, 1).when(F.col("lon_idx") <= 36, 2).otherwise(3)
    k = F.col("lon_idx") * 7 + F.col("lat_idx") * 13
    cells.select("lon_idx", "lat_idx", uid.alias("admin_uid"), F.lit(0).alias("code_uid"), F.when(land, 10).otherwise(0).alias("land"), uid.alias("country")).write.parquet(f"{d}/places")
    cells.select("lon_idx", "lat_idx", F.when(land, 7 + k % 5).otherwise(0).alias("land"), (k % 11).alias("protected"), (k % 400).cast("double").alias("popdens"), (k % 90 * 10).cast("double").alias("population"), (k % 23 == 0).cast("double").alias("gridaccess"), F.when(land, 100.0).otherwise(-20.0).alias("topo"), (4.0 + k % 6).alias("atlas"), (0.1 + k % 10 / 50).alias("mean_gti"), (0.1 + k % 10 / 40).alias("mean_dni"), (k % 77 * 1000).cast("double").alias("gdp")).write.parquet(f"{d}/layers")
    cells.select("lon_idx", "lat_idx", F.when(F.col("lon_idx") < 30, "UTC").otherwise("Asia/Kolkata").alias("tz")).write.parquet(f"{d}/zones")
    spark.createDataFrame([(1, "Home", "West", None), (2, "Home", "East", None), (3, "Abroad", "", None)], "uid int, n0 string, n1 string, n2 string").write.parquet(f"{d}/admin_names")
    spark.createDataFrame([(1, "XX1")], "uid int, code string").write.parquet(f"{d}/code_names")
    spark.createDataFrame([(k, 2.0 + k, 1.5) for k in (1, 2, 3)], "country int, demand_percapita double, multiplier double").write.parquet(f"{d}/national")
    era = spark.range(1, 5).select(F.col("id").cast("int").alias("era_lon")).crossJoin(spark.range(1, 4).select(F.col("id").cast("int").alias("era_lat")))
    for kind, base in (("wind", 6.0), ("gti", 0.2), ("dni", 0.25), ("temp", 15.0)):
        rows = era.crossJoin(spark.createDataFrame([(2017,), (2018,)], "year int"))
        series = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda h: F.lit(base) * (1 + F.sin(h + F.col("era_lon") + F.col("year")) / 3))
        rows.select("era_lon", "era_lat", "year", series.alias("series")).withColumn("mean", F.aggregate("series", F.lit(0.0), lambda a, b: a + b) / 48).write.parquet(f"{d}/cells/{kind}")
    spark.createDataFrame([(k, 88.0 - k, -174.0 + k, k % 2 + 1, 100.0 * k) for k in range(1, 6)], "plant_id int, lat double, lon double, country int, capacity_mw double").write.parquet(f"{d}/power_plants")
    spark.createDataFrame([(1, 86.0, -172.0, [1.0 + k for k in range(12)])], "site_id int, lat double, lon double, profile array<double>").write.parquet(f"{d}/hydro_existing")
    spark.createDataFrame([(1, 900.0, 2500.0), (2, 500.0, 1500.0)], "country int, capacity_mw double, generation_gwh double").write.parquet(f"{d}/national_hydro")
    spark.createDataFrame([(k, 87.0 - k / 3, -175.0 + k, 0.05, 30.0 + k, 2000.0, 1 + k % 2, 10.0 * k, [5.0 + k + m for m in range(12)]) for k in range(1, 7)], "site_id int, lat double, lon double, coe double, production_gwh double, capcost double, system int, volume_mm3 double, flow array<double>").write.parquet(f"{d}/hydro_potential")
    return Data(d)


def test_whole_run(spark, folder):
    """Every step runs, and wind agrees with a plain computation over the same layers."""
    from terragrid.functions import grid, wind
    from terragrid.operators import raster

    res = 0.25
    small = {"res": res, "distance_elec_access": 3.3 * res * grid.KM_PER_DEGREE, "min_shore_distance": 1.4 * res * grid.KM_PER_DEGREE, "rounds": 2, "depth": 2, "era_year": 2018}
    defs = regions.definitions(spark, [("W", regions.Admin(("Home",), ("West",))), ("E", regions.Admin(("Home",), ("East",)))])
    entry.run(spark, folder, "two", defs, 60, 40, small)
    out = {n: spark.read.parquet(folder.path("results", "two", n)) for n in ("distances", "solar_capacity", "solar_cf", "solar_overlap", "wind_capacity", "wind_cf", "hydro_existing", "hydro_existing_inflow", "hydro_potential", "hydro_potential_inflow")}
    assert {r["connected"] for r in out["distances"].where("r1 <> r2").collect()} == {True}
    assert out["hydro_existing"].agg(F.sum("capacity_gw")).first()[0] > 0 and out["hydro_potential"].count() > 0
    assert out["solar_cf"].select("hour").distinct().count() == 48 and out["solar_overlap"].count() > 0
    # the same by hand
    px = {(r["lon_idx"], r["lat_idx"]): r for r in spark.read.parquet(folder.path("layers")).join(spark.read.parquet(folder.path("regions", "two")), ["lon_idx", "lat_idx"]).collect()}
    get = lambda name: np.array([[px[(i, j)][name] for j in range(1, 41)] for i in range(1, 61)], float)

    def mean(a, radius):
        k = raster.disk_kernel(radius)
        n = len(k) // 2
        wide = np.pad(a, n, mode="edge")
        return sum(k[x, y] * wide[x : x + 60, y : y + 40] for x in range(len(k)) for y in range(len(k)))

    region, sea, o = get("region"), get("offshore"), with_options(WindOptions(), {"res": res})
    near_grid, near_land = mean(get("gridaccess"), 3.3) > 0.001, mean((region > 0) * 1.0, 1.4) > 1e-6
    free = ~np.isin(get("protected"), o.protected_codes)
    fit = (region > 0) & ~np.isin(get("land"), o.exclude_landtypes) & free & (get("popdens") < 150)
    area = (2 * np.pi * 6371 / 360 * res) ** 2 * np.cos(np.radians(90 - (np.arange(40) + 0.5) * res)) * np.ones((60, 1))
    era = np.array([(8 * k + 224) // 225 for k in range(1, 61)])
    cells = {(r["era_lon"], r["era_lat"], r["year"]): r for r in spark.read.parquet(folder.path("cells", "wind")).collect()}
    kinds = {"onshoreA": (fit & (get("gridaccess") > 0) & (region < 32767), region, o.onshoreclasses_max, 0.4), "onshoreB": (fit & (get("gridaccess") == 0) & near_grid & (region < 32767), region, o.onshoreclasses_max, 0.8), "offshore": ((sea > 0) & (sea < 32767) & near_grid & ~near_land & (get("topo") > -40) & free, sea, o.offshoreclasses_max, 2.64)}
    got = {(r["tech"], r["region"], r["class"]): r["capacity_gw"] for r in out["wind_capacity"].collect()}
    cf = {(r["tech"], r["region"], r["class"], r["hour"]): r["cf"] for r in out["wind_cf"].collect()}
    want, hours = {}, {}
    for tech, (ok, where, tops, mw) in kinds.items():
        for i, j in zip(*np.nonzero(ok), strict=True):
            v = px[(i + 1, j + 1)]["atlas"]
            c = next((n for n, top in enumerate(tops, 1) if v < top), 0) if v >= (2 if tech != "offshore" else 3) else 0
            if c:
                key = (tech, int(where[i, j]), c)
                want[key] = want.get(key, 0) + mw * area[i, j] / 1000
                cell = [cells[(era[i], era[j], y)] for y in (2017, 2018)]
                speed = np.array(cell[1]["series"]) * v / np.mean([x["mean"] for x in cell])
                hours.setdefault(key, []).append(wind.capacity_factor(speed))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and {k[0] for k in want} == set(kinds)
    assert all(cf[(*k, h)] == pytest.approx(np.mean(v, axis=0)[h]) for k, v in hours.items() for h in (0, 17, 47))


def test_without_rescaling(spark, folder):
    """Classes are then those of the cell's mean, and an unknown altitude is an error."""
    o = with_options(WindOptions(), {"res": 0.25, "gisregion": "two", "rescale_to_wind_atlas": False, "distance_elec_access": 90.0, "min_shore_distance": 30.0})
    capacity, cf = entry.wind_potential(spark, folder, o, 60, 40)
    assert {r["class"] for r in capacity.where("tech <> 'offshore'").collect()} <= {2, 3} and cf.count() == 48 * capacity.count()
    with pytest.raises(KeyError):
        entry.wind_potential(spark, folder, with_options(o, {"wind_class_altitude": 150}), 60, 40)


def test_climate_scenario(spark, folder):
    """A climate model's own grid, and the ten years around the scenario's year."""
    rows = [(s, y, i, j, [5.0 + y % 10 + h for h in range(3)]) for s, y in (("HCLIM_x_rcp85_2050", 2050), ("HCLIM_x_rcp85_2051", 2051), ("HCLIM_x_rcp85_2060", 2060)) for i in range(1, 4) for j in range(1, 3)]
    df = spark.createDataFrame([("HCLIM", *r, sum(r[4]) / 3) for r in rows], "source string, scenario string, year int, era_lon int, era_lat int, series array<double>, mean double")
    px = spark.createDataFrame([(k, 2.0 + 0.03 * k + 0.01, 71.5 - 0.01, 1, 0, 6.0 + k) for k in range(4)], "k int, lon double, lat double, region int, offshore int, atlas double")
    px = px.withColumns({"onshore_a": F.lit(True), "onshore_b": F.lit(False), "offshore_ok": F.lit(False), "area_km2": F.lit(1.0)})
    px = entry.climate_cells(px, "HCLIM")
    assert [(r["era_lon"], r["era_lat"]) for r in px.orderBy("k").collect()] == [(1, 1), (2, 1), (3, 1), (4, 1)]
    means = df.where("year between 2046 and 2055").groupBy("era_lon", "era_lat").agg(F.avg("mean").alias("mean_all"))
    o = with_options(WindOptions(), {"climate_scenario": "HCLIM_x_rcp85_2050"})
    capacity, cf = entry.wind_result(px, means, entry.with_hours(df.where(F.col("scenario") == o.climate_scenario)), o)
    assert [(r["class"], r["pixels"]) for r in capacity.collect()] == [(3, 3)] and cf.count() == 3


def test_training_and_scores(spark, tmp_path):
    rows = spark.createDataFrame([(r, h, float(h % 5), 1.0 + (h % 5) / 10) for r in (1, 2, 3) for h in range(60)], "region int, hour int, x double, normdemand double")
    o = demand.DemandOptions(variables=("x",), rounds=3, depth=3, eta=0.5, subsample=1.0)
    for loss in ("squared", "absolute"):
        out = demand.cross_validated(rows, o, at_once=3, loss=loss, prepare=lambda d: d.where("hour < 50"))
        worst = demand.scored(out, lambda y, z: F.max(F.abs(y - z)), by="region").collect()
        assert out.count() == 180 and {r["region"] for r in worst} == {1, 2, 3}
        assert all(r["score"] < (0.05 if loss == "squared" else 1.0) for r in worst)
    demand.save_training(rows, rows.select("region").distinct(), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "rows")).count() == 180
