"""Queries against brute force over tables that are larger than those of the SQL's tests."""

import os

import numpy as np
import pytest

from terragrid import queries
from terragrid.fixtures import view
from terragrid.operators import raster
from terragrid.options import DemandOptions
from terragrid.plans import demand

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def cells(spark):
    """Every pixel of v_pixel in numpy: (lon, lat) to region, land and value."""
    p = view(spark, SF, "v_pixel").select("lon_idx", "lat_idx", "region", "land", "popdens").toPandas()
    return p.groupby(["lon_idx", "lat_idx"]).agg(region=("region", "min"), land=("land", "min"), value=("popdens", "sum"))


def array(cells, column):
    a = np.zeros((100, cells.index.get_level_values("lat_idx").max()))
    for (i, j), v in cells[column].items():
        a[i - 1, j - 1] = v
    return a


def held(df, value):
    return {(r["lon_idx"], r["lat_idx"]): r[value] for r in df.select("lon_idx", "lat_idx", value).collect()}


@pytest.mark.parametrize("name", ["disk_mean_joins", "disk_mean_tiles"])
def test_disk_means_of_all_rows(spark, cells, name):
    a, k = array(cells, "value"), raster.disk_kernel(2.3)
    n, wide = len(k) // 2, np.pad(array(cells, "value"), len(k) // 2, mode="edge")
    want = sum(k[i, j] * wide[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * n + 1) for j in range(2 * n + 1))
    got = held(queries.QUERIES[name](spark, SF), "value")
    assert got.keys() == set(cells.index) and max(j for _, j in got) == 200
    assert all(v == pytest.approx(want[i - 1, j - 1]) for (i, j), v in got.items())


def test_block_sums_of_all_rows(spark, cells):
    a = array(cells, "value")
    h = a.shape[1] // 3
    want = a[:99, : 3 * h].reshape(33, 3, h, 3).sum(axis=(1, 3))
    got = held(queries.block_sums(spark, SF), "value")
    assert len(got) == 33 * h and all(v == pytest.approx(want[i - 1, j - 1]) for (i, j), v in got.items())


def test_neighbours_fill_all_rows(spark, cells):
    a = array(cells, "land")
    wide = np.pad(a, 1, mode="edge")
    most = np.max([wide[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)], axis=0)
    want = np.where(a == 0, most, a)
    got = held(queries.fill_from_neighbours(spark, SF), "land")
    assert got.keys() == set(cells.index) and all(v == want[i - 1, j - 1] for (i, j), v in got.items())


def test_nearest_fill_of_all_rows(spark, cells):
    at = np.array(list(cells.index))
    seeds = ((cells.land % 7 == 0) & (cells.region > 0)).to_numpy()
    to, region = at[seeds], cells.region.to_numpy()[seeds]
    got = held(queries.nearest_fill(spark, SF), "region")
    assert got.keys() == set(cells.index)
    for i, j in at[::37]:
        d = ((to - (i, j)) ** 2).sum(axis=1)
        assert got[i, j] == region[d == d.min()].min()


@pytest.mark.parametrize("name", ["shore_split", "spread_to_fine"])
def test_every_pixel_is_there(spark, cells, name):
    assert set(map(tuple, queries.QUERIES[name](spark, SF).select("lon_idx", "lat_idx").collect())) == set(cells.index)


def test_all_rows_count(spark, cells):
    total, land = cells.value.sum(), set(zip((cells.index.get_level_values("lon_idx") - 1) // 10, (cells.index.get_level_values("lat_idx") - 1) // 5))
    assert queries.population_to_coarse(spark, SF).groupBy().sum("population").first()[0] == pytest.approx(total)
    assert set(map(tuple, queries.mode_resample(spark, SF).select("bi", "bj").collect())) == land
    assert queries.bilinear_resample(spark, SF).count() == 4 * len(cells)
    a = array(cells, "value")
    four = (a[:-1, :-1] + a[1:, :-1] + a[:-1, 1:] + a[1:, 1:]) / 4
    got = held(queries.half_cell_shift(spark, SF), "value")
    assert max(j for _, j in got) == 199 and all(v == pytest.approx(four[i - 1, j - 1]) for (i, j), v in got.items())


def test_regions_of_all_rows(spark, cells):
    land = {k: r for k, r in cells.region.items() if 0 < r < 32767}
    want = {(r, land[i + a, j + b]) for (i, j), r in land.items() for a in (-1, 0, 1) for b in (-1, 0, 1) if (i + a, j + b) in land}
    assert set(map(tuple, queries.region_adjacency(spark, SF).select("r1", "r2").collect())) == want
    best = cells[cells.region > 0].reset_index().sort_values(["value", "lon_idx", "lat_idx"], ascending=[False, True, True]).groupby("region").first()
    got = {r["region"]: (r["lon_idx"], r["lat_idx"]) for r in queries.population_centres(spark, SF).where("centre = 1").collect()}
    assert got == {r: (row.lon_idx, row.lat_idx) for r, row in best.iterrows()}


MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def places(spark):
    """Every customer and every plant in pandas."""
    c = spark.read.parquet(f"{MID}/customer.parquet").toPandas()
    c["lon"], c["lat"] = c.c_custkey * 71 % 360 - 179.25, c.c_custkey * 29 % 180 - 89.25
    return c.sort_values("c_custkey").reset_index(drop=True), view(spark, MID, "v_plant").toPandas().sort_values("plant_id")


def test_nearest_of_all_customers(spark, places):
    sites, plants = places
    d2 = (plants.lon.to_numpy()[:, None] - sites.lon.to_numpy()) ** 2 + (plants.lat.to_numpy()[:, None] - sites.lat.to_numpy()) ** 2
    near, least = sites.c_custkey.to_numpy()[d2.argmin(axis=1)], d2.min(axis=1)
    got = {r["plant_id"]: (r["site_id"], r["km"]) for r in queries.nearest_site(spark, MID).collect()}
    assert got == {p: (s, pytest.approx(111 * x**0.5)) for p, s, x in zip(plants.plant_id, near, least)}
    got = {r["plant_id"]: (r["site_id"], r["degrees"]) for r in queries.nearest_site_within(spark, MID).collect()}
    assert got == {p: (s, pytest.approx(x**0.5)) if x < 25 else (None, None) for p, s, x in zip(plants.plant_id, near, least)}
    assert any(s % 10 for s in near)


def test_inflow_of_all_customers(spark, places):
    sites, plants = places
    days = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    register = plants.groupby("country").capacity_mw.sum()
    mw, energy = {}, {}
    for p in plants.itertuples():
        site = sites.c_custkey[((sites.lon - p.lon) ** 2 + (sites.lat - p.lat) ** 2).argmin()]
        e = np.array([1.0 + site * (m + 2) % 11 for m in range(12)]) * days
        national = 500 + 100 * p.country
        own = p.capacity_mw * national / register[p.country]
        cf = (1000 + 200 * p.country) * 1000 / 8760 / national
        r = 1 + p.country % 4
        mw[r] = mw.get(r, 0) + own
        energy[r] = energy.get(r, 0) + own * cf * e / e.sum() * 365 / days
    want = {(r, m + 1): pytest.approx(energy[r][m] / mw[r]) for r in mw for m in range(12)}
    assert {(r["region"], r["month"]): r["inflow_cf"] for r in queries.hydro_existing_inflow(spark, MID).collect()} == want


def test_index_and_buses_of_all_customers(spark, places):
    sites, _ = places
    want = {(k, int((x + 180) // 0.25) + 1, min(int((90 - y) // 0.25) + 1, 720)) for k, x, y in zip(sites.c_custkey, sites.lon, sites.lat)}
    assert {tuple(r) for r in queries.grid_index(spark, MID).select("site_id", "lon_idx", "lat_idx").collect()} == want
    for sf in (MID, MID.replace("0.01", "0.001")):
        c, s = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("customer", "supplier"))
        count, balance = c.groupby("c_nationkey").size(), s.groupby("s_nationkey").s_acctbal.sum()
        got = {r["bus"]: (r["customers"], float(r["balance"])) for r in queries.both_buses(view(spark, sf, "customer"), view(spark, sf, "supplier")).collect()}
        assert got == {k: (count.get(k, 0), pytest.approx(float(balance.get(k, 0)))) for k in {*count.index, *balance.index}}
    assert len(balance) < len(count)


def test_distances_of_all_plants(spark, places):
    p = places[1]
    k, y, x = p.plant_id.to_numpy(), np.radians(p.lat.to_numpy()), np.radians(p.lon.to_numpy())
    h = np.sin((y - y[:, None]) / 2) ** 2 + np.cos(y) * np.cos(y[:, None]) * np.sin((x - x[:, None]) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1)))
    got = {(r["r1"], r["r2"]): r["km"] for r in queries.region_distances(spark, MID).collect()}
    assert got == {(k[i], k[j]): pytest.approx(km[i, j], abs=1e-3) for i in range(len(k)) for j in range(len(k))}


def test_service_areas_of_all_customers(spark, places):
    sites = places[0].drop_duplicates(["lon", "lat"])
    px = view(spark, MID, "v_pixel").select("pixel_id", "land").toPandas()
    want = {k: [0, 0] for k in places[0].c_custkey}
    for i, land in zip(px.pixel_id, px.land):
        x, y = i % 360 - 179.6, i % 170 - 84.3
        km = np.round(111.0 * np.sqrt((x - sites.lon.to_numpy()) ** 2 + (y - sites.lat.to_numpy()) ** 2), 9)
        want[sites.c_custkey.to_numpy()[km.argmin()]][0 if land > 0 else 1] += 1
    got = {r["site_id"]: [r["onshore"], r["offshore"]] for r in queries.service_areas(spark, MID).collect()}
    assert got == want and sum(map(sum, got.values())) == len(px)


def test_demand_prediction_by_the_whole_model(spark, monkeypatch):
    models, train = [], demand.train

    def seen(rows, o=DemandOptions(), label="normdemand"):
        models.append(o)
        return train(rows, DemandOptions(rounds=1, depth=1), label)

    monkeypatch.setattr(demand, "train", seen)
    queries.demand_prediction(spark, MID.replace("0.01", "0.001"))
    assert models == [DemandOptions()]
