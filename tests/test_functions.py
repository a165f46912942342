"""Scalar functions against values derived by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from terragrid import options
from terragrid.functions import grid, scalar, solar, wind


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def at():
    return F.lit("2019-04-15 13:46:00").cast("timestamp_ntz")


@pytest.mark.parametrize(
    "col,want",
    [
        (lambda: grid.cell_area_km2(F.lit(0.0), 0.01), 1.23643117),
        (lambda: grid.cell_area_km2(F.lit(60.0), 0.01), 0.618215586),
        (lambda: wind.capacity_factor(F.lit(5.5)), 0.1449),
        (lambda: wind.capacity_factor(F.lit(0.0)), 0),
        (lambda: wind.capacity_factor(F.lit(12.0)), 0.8614),
        (lambda: wind.capacity_factor(F.lit(28.5)), 0.00315),
        (lambda: wind.capacity_factor(F.lit(29.0)), 0),
        (lambda: wind.capacity_factor(F.lit(-0.1)), 0),
        (lambda: wind.capacity_factor(F.lit(float("nan"))), 0),
        (lambda: scalar.capital_recovery(0.1, 40), 0.102259414),
        (lambda: solar.optimal_tilt(F.lit(45.0)), 33.5970826),
        (lambda: solar.optimal_tilt(F.lit(-30.0)), -27.31223),
        (lambda: solar.optimal_tilt(F.lit(0.0)), -0.41657),
        (lambda: solar.insolation_w(at()), 1350.53514),
        (lambda: grid.haversine_km(*map(F.lit, (52.205, 0.119, 48.857, 2.351))), 404.279164),
        (lambda: solar.horizon_correction(F.lit(math.pi / 2)), 0.5),
        (lambda: grid.dms_to_degrees(F.lit(453015.0)), 45.5041667),
        (lambda: grid.dms_to_degrees(F.lit(-453015.0)), -45.5041667),
        (lambda: solar.sun_position(at(), F.lit(58.0), F.lit(12.0))["declination"], 9.948019),
        (lambda: solar.sun_position(at(), F.lit(58.0), F.lit(12.0))["hour_angle"], 38.483688),
        (lambda: solar.sun_position(at(), F.lit(58.0), F.lit(12.0))["zenith"], 56.285768),
        (lambda: solar.sun_position(at(), F.lit(58.0), F.lit(12.0))["azimuth"], 47.466445),
        (lambda: scalar.demand_multiplier(F.lit(2.0), F.lit(2.0), 2020), 1.0),
        (lambda: scalar.tz_offset_hours(at(), F.lit("Etc/GMT-5")), 5.0),
        (lambda: scalar.significant(F.lit(0.00123456)), 0.001235),
        (lambda: scalar.significant(F.lit(-98765.4)), -98770.0),
    ],
)
def test_golden(spark, col, want):
    assert value(spark, col()) == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_nulls(spark):
    null = F.lit(None).cast("double")
    assert value(spark, wind.capacity_factor(null)) is None
    assert value(spark, wind.rescaled(F.lit(5.0), F.lit(5.0), F.lit(0.0))) is None
    assert value(spark, scalar.classes(F.lit(float("nan")), [0, 1], [1, 2])) == 0
    assert value(spark, scalar.classes(null, [0, 1], [1, 2])) == 0
    assert value(spark, scalar.first_interval(F.lit(9.0), [0, 1], [1, 2])) is None
    assert value(spark, scalar.classes(F.lit(2.0), [0, 1], [1, 2])) == 0


def test_containment_key(spark):
    """Every fine pixel lies in the coarse cell that holds its far edge."""
    rows = spark.range(1, 36001).select("id", grid.coarse_index(F.col("id")).alias("c")).collect()
    assert all((r["c"] - 1) * 225 < r["id"] * 8 <= r["c"] * 225 for r in rows)
    assert {r["c"] for r in rows} == set(range(1, 1281))


def test_two_sun_positions_agree(spark):
    t = F.timestamp_add("MINUTE", (F.col("id") * 911).cast("int"), F.lit("2018-01-01 00:00:00").cast("timestamp_ntz"))
    lat, lon = (F.col("id") % 120 - 60).cast("double"), (F.col("id") * 7 % 360 - 180).cast("double")
    d = spark.range(500).select(F.abs(solar.sun_position(t, lat, lon)["zenith"] - solar.sun_position_mean(t, lat, lon)["zenith"]).alias("d"))
    assert d.agg(F.max("d")).first()[0] < 0.5


def test_options():
    o = options.with_options(options.WindOptions(), {"max_depth": 60})
    assert o.max_depth == 60 and o.onshore_density == 5
    with pytest.raises(KeyError):
        options.with_options(options.HydroOptions(), {"nosuch": 1})


def test_grid_spec(spark):
    g = grid.GridSpec(0.5, (0, 10), (0, 5))
    assert (g.nlon, g.nlat) == (20, 10) and g.lons()[0] == 0.25 and g.lats()[0] == 4.75
    with pytest.raises(ValueError):
        grid.GridSpec(0.3, (0, 1), (0, 1))
    assert value(spark, g.lon_index(F.lit(-3.0), restrict=True)) == 1
    assert value(spark, g.lat_index(F.lit(5.0))) == 1
    c = g.crop(1.2, 1.2, 2.2, 2.2)
    assert c.lonlim == (1.0, 2.5) and c.latlim == (1.0, 2.5)
    assert grid.index_ranges(170, -170, 1.0) == [(351, 360), (1, 10)]
    assert grid.mesh(spark, g).distinct().count() == 200


def test_circular_extent(spark):
    mask = spark.createDataFrame([(i, 1, r) for i, r in enumerate([1, 1, 0, 0, 0, 1], 1)], "lon_idx int, lat_idx int, region int")
    assert tuple(grid.lon_extent(mask, 6).first()) == (6, 2)


def test_great_circle(spark):
    track = value(spark, grid.great_circle_track(*map(F.lit, (0.0, 0.0, 0.0, 90.0)), 4))
    assert [round(p["lon"], 6) for p in track] == [0, 30, 60, 90] and all(abs(p["lat"]) < 1e-9 for p in track)


def test_hours():
    assert scalar.leap_hours(2016) == 8784 and scalar.leap_hours(1900) == 8760
    assert scalar.density_breaks()[:5] == [0.0, 0.1, 0.2, 0.5, 1.0] and len(scalar.speed_breaks()) == 85
    assert dt.date(2060, 1, 1).year == 2060
