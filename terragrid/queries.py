"""The library's operators over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import sql, view
from .functions import grid, scalar, solar, wind
from .operators import masks, raster, regions, relational, spatial
from .options import HydroOptions, NOREGION, SolarOptions, WindOptions, with_options
from .plans import demand, entry, hydro, resource, turbines
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RES = 0.01


def query(oracle: str | None = None, *views: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = sql(oracle, *views)
        return f

    return add


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels with coordinates, area and masks; the disk mean of grid access is the table's own column."""
    p = view(spark, d, "v_pixel")
    p = p.withColumn("lat", grid.col_to_lat(F.col("lat_idx"), RES)).withColumn("lon", grid.row_to_lon(F.col("lon_idx"), RES))
    p = p.withColumn("area_km2", grid.cell_area_km2(F.col("lat") - 60, RES)).withColumn("buffered", F.col("popdens") / 300).withColumn("offshore", F.when(F.col("land") == 0, F.col("region")).otherwise(0))
    c = [F.col(x) for x in ("region", "land", "protected", "popdens", "gridaccess", "buffered")]
    m = masks.wind_masks(WindOptions(), *c, F.col("topo"), F.col("offshore"), F.lit(0.0))
    s = masks.solar_masks(SolarOptions(), *c)
    p = p.withColumns({"onshore_a": m["onshore_a"], "onshore_b": m["onshore_b"], "offshore_ok": m["offshore"], "roof": s["roof"], "plant_a": s["plant_a"], "plant_b": s["plant_b"]})
    return p.withColumn("mean_gti", F.col("atlas") / 40).withColumn("mean_dni", F.col("atlas") / 30)


#: The same in SQL.
PIXELS = """px0 AS (SELECT *, 90.0 - (lat_idx - 0.5) * 0.01 AS lat, (lon_idx - 0.5) * 0.01 - 180.0 AS lon, popdens / 300 AS buffered, CASE WHEN land = 0 THEN region ELSE 0 END AS offshore, atlas / 40 AS mean_gti, atlas / 30 AS mean_dni FROM v_pixel),
px1 AS (SELECT *, cos(radians(CAST(lat AS DOUBLE) - 60)) * pow(2 * pi() * 6371.0 / 360 * 0.01, 2) AS area_km2, protected IN (1,2,3,4,5,8) AS kept, gridaccess > 0 AS grid_a, buffered > 0.001 AS grid_b,
  region > 0 AND land NOT IN (0,11,13) AS good_wind, region > 0 AND land NOT IN (0,1,2,3,4,5,8) AS good_solar FROM px0),
px AS (SELECT *, grid_a AND popdens < 150 AND good_wind AND NOT kept AS onshore_a, grid_b AND NOT grid_a AND popdens < 150 AND good_wind AND NOT kept AS onshore_b,
  grid_b AND topo > -40 AND offshore > 0 AND offshore <> 32767 AND NOT kept AS offshore_ok, grid_a AND popdens > 200 AND NOT kept AS roof,
  popdens < 150 AND good_solar AND NOT kept AND grid_a AS plant_a, popdens < 150 AND good_solar AND NOT kept AND grid_b AND NOT grid_a AS plant_b FROM px1)"""


def classes_sql(x: str, low, high) -> str:
    return f"CASE WHEN {x} < {low[0]} OR {x} >= {high[-1]} THEN 0 " + " ".join(f"WHEN {x} < {b} THEN {k}" for k, b in enumerate(high, 1)) + " ELSE 0 END"


_w, _s = WindOptions(), SolarOptions()
ON, OFF = classes_sql("atlas", _w.onshoreclasses_min, _w.onshoreclasses_max), classes_sql("atlas", _w.offshoreclasses_min, _w.offshoreclasses_max)
PV, CSP = classes_sql("mean_gti", _s.pvclasses_min, _s.pvclasses_max), classes_sql("mean_dni", _s.cspclasses_min, _s.cspclasses_max)
CURVE = "curve(v, c) AS (VALUES " + ", ".join(f"({v}, CAST({c} AS DOUBLE))" for v, c in enumerate(wind.PARK_CURVE)) + ")"
CF = "CASE WHEN {x} >= 0 AND {x} < 29 THEN (1 - ({x} - floor({x}))) * c0.c + ({x} - floor({x})) * c1.c ELSE 0 END"
WIND_TECHS = f"""techs AS (
  SELECT 'onshoreA' AS tech, region, {ON} AS class, 5.0 * 0.08 / 1000 * area_km2 AS gw, era_lon, atlas FROM px WHERE onshore_a AND region <> 32767
  UNION ALL SELECT 'onshoreB', region, {ON}, 2 * 5.0 * 0.08 / 1000 * area_km2, era_lon, atlas FROM px WHERE onshore_b AND region <> 32767
  UNION ALL SELECT 'offshore', offshore, {OFF}, 8.0 * 0.33 / 1000 * area_km2, era_lon, atlas FROM px WHERE offshore_ok)"""


@query(f"WITH {PIXELS}, {WIND_TECHS} SELECT tech, region, class, sum(CAST(gw AS DOUBLE)) AS capacity_gw, count(*) AS pixels FROM techs WHERE class > 0 GROUP BY ALL", "v_pixel")
def wind_capacity(spark, d):
    """Installable wind capacity by tech, region and class."""
    return resource.capacity(resource.wind_techs(pixels(spark, d), WindOptions()))


@query(
    f"""WITH {PIXELS}, {WIND_TECHS}, {CURVE}, means AS (SELECT era_lon, avg(value) AS mean_all FROM v_cell_hour GROUP BY 1),
    met AS (SELECT t.tech, t.region, t.class, h.hour, h.value * t.atlas / m.mean_all AS x FROM techs t JOIN means m ON t.era_lon = m.era_lon JOIN v_cell_hour h ON t.era_lon = h.era_lon WHERE t.class > 0)
    SELECT tech, region, class, hour, avg({CF.format(x="x")}) AS cf FROM met LEFT JOIN curve c0 ON c0.v = floor(x) LEFT JOIN curve c1 ON c1.v = floor(x) + 1 GROUP BY ALL""",
    "v_pixel", "v_cell_hour",
)
def wind_hourly(spark, d):
    """Hourly capacity factors, rescaled to the atlas; a cell's weights meet its series as one array."""
    hours = view(spark, d, "v_cell_hour")
    mean = hours.groupBy("era_lon").agg(F.avg("value").alias("mean_all"))
    techs = resource.wind_techs(pixels(spark, d), WindOptions()).join(mean, "era_lon")
    return resource.hourly(techs, hours.select("era_lon", "hour", "value"), F.try_divide("atlas", F.nullif("mean_all", F.lit(0.0))), wind.capacity_factor, ["era_lon"])


SOLAR_TECHS = f"""techs AS (
  SELECT 'pvrooftop' AS tech, region, {PV} AS class, 45.0 * 0.05 / 1000 * area_km2 AS gw, era_lon FROM px WHERE roof
  UNION ALL SELECT 'pvplantA', region, {PV}, 45.0 * 0.05 / 1000 * area_km2, era_lon FROM px WHERE plant_a AND NOT roof
  UNION ALL SELECT 'pvplantB', region, {PV}, 2 * 45.0 * 0.05 / 1000 * area_km2, era_lon FROM px WHERE plant_b AND NOT roof
  UNION ALL SELECT 'cspplantA', region, {CSP}, 35.0 * 0.05 / 1000 * area_km2, era_lon FROM px WHERE plant_a
  UNION ALL SELECT 'cspplantB', region, {CSP}, 2 * 35.0 * 0.05 / 1000 * area_km2, era_lon FROM px WHERE plant_b)"""


@query(f"WITH {PIXELS}, {SOLAR_TECHS} SELECT tech, region, class, sum(CAST(gw AS DOUBLE)) AS capacity_gw, count(*) AS pixels FROM techs WHERE class > 0 AND region <> 32767 GROUP BY ALL", "v_pixel")
def solar_capacity(spark, d):
    """Installable solar capacity by tech, region and class."""
    return resource.capacity(resource.solar_techs(pixels(spark, d), SolarOptions()))


@query(f"WITH {PIXELS}, {SOLAR_TECHS} SELECT tech, region, class, hour, avg(value / 47.3) AS cf FROM techs JOIN v_cell_hour USING (era_lon) WHERE class > 0 AND region <> 32767 GROUP BY ALL", "v_pixel", "v_cell_hour")
def solar_hourly(spark, d):
    """Hourly solar capacity factors, which are the irradiance."""
    cells = view(spark, d, "v_cell_hour").select("era_lon", "hour", (F.col("value") / 47.3).alias("value"))
    return resource.hourly(resource.solar_techs(pixels(spark, d), SolarOptions()), cells, keys=["era_lon"])


@query(f"WITH {PIXELS}, o AS (SELECT CASE WHEN plant_a THEN 'A' ELSE 'B' END AS kind, region, {PV} AS pvclass, {CSP} AS cspclass, CASE WHEN plant_a THEN 1.0 ELSE 2.0 END * area_km2 * 0.05 / 1000 AS area FROM px WHERE (plant_a OR plant_b) AND region <> 32767) SELECT kind, region, pvclass, cspclass, sum(area) AS area FROM o WHERE pvclass > 0 AND cspclass > 0 GROUP BY ALL", "v_pixel")
def solar_overlap(spark, d):
    """Area that both kinds of plant could use."""
    return resource.overlap(pixels(spark, d), SolarOptions())


@query(f"WITH {PIXELS} SELECT pixel_id, CASE WHEN onshore_a THEN {ON} ELSE 0 END AS onshore_class, CASE WHEN offshore_ok THEN {OFF} ELSE 0 END AS offshore_class FROM px", "v_pixel")
def wind_map(spark, d):
    """Class of every pixel."""
    return resource.class_map(pixels(spark, d), WindOptions()).select("pixel_id", "onshore_class", "offshore_class")


@query(f"WITH {PIXELS} SELECT pixel_id, CASE WHEN plant_a THEN {PV} ELSE 0 END AS pv_class, CASE WHEN roof THEN {PV} ELSE 0 END AS roof_class, CASE WHEN plant_a THEN {CSP} ELSE 0 END AS csp_class FROM px", "v_pixel")
def solar_map(spark, d):
    """Classes of every pixel."""
    return resource.solar_class_map(pixels(spark, d), SolarOptions()).select("pixel_id", "pv_class", "roof_class", "csp_class")


@query(
    f"""WITH {PIXELS} SELECT pixel_id,
    CASE WHEN region = 0 THEN 0 WHEN region = 32767 THEN 32767 WHEN popdens > 150 THEN 2 WHEN kept THEN 3 WHEN NOT grid_a AND NOT grid_b THEN 4 WHEN NOT good_wind THEN 1 WHEN NOT grid_a THEN 8 ELSE 7 END AS wind_code,
    CASE WHEN region = 0 THEN 0 WHEN region = 32767 THEN 32767 WHEN popdens > 150 THEN 2 WHEN kept THEN 3 WHEN NOT grid_a AND NOT grid_b THEN 4 WHEN NOT good_solar THEN 1 WHEN NOT grid_a THEN 6 ELSE 5 END AS solar_code,
    CASE WHEN offshore = 0 THEN 32767 WHEN offshore = 32767 THEN 0 WHEN kept THEN 3 WHEN topo <= -40 THEN 8 WHEN NOT grid_b THEN 4 ELSE 7 END AS offshore_code FROM px""",
    "v_pixel",
)
def mask_codes(spark, d):
    """H2, H4: why each pixel is in or out."""
    p = pixels(spark, d)
    c = [F.col(x) for x in ("region", "land", "protected", "popdens", "gridaccess", "buffered")]
    w = masks.wind_masks(WindOptions(), *c, F.col("topo"), F.col("offshore"), F.lit(0.0))
    s = masks.solar_masks(SolarOptions(), *c)
    return p.select("pixel_id", masks.wind_code(WindOptions(), w, c[0], c[3]).alias("wind_code"), masks.solar_code(SolarOptions(), s, c[0], c[3]).alias("solar_code"), masks.offshore_code(WindOptions(), w, F.col("topo"), F.col("offshore")).alias("offshore_code"))


# Whole computations: territory split at the shore, disk means, masks, classes, hours

#: Radii in pixels of the reach of the grid and of the shore.
REACH, SHORE = 2.3, 1.2
WHOLE = {"distance_elec_access": REACH * RES * grid.KM_PER_DEGREE, "min_shore_distance": SHORE * RES * grid.KM_PER_DEGREE}
#: Shares of their pixels that a disk of each radius covers, over its area: counted on 1,500 by 1,500 points a pixel.
REACH_SQL = "k1(a, b, w) AS (SELECT i.range, j.range, CASE least(abs(i.range), abs(j.range)) * 10 + greatest(abs(i.range), abs(j.range)) WHEN 2 THEN 0.04704 WHEN 12 THEN 0.03285 WHEN 22 THEN 0.00187 ELSE 0.06017 END FROM range(-2, 3) i, range(-2, 3) j)"
SHORE_SQL = "k2(a, b, w) AS (SELECT i.range, j.range, CASE abs(i.range) + abs(j.range) WHEN 0 THEN 0.22105 WHEN 1 THEN 0.14685 ELSE 0.04789 END FROM range(-1, 2) i, range(-1, 2) j)"
WHOLE_SQL = f"""{REACH_SQL}, {SHORE_SQL}, g0 AS (SELECT *, CASE WHEN lon_idx % 20 < 8 AND lat_idx % 12 < 6 THEN 0 ELSE land END AS land2, CASE WHEN pixel_id % 31 = 0 THEN 1.0 ELSE 0.0 END AS access FROM v_pixel),
g1 AS (SELECT *, CASE WHEN land2 > 0 THEN region ELSE 0 END AS r, CASE WHEN land2 = 0 THEN region ELSE 0 END AS offr, cos(radians(90 - (lat_idx - 0.5) * 0.01)) * pow(2 * pi() * 6371.0 / 360 * 0.01, 2) AS area FROM g0),
hh AS (SELECT greatest(20, max(lat_idx)) AS h FROM g1),
bu AS (SELECT g.pixel_id, sum(coalesce(n.access, 0) * k.w) AS buffered FROM g1 g CROSS JOIN k1 k CROSS JOIN hh LEFT JOIN g1 n ON n.lon_idx = least(greatest(g.lon_idx + k.a, 1), 100) AND n.lat_idx = least(greatest(g.lat_idx + k.b, 1), hh.h) GROUP BY 1),
sh AS (SELECT g.pixel_id, sum(CASE WHEN n.r > 0 THEN k.w ELSE 0 END) AS near FROM g1 g CROSS JOIN k2 k CROSS JOIN hh LEFT JOIN g1 n ON n.lon_idx = least(greatest(g.lon_idx + k.a, 1), 100) AND n.lat_idx = least(greatest(g.lat_idx + k.b, 1), hh.h) GROUP BY 1),
wp AS (SELECT g1.*, bu.buffered > 0.001 AS grid_b, sh.near > 1e-6 AS ashore, protected IN (1,2,3,4,5,8) AS kept FROM g1 JOIN bu USING (pixel_id) JOIN sh USING (pixel_id)),
wm AS (SELECT *, r > 0 AND land2 NOT IN (0,11,13) AND popdens < 150 AND NOT kept AS fit FROM wp),
wt AS (SELECT 'onshoreA' AS tech, r AS region, {ON} AS class, 5.0 * 0.08 / 1000 * area AS gw, era_lon, atlas FROM wm WHERE fit AND access > 0 AND r <> 32767
  UNION ALL SELECT 'onshoreB', r, {ON}, 2 * 5.0 * 0.08 / 1000 * area, era_lon, atlas FROM wm WHERE fit AND access = 0 AND grid_b AND r <> 32767
  UNION ALL SELECT 'offshore', offr, {OFF}, 8.0 * 0.33 / 1000 * area, era_lon, atlas FROM wm WHERE grid_b AND NOT ashore AND topo > -40 AND offr > 0 AND offr <> 32767 AND NOT kept)"""


def whole_pixels(spark, d, o):
    """Masked pixels of the whole table, with a sea, a sparse grid and the disk means of both."""
    p = view(spark, d, "v_pixel")
    sea = (F.col("lon_idx") % 20 < 8) & (F.col("lat_idx") % 12 < 6)
    p = p.withColumns({"land": F.when(sea, 0).otherwise(F.col("land")), "gridaccess": (F.col("pixel_id") % 31 == 0).cast("double"), "mean_gti": F.col("atlas") / 40, "mean_dni": F.col("atlas") / 30})
    on, off = raster.split_shore(F.col("region"), F.col("land"))
    p = p.withColumns({"region": on, "offshore": off})
    return entry.masked(entry.prepared(entry.located(p, RES), o, 100, height(p), tile=64), o)


def whole_wind(spark, d):
    o = with_options(WindOptions(), WHOLE)
    px = whole_pixels(spark, d, o)
    cells = view(spark, d, "v_cell_hour").groupBy("era_lon").agg(F.avg("value").alias("mean"), F.sort_array(F.collect_list(F.struct("hour", "value"))).alias("s"))
    cells = cells.select("era_lon", "mean", F.col("s.hour").alias("hours"), F.col("s.value").alias("values")).join(px.select("era_lon", "era_lat").distinct(), "era_lon")
    return entry.wind_result(px, cells.select(*resource.CELL, (F.col("mean") * 1.1).alias("mean_all")), cells, o)


@query(f"WITH {WHOLE_SQL} SELECT tech, region, class, sum(gw) AS capacity_gw, count(*) AS pixels FROM wt WHERE class > 0 GROUP BY ALL", "v_pixel")
def whole_wind_capacity(spark, d):
    """Capacity from layers by way of disk means, the shore and masks."""
    return whole_wind(spark, d)[0]


@query(
    f"""WITH {WHOLE_SQL}, {CURVE}, means AS (SELECT era_lon, avg(value) * 1.1 AS mean_all FROM v_cell_hour GROUP BY 1),
    met AS (SELECT t.tech, t.region, t.class, h.hour, h.value * t.atlas / m.mean_all AS x FROM wt t JOIN means m ON t.era_lon = m.era_lon JOIN v_cell_hour h ON t.era_lon = h.era_lon WHERE t.class > 0)
    SELECT tech, region, class, hour, avg({CF.format(x="x")}) AS cf FROM met LEFT JOIN curve c0 ON c0.v = floor(x) LEFT JOIN curve c1 ON c1.v = floor(x) + 1 GROUP BY ALL""",
    "v_pixel", "v_cell_hour",
)
def whole_wind_hourly(spark, d):
    """Hourly factors of the same."""
    return whole_wind(spark, d)[1]


@query(
    f"""WITH {REACH_SQL}, {WHOLE_SQL.split(f"{SHORE_SQL}, ")[1].split("sh AS")[0]} sp AS (SELECT g1.*, bu.buffered > 0.001 AS grid_b, protected IN (1,2,3,4,5,8) AS kept, atlas / 40 AS mean_gti, atlas / 30 AS mean_dni FROM g1 JOIN bu USING (pixel_id)),
    sm AS (SELECT *, r > 0 AND land2 NOT IN (0,1,2,3,4,5,8) AND popdens < 150 AND NOT kept AS fit, access > 0 AND popdens > 200 AND NOT kept AS roof FROM sp),
    st AS (SELECT 'pvrooftop' AS tech, r AS region, {PV} AS class, 45.0 * 0.05 / 1000 * area AS gw FROM sm WHERE roof
     UNION ALL SELECT 'pvplantA', r, {PV}, 45.0 * 0.05 / 1000 * area FROM sm WHERE fit AND access > 0 AND NOT roof
     UNION ALL SELECT 'pvplantB', r, {PV}, 2 * 45.0 * 0.05 / 1000 * area FROM sm WHERE fit AND access = 0 AND grid_b AND NOT roof
     UNION ALL SELECT 'cspplantA', r, {CSP}, 35.0 * 0.05 / 1000 * area FROM sm WHERE fit AND access > 0
     UNION ALL SELECT 'cspplantB', r, {CSP}, 2 * 35.0 * 0.05 / 1000 * area FROM sm WHERE fit AND access = 0 AND grid_b)
    SELECT tech, region, class, sum(gw) AS capacity_gw, count(*) AS pixels FROM st WHERE class > 0 AND region > 0 AND region <> 32767 GROUP BY ALL""",
    "v_pixel",
)
def whole_solar_capacity(spark, d):
    """Solar capacity from layers by way of the disk mean and masks."""
    o = with_options(SolarOptions(), {"distance_elec_access": WHOLE["distance_elec_access"]})
    hours = view(spark, d, "v_cell_hour").select("era_lon", F.lit(1).alias("era_lat"), "hour", "value")
    return entry.solar_result(whole_pixels(spark, d, o), hours, hours, o)[0]


@query(
    """WITH a0 AS (SELECT lon_idx, lat_idx, CASE WHEN land % 5 = 0 THEN 0 ELSE region END AS region, CASE WHEN land % 5 = 0 THEN region ELSE 0 END AS offshore, popdens, 90 - (lat_idx - 0.5) * 0.01 AS lat, (lon_idx - 0.5) * 0.01 - 180 AS lon FROM v_pixel),
    c AS (SELECT region, sum(lat * popdens) / sum(popdens) AS lat, sum(lon * popdens) / sum(popdens) AS lon FROM a0 WHERE region > 0 AND region <> 32767 GROUP BY 1),
    k AS (SELECT DISTINCT a.region AS r1, b.region AS r2 FROM a0 a JOIN a0 b ON abs(a.lon_idx - b.lon_idx) <= 1 AND abs(a.lat_idx - b.lat_idx) <= 1 WHERE a.region > 0 AND a.region <> 32767 AND b.region > 0 AND b.region <> 32767),
    o AS (SELECT DISTINCT a.offshore AS r1, b.offshore AS r2 FROM a0 a JOIN a0 b ON abs(a.lon_idx - b.lon_idx) <= 1 AND abs(a.lat_idx - b.lat_idx) <= 1 WHERE a.offshore > 0 AND a.offshore <> 32767 AND b.offshore > 0 AND b.offshore <> 32767)
    SELECT a.region AS r1, b.region AS r2, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km,
      k.r1 IS NOT NULL AS connected, o.r1 IS NOT NULL AND k.r1 IS NULL AS connected_offshore FROM c a CROSS JOIN c b LEFT JOIN k ON k.r1 = a.region AND k.r2 = b.region LEFT JOIN o ON o.r1 = a.region AND o.r2 = b.region""",
    "v_pixel",
)
def region_graph(spark, d):
    """Distances of regions, and which touch on land or at sea."""
    p = entry.located(view(spark, d, "v_pixel"), RES)
    sea = F.col("land") % 5 == 0
    p = p.withColumns({"offshore": F.when(sea, F.col("region")).otherwise(0), "region": F.when(sea, 0).otherwise(F.col("region"))})
    return regions.region_graph(p, regions.centres(p))


@query("""SELECT pixel_id, CASE WHEN popdens >= 50 AND popdens < 120 THEN 2 WHEN popdens >= 10 AND popdens < 40 THEN 1 ELSE 0 END AS gaps,
 CASE WHEN popdens >= 0 AND popdens < 100 THEN 1 WHEN popdens >= 50 AND popdens < 200 THEN 2 END AS first_class FROM v_pixel""", "v_pixel")  # fmt: skip
def interval_classes(spark, d):
    """H6, H8: half-open classes with gaps; the first class that holds a value."""
    x = F.col("popdens")
    return view(spark, d, "v_pixel").select("pixel_id", scalar.interval_classes(x, [10, 50], [40, 120]).alias("gaps"), scalar.first_interval(x, [0, 50], [100, 200]).alias("first_class"))


@query(f"WITH {CURVE}, e AS (SELECT event_id, value / 12.0 AS x FROM events) SELECT event_id, {CF.format(x='x')} AS cf FROM e LEFT JOIN curve c0 ON c0.v = floor(x) LEFT JOIN curve c1 ON c1.v = floor(x) + 1")
def power_curve(spark, d):
    """L1: capacity factor of a speed."""
    return view(spark, d, "events").select("event_id", wind.capacity_factor(F.col("value") / 12.0).alias("cf"))


MONTHS = "grouped AS (SELECT CAST(cell % 3 AS INT) AS grp, cell, year, month, value FROM v_month)"


def monthly(spark, d):
    return view(spark, d, "v_month").withColumn("grp", (F.col("cell") % 3).cast("int"))


@query(
    f"""WITH {MONTHS}, yr AS (SELECT grp, cell, year, avg(value) AS value FROM grouped GROUP BY ALL), m AS (SELECT grp, cell, avg(value) AS m FROM yr GROUP BY ALL),
    cut AS (SELECT grp, quantile_cont(m, 0.5) AS cut FROM m GROUP BY 1), best AS (SELECT m.grp, m.cell FROM m JOIN cut ON m.grp = cut.grp WHERE m.m > cut.cut),
    y AS (SELECT yr.grp, yr.year, avg(value) AS mean FROM yr JOIN best ON yr.grp = best.grp AND yr.cell = best.cell GROUP BY ALL)
    SELECT grp, year, mean / avg(mean) OVER (PARTITION BY grp) AS index FROM y""",
    "v_month",
)
def annual_wind_index(spark, d):
    """Yearly index over the best half of the cells."""
    return resource.annual_index(monthly(spark, d).groupBy("grp", "cell", "year").agg(F.avg("value").alias("value")), 0.5)


@query(
    f"""WITH {MONTHS}, m AS (SELECT grp, cell, avg(value) AS m FROM grouped GROUP BY ALL), cut AS (SELECT quantile_cont(m, 0.75) AS cut FROM m)
    SELECT g.grp, g.month, avg(g.value) AS mean FROM grouped g JOIN m ON g.grp = m.grp AND g.cell = m.cell, cut WHERE m.m > cut.cut GROUP BY ALL""",
    "v_month",
)
def seasonal_profile(spark, d):
    """Month-of-year means over the best quarter of all cells."""
    return resource.seasonal_profile(monthly(spark, d), 0.25)


@query(f"WITH {MONTHS}, yr AS (SELECT cell, year, avg(value) AS value FROM grouped GROUP BY ALL) SELECT a.year AS y1, b.year AS y2, avg(abs(a.value - b.value)) AS deviation FROM yr a JOIN yr b ON a.cell = b.cell AND a.year <> b.year GROUP BY ALL", "v_month")
def annual_deviations(spark, d):
    """Mean difference of every two years."""
    return resource.deviations(monthly(spark, d).groupBy("cell", "year").agg(F.avg("value").alias("value")))


@query("SELECT cell, avg(value) AS mean, count(*) AS n FROM v_month WHERE year BETWEEN 1996 AND 2005 GROUP BY 1", "v_month")
def ten_year_mean(spark, d):
    """Mean of the ten years that stand for a year's climate."""
    years = resource.climate_period(2010)
    return view(spark, d, "v_month").where(F.col("year").between(years[0], years[-1])).groupBy("cell").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


# Grid geometry


@query("""SELECT site_id, CAST(floor(CAST((lon + 180) AS DOUBLE) / 0.25) + 1 AS INT) AS lon_idx, CAST(least(floor((90 - lat) / 0.25) + 1, 720) AS INT) AS lat_idx,
 cos(radians(lat)) * pow(2 * pi() * 6371.0 / 360 * 0.25, 2) AS area, (floor((lon + 180) / 0.25) + 0.5) * 0.25 - 180 AS centre FROM v_site""", "v_site")  # fmt: skip
def grid_index(spark, d):
    """Pixel, its centre and its area."""
    i = grid.lon_to_row(F.col("lon"), 0.25)
    return view(spark, d, "v_site").select("site_id", i.alias("lon_idx"), grid.lat_to_col(F.col("lat"), 0.25).alias("lat_idx"), grid.cell_area_km2(F.col("lat"), 0.25).alias("area"), grid.row_to_lon(i, 0.25).alias("centre"))


@query("SELECT pixel_id, CAST((8 * CAST(lon_idx AS BIGINT) + 224) // 225 AS INT) AS era_lon, CAST((8 * CAST(lat_idx AS BIGINT) + 224) // 225 AS INT) AS era_lat FROM v_pixel", "v_pixel")
def coarse_cells(spark, d):
    """Coarse cell of a fine pixel by integers."""
    return view(spark, d, "v_pixel").select("pixel_id", grid.coarse_index(F.col("lon_idx")).alias("era_lon"), grid.coarse_index(F.col("lat_idx")).alias("era_lat"))


@query(
    """WITH lons AS (SELECT DISTINCT lon_idx FROM v_pixel WHERE region > 0 AND region <> 32767 AND (lon_idx < 20 OR lon_idx > 70)),
    g AS (SELECT lon_idx, coalesce(lead(lon_idx) OVER (ORDER BY lon_idx), min(lon_idx) OVER () + 100) AS nxt FROM lons),
    w AS (SELECT *, nxt - lon_idx AS gap FROM g ORDER BY nxt - lon_idx DESC, lon_idx DESC LIMIT 1)
    SELECT CAST((nxt - least(3, (gap - 1) // 2) - 1) % 100 + 1 AS INT) AS first_lon, CAST((lon_idx + least(3, (gap - 1) // 2) - 1) % 100 + 1 AS INT) AS last_lon FROM w""",
    "v_pixel",
)
def circular_extent(spark, d):
    """Longitudes with data, around the circle."""
    return grid.lon_extent(view(spark, d, "v_pixel").where("lon_idx < 20 or lon_idx > 70"), 100, 3)


@query("SELECT greatest(min(lat_idx) - 2, 1) AS first_lat, least(max(lat_idx) + 2, 18000) AS last_lat FROM v_pixel WHERE region > 0 AND region <> 32767", "v_pixel")
def latitude_extent(spark, d):
    """D15."""
    return grid.lat_extent(view(spark, d, "v_pixel"), 2)


@query("SELECT pixel_id, lon_idx, lat_idx FROM v_pixel WHERE (lon_idx BETWEEN 91 AND 100 OR lon_idx BETWEEN 1 AND 10)", "v_pixel")
def antimeridian_crop(spark, d):
    """A crop of two index ranges in one scan."""
    return view(spark, d, "v_pixel").where(grid.within(F.col("lon_idx"), [(91, 100), (1, 10)])).select("pixel_id", "lon_idx", "lat_idx")


@query("SELECT s_suppkey AS id, sign(x) * (floor(abs(x) / 10000) + floor((abs(x) % 10000) / 100) / 60 + (abs(x) % 100) / 3600) AS degrees FROM (SELECT s_suppkey, CAST((s_suppkey % 180 - 90) * 10000 + sign(s_suppkey % 180 - 90) * ((s_suppkey * 7 % 60) * 100 + s_suppkey * 13 % 60) AS DOUBLE) AS x FROM supplier)")
def dms(spark, d):
    """Degrees, minutes and seconds as degrees."""
    k = F.col("s_suppkey")
    whole = k % 180 - 90
    x = (whole * 10000 + F.signum(whole) * ((k * 7 % 60) * 100 + k * 13 % 60)).cast("double")
    return view(spark, d, "supplier").select(k.alias("id"), grid.dms_to_degrees(x).alias("degrees"))


@query("WITH a AS (SELECT * FROM v_plant) SELECT a.plant_id AS r1, b.plant_id AS r2, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM a, a b", "v_plant")
def region_distances(spark, d):
    """Great-circle distances of all pairs of places."""
    return spatial.distances(view(spark, d, "v_plant").select(F.col("plant_id").alias("region"), "lat", "lon"))


@query("WITH t AS (SELECT plant_id, k.range AS k, radians(lat) AS p, radians(lon) AS l, 2 * asin(sqrt(pow(sin(radians(12.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(12.5)) * pow(sin(radians(40 - lon) / 2), 2))) AS dd, k.range / 4.0 AS f FROM v_plant, range(5) k), v AS (SELECT plant_id, k, sin((1 - f) * dd) / sin(dd) AS a, sin(f * dd) / sin(dd) AS b, p, l FROM t), w AS (SELECT plant_id, k, a * cos(p) * cos(l) + b * cos(radians(12.5)) * cos(radians(40)) AS x, a * cos(p) * sin(l) + b * cos(radians(12.5)) * sin(radians(40)) AS y, a * sin(p) + b * sin(radians(12.5)) AS z FROM v) SELECT plant_id, CAST(k AS INT) AS k, degrees(atan2(z, sqrt(x * x + y * y))) AS lat, degrees(atan2(y, x)) AS lon FROM w", "v_plant")
def great_circles(spark, d):
    """Points along the great circle from each plant to one place."""
    track = grid.great_circle_track(F.col("lat"), F.col("lon"), F.lit(12.5), F.lit(40.0), 5)
    return view(spark, d, "v_plant").select("plant_id", F.posexplode(track).alias("k", "p")).select("plant_id", "k", "p.lat", "p.lon")


@query("SELECT CAST(i.range AS INT) AS lon_idx, CAST(j.range AS INT) AS lat_idx, coalesce(any_value(p.land), 0) AS land, CAST(-180 + (i.range - 0.5) * 1.8 AS DOUBLE) AS lon, CAST(90 - (j.range - 0.5) * 1.8 AS DOUBLE) AS lat FROM range(1, 201) i CROSS JOIN range(1, 101) j LEFT JOIN (SELECT lon_idx, lat_idx, land FROM v_pixel) p ON p.lon_idx = i.range AND p.lat_idx = j.range GROUP BY i.range, j.range", "v_pixel")
def uncropped(spark, d):
    """A crop on its whole grid again, with coordinates."""
    spec = grid.GridSpec(1.8)
    lon, lat = grid.axes(spark, spec)
    whole = grid.uncrop(view(spark, d, "v_pixel").select("lon_idx", "lat_idx", "land"), spec)
    return whole.join(lon, "lon_idx").join(lat.drop("area_km2"), "lat_idx").select("lon_idx", "lat_idx", "land", "lon", "lat")


@query("SELECT n_nationkey AS id, 1896 + n_nationkey * 4 + n_nationkey % 3 AS y, (1896 + n_nationkey * 4 + n_nationkey % 3) % 4 = 0 AND (1896 + n_nationkey * 4 + n_nationkey % 3) % 100 <> 0 OR (1896 + n_nationkey * 4 + n_nationkey % 3) % 400 = 0 AS leap FROM nation")
def leap_years(spark, d):
    """D19."""
    y = 1896 + F.col("n_nationkey") * 4 + F.col("n_nationkey") % 3
    return view(spark, d, "nation").select(F.col("n_nationkey").alias("id"), y.alias("y"), grid.leap_year(y).alias("leap"))


@query("WITH c AS (SELECT p.plant_id, s.site_id, pow(p.lon - s.lon, 2) + pow(p.lat - s.lat, 2) AS d2 FROM v_plant p JOIN v_site s ON pow(p.lon - s.lon, 2) + pow(p.lat - s.lat, 2) < 25.0), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY d2, site_id) = 1) SELECT plant_id AS cell, CAST(h.range AS INT) AS hour, CASE WHEN b.site_id IS NULL THEN NULL ELSE CAST(b.site_id % 7 + h.range AS DOUBLE) END AS value FROM v_plant LEFT JOIN b USING (plant_id) CROSS JOIN range(3) h", "v_plant", "v_site")
def regridded_series(spark, d):
    """hourly series of a curvilinear grid on a regular one, by the nearest cell within a cut-off."""
    cells = view(spark, d, "v_plant").select(F.col("plant_id").alias("cell"), "lon", "lat")
    source = view(spark, d, "v_site").select(F.col("site_id").alias("source_cell"), "lon", "lat")
    series = source.select("source_cell", F.array(*[(F.col("source_cell") % 7 + h).cast("double") for h in range(3)]).alias("series"))
    on_grid = spatial.regridded(cells, source, series, 2.5, 4.0)
    return on_grid.select("cell", F.posexplode(F.coalesce("series", F.array_repeat(F.lit(None).cast("double"), 3))).alias("hour", "value"))


@query(f"WITH {CURVE}, s AS (SELECT plant_id AS site_id, plant_id % 50 AS cell, 6.0 + plant_id % 5 AS atlas FROM v_plant), a AS (SELECT cell, avg(value) AS mean_all FROM v_month GROUP BY 1), h AS (SELECT s.site_id, m.year, m.value * s.atlas / a.mean_all AS v FROM s JOIN v_month m ON s.cell = m.cell JOIN a ON a.cell = s.cell WHERE m.year IN (1996, 1997, 1999)), y AS (SELECT site_id, year, avg(v) AS speed, avg({CF.format(x='v')}) AS cf FROM h LEFT JOIN curve c0 ON c0.v = floor(h.v) LEFT JOIN curve c1 ON c1.v = floor(h.v) + 1 GROUP BY ALL) SELECT site_id, avg(speed) AS speed, avg(cf) AS cf FROM y GROUP BY 1".replace("avg(v) AS speed", "avg(h.v) AS speed").replace("CASE WHEN v >= 0 AND v < 29 THEN (1 - (v - floor(v))) * c0.c + (v - floor(v)) * c1.c", "CASE WHEN h.v >= 0 AND h.v < 29 THEN (1 - (h.v - floor(h.v))) * c0.c + (h.v - floor(h.v)) * c1.c"), "v_plant", "v_month")
def site_years(spark, d):
    """Speed and capacity factor of points, the mean of some years."""
    m = view(spark, d, "v_month")
    cells = m.join(m.groupBy("cell").agg(F.avg("value").alias("mean_all")), "cell")
    sites = view(spark, d, "v_plant").select(F.col("plant_id").alias("site_id"), (F.col("plant_id") % 50).alias("cell"), (6.0 + F.col("plant_id") % 5).alias("atlas"))
    return resource.site_cf_years(sites, cells, [1996, 1997, 1999], ["cell"])


@query("SELECT s_nationkey AS country, s_acctbal AS capacity_mw, CAST(s_suppkey AS DOUBLE) AS lat, CAST(s_suppkey % 9 AS DOUBLE) AS lon FROM supplier WHERE s_suppkey % 3 = 0")
def hydro_register(spark, d):
    """Plants of one fuel; rows whose fuel is missing are out."""
    k = F.col("s_suppkey")
    fuel = F.when(k % 3 == 0, "Hydro").when(k % 3 == 1, "Wind")
    return tables.fuel(view(spark, d, "supplier").select(F.col("s_nationkey").alias("country"), F.col("s_acctbal").alias("capacity_mw"), k.cast("double").alias("latitude"), (k % 9).cast("double").alias("longitude"), fuel.alias("fuel1")))


# Rasters

#: The grid has this many rows at least.
ROWS = 20
GRID = "g AS (SELECT lon_idx, lat_idx, min(region) AS region, min(land) AS land, sum(popdens) AS value FROM v_pixel GROUP BY ALL), hh AS (SELECT greatest(20, max(lat_idx)) AS h FROM g)"


def whole_grid(spark, d):
    """Every pixel of the table."""
    return view(spark, d, "v_pixel").groupBy("lon_idx", "lat_idx").agg(F.min("region").alias("region"), F.min("land").alias("land"), F.sum("popdens").alias("value"))


def height(g: DataFrame) -> int:
    """Rows of a grid."""
    return max(ROWS, g.agg(F.max("lat_idx")).first()[0] or 0)


@query(f"WITH {GRID}, h AS (SELECT * FROM g WHERE region > 0 AND region <> 32767) SELECT DISTINCT a.region AS r1, b.region AS r2 FROM h a JOIN h b ON abs(a.lon_idx - b.lon_idx) <= 1 AND abs(a.lat_idx - b.lat_idx) <= 1", "v_pixel")
def region_adjacency(spark, d):
    """Regions that touch."""
    return raster.adjacency(whole_grid(spark, d))


@query(f"WITH {GRID} SELECT (lon_idx - 1) // 3 + 1 AS lon_idx, (lat_idx - 1) // 3 + 1 AS lat_idx, sum(value) AS value FROM g, hh WHERE lon_idx <= 99 AND lat_idx <= h // 3 * 3 GROUP BY ALL", "v_pixel")
def block_sums(spark, d):
    """Sums over blocks."""
    g = whole_grid(spark, d)
    return raster.block_sum(g, 3, 100, height(g))


@query(f"WITH {GRID}, c AS (SELECT CAST((lon_idx - 1) // 10 AS BIGINT) AS bi, CAST((lat_idx - 1) // 5 AS BIGINT) AS bj, land, count(*) AS n FROM g GROUP BY ALL) SELECT bi, bj, land FROM c QUALIFY row_number() OVER (PARTITION BY bi, bj ORDER BY n DESC, land) = 1", "v_pixel")
def mode_resample(spark, d):
    """Most frequent code of each coarse cell."""
    g = whole_grid(spark, d).select(F.floor((F.col("lon_idx") - 1) / 10).alias("bi"), F.floor((F.col("lat_idx") - 1) / 5).alias("bj"), "land")
    return raster.mode_by(g, ["bi", "bj"], "land")


@query(f"WITH {GRID} SELECT region, CAST((8 * CAST(lon_idx AS BIGINT) + 224) // 225 AS INT) AS era_lon, sum(value) AS population FROM g GROUP BY ALL", "v_pixel")
def population_to_coarse(spark, d):
    """Population by region and coarse cell."""
    g = whole_grid(spark, d).withColumn("era_lon", grid.coarse_index(F.col("lon_idx"))).withColumnRenamed("value", "population")
    return raster.zonal_sum(g, ["region", "era_lon"], "population")


@query(f"WITH {GRID} SELECT a.lon_idx, a.lat_idx, sum(b.value) / 4 AS value FROM g a JOIN g b ON b.lon_idx - a.lon_idx BETWEEN 0 AND 1 AND b.lat_idx - a.lat_idx BETWEEN 0 AND 1 GROUP BY ALL HAVING count(*) = 4", "v_pixel")
def half_cell_shift(spark, d):
    """Mean of four neighbours."""
    return raster.half_cell_shift(whole_grid(spark, d).select("lon_idx", "lat_idx", "value"))


DISK = "k(a, b, w) AS (VALUES " + ", ".join(f"({a}, {b}, CAST({w!r} AS DOUBLE))" for a, b, w in raster.offsets(raster.disk_kernel(2.3))) + ")"


@query(f"WITH {GRID}, {DISK} SELECT g.lon_idx, g.lat_idx, sum(coalesce(n.value, 0) * w) AS value FROM g CROSS JOIN k CROSS JOIN hh LEFT JOIN g n ON n.lon_idx = least(greatest(g.lon_idx + a, 1), 100) AND n.lat_idx = least(greatest(g.lat_idx + b, 1), hh.h) GROUP BY ALL", "v_pixel")
def disk_mean_joins(spark, d):
    """Disk mean by shifted joins."""
    g = whole_grid(spark, d).select("lon_idx", "lat_idx", "value")
    return raster.disk_mean_small(g, 2.3, 100, height(g))


@query(f"WITH {GRID}, {DISK} SELECT g.lon_idx, g.lat_idx, sum(coalesce(n.value, 0) * w) AS value FROM g CROSS JOIN k CROSS JOIN hh LEFT JOIN g n ON n.lon_idx = least(greatest(g.lon_idx + a, 1), 100) AND n.lat_idx = least(greatest(g.lat_idx + b, 1), hh.h) GROUP BY ALL", "v_pixel")
def disk_mean_tiles(spark, d):
    """The same on tiles with a halo."""
    g = whole_grid(spark, d).select("lon_idx", "lat_idx", "value")
    return raster.disk_mean(g, 2.3, 100, height(g), tile=16)


@query(f"WITH {GRID} SELECT a.lon_idx, a.lat_idx, CASE WHEN any_value(a.land) = 0 THEN max(b.land) ELSE any_value(a.land) END AS land FROM g a JOIN g b ON abs(a.lon_idx - b.lon_idx) <= 1 AND abs(a.lat_idx - b.lat_idx) <= 1 GROUP BY ALL", "v_pixel")
def fill_from_neighbours(spark, d):
    """Zero pixels take the largest value around."""
    g = whole_grid(spark, d).select("lon_idx", "lat_idx", "land")
    return raster.fill_zeros_from_neighbours(g, 100, height(g), "land").select("lon_idx", "lat_idx", F.col("land").cast("int").alias("land"))


SEEDS = f"{GRID}, s AS (SELECT lon_idx, lat_idx, CASE WHEN land % 7 = 0 THEN region ELSE 0 END AS region FROM g)"


@query(f"WITH {SEEDS} SELECT a.lon_idx, a.lat_idx, arg_min(b.region, (CAST((a.lon_idx - b.lon_idx) AS BIGINT) * (a.lon_idx - b.lon_idx) + (a.lat_idx - b.lat_idx) * (a.lat_idx - b.lat_idx)) * 1000000 + b.region) AS region FROM s a, s b WHERE b.region > 0 GROUP BY ALL", "v_pixel")
def nearest_fill(spark, d):
    """Every pixel takes the nearest region."""
    g = whole_grid(spark, d).select("lon_idx", "lat_idx", F.when(F.col("land") % 7 == 0, F.col("region")).otherwise(0).alias("region"))
    return raster.nearest_fill(g)


@query(f"WITH {GRID} SELECT lon_idx, lat_idx, CASE WHEN land > 0 THEN region ELSE 0 END AS onshore, CASE WHEN land = 0 THEN region ELSE 0 END AS offshore FROM g", "v_pixel")
def shore_split(spark, d):
    """E5, K3: land and sea of a territory."""
    on, off = raster.split_shore(F.col("region"), F.col("land"))
    return whole_grid(spark, d).select("lon_idx", "lat_idx", on.alias("onshore"), off.alias("offshore"))


@query("SELECT lon_idx, lat_idx, max(protected) AS protected FROM v_pixel GROUP BY ALL", "v_pixel")
def merged_protection(spark, d):
    """Highest code of layers."""
    p = view(spark, d, "v_pixel")
    return raster.merged_layers(*(p.where(F.col("pixel_id") % 3 == k).select("lon_idx", "lat_idx", "protected") for k in range(3)))


@query("SELECT pixel_id, CASE WHEN popdens > 0 THEN abs(topo) * 1000 / popdens * (218.056 / 195.3 * 1000) ELSE 0.0 END AS gdppc FROM v_pixel", "v_pixel")
def gdp_per_capita(spark, d):
    """E14."""
    return view(spark, d, "v_pixel").select("pixel_id", raster.gdp_per_capita(F.abs("topo") * 1000, F.col("popdens")).alias("gdppc"))


@query(f"WITH {GRID}, c AS (SELECT (lon_idx - 1) // 4 + 1 AS ci, (lat_idx - 1) // 4 + 1 AS cj, max(land) AS k FROM g GROUP BY ALL) SELECT g.lon_idx, g.lat_idx, c.k * g.value AS spread FROM g JOIN c ON (g.lon_idx - 1) // 4 + 1 = c.ci AND (g.lat_idx - 1) // 4 + 1 = c.cj", "v_pixel")
def spread_to_fine(spark, d):
    """A coarse value on fine pixels."""
    g = whole_grid(spark, d)
    coarse = g.groupBy((F.floor((F.col("lon_idx") - 1) / 4) + 1).cast("int").alias("lon_idx"), (F.floor((F.col("lat_idx") - 1) / 4) + 1).cast("int").alias("lat_idx")).agg(F.max("land").alias("k"))
    return raster.spread_to_fine(coarse, g, 4, "k", "value", "spread").select("lon_idx", "lat_idx", "spread")


#: Weights of the neighbours da of a half a of a pixel, by linear and by cubic interpolation.
LINEAR = "f(a, da, w) AS (VALUES (0, -1, 0.25), (0, 0, 0.75), (1, 0, 0.75), (1, 1, 0.25))"
CUBIC = "f(a, da, w) AS (VALUES (0, -2, -0.0234375), (0, -1, 0.2265625), (0, 0, 0.8671875), (0, 1, -0.0703125), (1, -1, -0.0703125), (1, 0, 0.8671875), (1, 1, 0.2265625), (1, 2, -0.0234375))"
FINER = "SELECT (g.lon_idx - 1) * 2 + i.a + 1 AS lon_idx, (g.lat_idx - 1) * 2 + j.a + 1 AS lat_idx, sum(coalesce(n.value, 0) * i.w * j.w) AS value FROM g CROSS JOIN f i CROSS JOIN f j CROSS JOIN hh LEFT JOIN g n ON n.lon_idx = least(greatest(g.lon_idx + i.da, 1), 100) AND n.lat_idx = least(greatest(g.lat_idx + j.da, 1), hh.h) GROUP BY ALL"


@query(f"WITH {GRID}, {LINEAR} {FINER}", "v_pixel")
def bilinear_resample(spark, d):
    """Interpolation to twice the resolution."""
    g = whole_grid(spark, d).select("lon_idx", "lat_idx", "value")
    return raster.bilinear(g, 2, 100, height(g))


@query(f"WITH {GRID}, {CUBIC} {FINER}", "v_pixel")
def cubic_resample(spark, d):
    """Cubic interpolation to twice the resolution."""
    g = whole_grid(spark, d).select("lon_idx", "lat_idx", "value")
    return raster.bicubic(g, 2, 100, height(g))


@query(f"WITH {GRID}, {CUBIC}, fine AS ({FINER}), c AS (SELECT *, (lon_idx + 1) // 2 AS ci, (lat_idx + 1) // 2 AS cj, greatest(value, 0) AS v FROM fine), t AS (SELECT *, sum(v) OVER (PARTITION BY ci, cj) AS s FROM c) SELECT t.lon_idx, t.lat_idx, CASE WHEN s = 0 THEN 0.25 ELSE v / s END * g.value AS value FROM t JOIN g ON g.lon_idx = ci AND g.lat_idx = cj", "v_pixel")
def population_downscaled(spark, d):
    """Population on finer pixels; every coarse pixel keeps its total."""
    g = whole_grid(spark, d).select("lon_idx", "lat_idx", "value")
    return raster.downscaled(g, 2, 100, height(g))


@query(f"WITH {GRID}, x(k) AS (SELECT unnest(range(1, 41))), y(k) AS (SELECT unnest(range(1, 100000))), ox AS (SELECT i.range AS lon_idx, x.k, least(i.range * 4, x.k * 10) - greatest((i.range - 1) * 4, (x.k - 1) * 10) AS w FROM range(1, 101) i JOIN x ON least(i.range * 4, x.k * 10) > greatest((i.range - 1) * 4, (x.k - 1) * 10)) SELECT CAST(ox.k AS INT) AS lon_idx, CAST((g.lat_idx + 1) // 2 AS INT) AS lat_idx, sum(value * ox.w / 10.0 / 2) AS value FROM g JOIN ox ON g.lon_idx = ox.lon_idx GROUP BY ALL", "v_pixel")
def coarse_resize(spark, d):
    """Another size, where new pixels cover old ones in part."""
    g = whole_grid(spark, d).select("lon_idx", "lat_idx", "value")
    h = height(g) // 2 * 2
    return raster.resized(g, 100, h, 40, h // 2)


@query(f"WITH {GRID}, {REACH_SQL} SELECT g.lon_idx, g.lat_idx, CASE WHEN sum(CASE WHEN n.value > 280 THEN w ELSE 0 END) < 1e-6 THEN CAST(0 AS DOUBLE) ELSE CAST(round(sum(CASE WHEN n.value > 280 THEN w ELSE 0 END), 3) AS DOUBLE) END AS gridaccess FROM g CROSS JOIN k1 CROSS JOIN hh LEFT JOIN g n ON n.lon_idx = least(greatest(g.lon_idx + a, 1), 100) AND n.lat_idx = least(greatest(g.lat_idx + b, 1), hh.h) GROUP BY ALL", "v_pixel")
def grid_access(spark, d):
    """Access to the grid from economic activity around."""
    g = whole_grid(spark, d).select("lon_idx", "lat_idx", F.col("value").alias("gdp"))
    return raster.grid_access(g, REACH, 100, height(g), 280).withColumn("gridaccess", F.round("gridaccess", 3))


@query(f"WITH {GRID}, m AS (SELECT lon_idx, lat_idx, land, CASE WHEN land % 4 = 0 THEN 0 WHEN land % 4 = 1 THEN 32767 ELSE region END AS r FROM g), t AS (SELECT a.lon_idx, a.lat_idx, any_value(a.land) AS land, arg_min(b.r, (CAST((a.lon_idx - b.lon_idx) AS BIGINT) * (a.lon_idx - b.lon_idx) + (a.lat_idx - b.lat_idx) * (a.lat_idx - b.lat_idx)) * 1000000 + b.r) AS r FROM m a JOIN m b ON b.r > 0 AND abs(a.lon_idx - b.lon_idx) <= 8 AND abs(a.lat_idx - b.lat_idx) <= 8 GROUP BY 1, 2) SELECT lon_idx, lat_idx, CASE WHEN land > 0 THEN r ELSE 0 END AS region, CASE WHEN land = 0 THEN r ELSE 0 END AS offshore FROM t", "v_pixel")
def saved_regions(spark, d):
    """Foreign land marked, the sea filled from the nearest land, split at the shore."""
    g = whole_grid(spark, d)
    foreign = F.col("land") % 4
    px = g.select("lon_idx", "lat_idx", F.when(foreign < 2, 0).otherwise(F.col("region")).alias("region"), F.when(foreign == 1, 5).otherwise(0).alias("admin_uid"), "land")
    return regions.saved_regions(px)


@query(f"WITH {PIXELS}, l AS (SELECT region, lat, lon, popdens, land % 10 / 10.0 AS share FROM px WHERE region > 0 AND region <> 32767), c AS (SELECT region, sum(lat * popdens) / sum(popdens) AS y, sum(lon * popdens) / sum(popdens) AS x FROM l GROUP BY 1), s AS (SELECT l.*, 0.1 * 2 * 6371.0 * asin(sqrt(pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lon) / 2), 2))) / 10000 + 0.9 * (1 - share) AS score FROM l JOIN c USING (region)) SELECT region, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM s QUALIFY row_number() OVER (PARTITION BY region ORDER BY score, lat, lon) = 1", "v_pixel")
def land_near_centre(spark, d):
    """The pixel with much land around it near a region's centre."""
    p = pixels(spark, d).where("region > 0 AND region <> 32767").select("region", "lat", "lon", "popdens", (F.col("land") % 10 / 10.0).alias("landshare"))
    return regions.land_near_centre(p, regions.centres(p))


@query()
def population_centres(spark, d):
    """Greedy centres; tested against brute force."""
    return raster.population_centres(whole_grid(spark, d).where("region > 0").withColumnRenamed("value", "population"), 3, 3.3)


# Regions and spatial joins

EUROPE = [("r1", regions.Admin(("EUROPE",))), ("r2", regions.Admin(("ASIA",), ("NATION_7", "NATION_12"))), ("r3", (regions.Admin(("AMERICA",), ("NATION_6",)), regions.Admin(("ASIA",), ("NATION_17",))))]


@query("SELECT uid, n0, n1, CASE WHEN n0 = 'EUROPE' THEN 1 WHEN n0 = 'ASIA' AND n1 IN ('NATION_7', 'NATION_12') THEN 2 WHEN n0 = 'AMERICA' AND n1 = 'NATION_6' OR n0 = 'ASIA' AND n1 = 'NATION_17' THEN 3 ELSE 0 END AS region FROM v_region_name", "v_region_name")
def admin_lookup(spark, d):
    """Region of a place by the hierarchy."""
    places = view(spark, d, "v_region_name").withColumn("n2", F.lit(None).cast("string"))
    return regions.lookup_admin(places, regions.definitions(spark, EUROPE)).select("uid", "n0", "n1", "region")


CODES = [("a", regions.Statistical(("EU", "AS1"))), ("b", regions.Statistical(("AS", "EU2"))), ("c", regions.Statistical(("EU21",)))]
CODE_SQL = "codes AS (SELECT n_nationkey AS uid, substr(r_name, 1, 2) || CAST(n_nationkey AS VARCHAR) AS code FROM nation JOIN region ON n_regionkey = r_regionkey)"


def codes(spark, d):
    r = view(spark, d, "region")
    return view(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("uid"), F.concat(F.substring("r_name", 1, 2), F.col("n_nationkey").cast("string")).alias("code"))


@query(f"WITH {CODE_SQL} SELECT uid, code, CASE WHEN code LIKE 'EU21%' THEN 3 WHEN code LIKE 'EU2%' THEN 2 WHEN code LIKE 'AS1%' THEN 1 WHEN code LIKE 'EU%' THEN 1 WHEN code LIKE 'AS%' THEN 2 ELSE 0 END AS region FROM codes")
def code_lookup(spark, d):
    """Region by the longest beginning of a code."""
    return regions.lookup_codes(codes(spark, d), regions.definitions(spark, CODES))


@query("SELECT DISTINCT n1 AS name FROM v_region_name WHERE n0 = 'EUROPE'", "v_region_name")
def subregions(spark, d):
    """Names below a place."""
    return regions.subregions(view(spark, d, "v_region_name"), "EUROPE")


@query(f"WITH {CODE_SQL} SELECT DISTINCT code AS name FROM codes WHERE starts_with(code, 'AS')")
def code_subregions(spark, d):
    """Codes with a beginning."""
    return regions.code_subregions(codes(spark, d), "AS")


@query("SELECT DISTINCT n0, CASE WHEN uid % 3 = 0 THEN n0 ELSE n1 END AS name FROM v_region_name", "v_region_name")
def all_subregions(spark, d):
    """Places at a level, or their ancestors."""
    return regions.all_subregions(view(spark, d, "v_region_name").withColumn("n1", F.when(F.col("uid") % 3 == 0, "").otherwise(F.col("n1"))), 1)


GROUPS = {"OECD": ["NATION_6", "NATION_7", "NATION_12", "NATION_3"], "ASIA": ["NATION_18", "NATION_8", "NATION_9"]}


@query("SELECT n_name AS country, CASE WHEN n_name IN ('NATION_6', 'NATION_7', 'NATION_12', 'NATION_3') THEN 'OECD' WHEN n_name IN ('NATION_18', 'NATION_8', 'NATION_9') THEN 'ASIA' ELSE '' END AS grp FROM nation")
def scenario_groups(spark, d):
    """Scenario group of a country."""
    return regions.grouped_countries(GROUPS, view(spark, d, "nation").select(F.col("n_name").alias("country")), spark)


@query(f"WITH {PIXELS} SELECT region, avg(CAST(lat AS DOUBLE)) AS lat, avg(CAST(lon AS DOUBLE)) AS lon, sum(lat * popdens) / sum(popdens) AS pop_lat, sum(lon * popdens) / sum(popdens) AS pop_lon FROM px WHERE region > 0 AND region <> 32767 GROUP BY 1", "v_pixel")
def region_centres(spark, d):
    """Centres of regions."""
    return regions.centres(pixels(spark, d))


COARSE_REGIONS = "reg AS (SELECT CAST(range AS INT) % 360 + 1 AS lon_idx, CAST(range AS INT) // 360 + 1 AS lat_idx, CASE WHEN (range * 7919) % 5 = 0 THEN 1 + (range * 31) % 9 ELSE 0 END AS region FROM range(64800))"


def coarse_regions(spark):
    k = F.col("id")
    return spark.range(64800).select((k % 360 + 1).cast("int").alias("lon_idx"), (F.floor(k / 360) + 1).cast("int").alias("lat_idx"), F.when((k * 7919) % 5 == 0, 1 + (k * 31) % 9).otherwise(0).cast("int").alias("region"))


@query(
    f"""WITH {COARSE_REGIONS}, pts AS (SELECT *, CAST(floor(lon + 180) + 1 AS INT) AS i, CAST(greatest(ceil(90 - lat), 1) AS INT) AS j FROM v_plant),
    near AS (SELECT a.plant_id, max(r.region) AS region FROM pts a JOIN reg r ON abs(r.lon_idx - a.i) <= 2 AND abs(r.lat_idx - a.j) <= 2 GROUP BY 1)
    SELECT a.plant_id, CAST(CASE WHEN o.region IS NULL THEN 0 WHEN o.region > 0 THEN o.region ELSE coalesce(n.region, 0) END AS INT) AS region FROM pts a LEFT JOIN reg o ON o.lon_idx = a.i AND o.lat_idx = a.j LEFT JOIN near n USING (plant_id)""",
    "v_plant",
)
def plant_region(spark, d):
    """region of a point, or the largest one around it."""
    return spatial.point_region(view(spark, d, "v_plant"), coarse_regions(spark), 1.0).select("plant_id", "region")


@query(
    f"""WITH {COARSE_REGIONS}, pts AS (SELECT *, CAST(floor(lon + 180) + 1 AS INT) AS i, CAST(greatest(ceil(90 - lat), 1) AS INT) AS j FROM v_plant)
    SELECT a.plant_id, CAST(CASE WHEN o.region % 2 = 1 THEN o.region WHEN o.region > 0 THEN o.region + 100 ELSE 32767 END AS INT) AS region, coalesce(o.region % 2 = 1, false) AS onshore FROM pts a LEFT JOIN reg o ON o.lon_idx = a.i AND o.lat_idx = a.j""",
    "v_plant",
)
def plant_region_offshore(spark, d):
    """region of a point, else its offshore region, else NOREGION."""
    r = coarse_regions(spark)
    on = r.withColumn("region", F.when(F.col("region") % 2 == 1, F.col("region")).otherwise(0))
    off = r.withColumn("region", F.when((F.col("region") > 0) & (F.col("region") % 2 == 0), F.col("region") + 100).otherwise(0))
    return spatial.point_region_offshore(view(spark, d, "v_plant"), on, off, 1.0).select("plant_id", "region", "onshore")


@query("WITH c AS (SELECT p.plant_id, s.site_id, 111.0 * sqrt(pow(p.lon - s.lon, 2) + pow(p.lat - s.lat, 2)) AS km FROM v_plant p, v_site s) SELECT plant_id, site_id, km FROM c QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY km, site_id) = 1", "v_plant", "v_site")
def nearest_site(spark, d):
    """Nearest of few sites."""
    return spatial.nearest_few(view(spark, d, "v_plant"), view(spark, d, "v_site").select("site_id", "lon", "lat"), "plant_id", "site_id").select("plant_id", "site_id", "km")


@query("WITH c AS (SELECT p.plant_id, s.site_id, pow(p.lon - s.lon, 2) + pow(p.lat - s.lat, 2) AS d2 FROM v_plant p JOIN v_site s ON pow(p.lon - s.lon, 2) + pow(p.lat - s.lat, 2) < 25.0) SELECT plant_id, b.site_id, sqrt(b.d2) AS degrees FROM v_plant LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY d2, site_id) = 1) b USING (plant_id)", "v_plant", "v_site")
def nearest_site_within(spark, d):
    """nearest site within a cut-off, by cells."""
    return spatial.nearest_within(view(spark, d, "v_plant"), view(spark, d, "v_site"), "plant_id", "site_id", 5.0).select("plant_id", "site_id", "degrees")


@query("""WITH p AS (SELECT plant_id, lon, lat FROM v_plant) SELECT plant_id AS point_id,
 CASE WHEN lon BETWEEN -100 AND 20 AND lat BETWEEN -60 AND 0 THEN 1 WHEN lat > 0 AND lat < 80 AND lon > -170 AND lon < 170 AND lat < 80 - abs(lon) * 80 / 170 THEN 2 ELSE 0 END AS poly_id FROM p""", "v_plant")  # fmt: skip
def polygon_join(spark, d):
    """First polygon that holds a point: a box, then a triangle."""
    shapes = [(1, [(-100.0, -60.0), (20.0, -60.0), (20.0, 0.0), (-100.0, 0.0)]), (2, [(-170.0, 0.0), (170.0, 0.0), (0.0, 80.0)])]
    polygons = spark.createDataFrame(shapes, "poly_id int, ring array<struct<x: double, y: double>>")
    points = view(spark, d, "v_plant").select(F.col("plant_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.point_in_polygons(points, polygons, 30.0).select("point_id", F.col("poly_id").cast("int").alias("poly_id"))


@query("""WITH s AS (SELECT min(site_id) AS site_id, lon, lat FROM v_site GROUP BY lon, lat), p AS (SELECT pixel_id, land, CAST(pixel_id % 360 - 179.6 AS DOUBLE) AS lon, CAST(pixel_id % 170 - 84.3 AS DOUBLE) AS lat FROM v_pixel),
 n AS (SELECT p.pixel_id, p.land, s.site_id FROM p, s QUALIFY row_number() OVER (PARTITION BY p.pixel_id ORDER BY 111.0 * sqrt(pow(p.lon - s.lon, 2) + pow(p.lat - s.lat, 2)), s.site_id) = 1)
 SELECT s.site_id, count(n.pixel_id) FILTER (WHERE land > 0) AS onshore, count(n.pixel_id) FILTER (WHERE land = 0) AS offshore FROM v_site s LEFT JOIN n ON s.site_id = n.site_id GROUP BY 1""", "v_site", "v_pixel")  # fmt: skip
def service_areas(spark, d):
    """Sizes of the areas nearest to each site."""
    px = view(spark, d, "v_pixel").select("pixel_id", "land", (F.col("pixel_id") % 360 - 179.6).cast("double").alias("lon"), (F.col("pixel_id") % 170 - 84.3).cast("double").alias("lat"))
    sites = view(spark, d, "v_site").select("site_id", "lon", "lat")
    return spatial.area_sizes(spatial.service_areas(px, sites), sites)


@query("SELECT CAST(i AS INT) AS lon_idx, CAST(j AS INT) AS lat_idx, CAST(CASE WHEN i BETWEEN 3 AND 10 AND j BETWEEN 5 AND 9 THEN 1 ELSE 2 END AS INT) AS poly_id FROM (SELECT unnest(range(1, 41)) AS i), (SELECT unnest(range(1, 41)) AS j) WHERE (i BETWEEN 3 AND 10 AND j BETWEEN 5 AND 9) OR (j - 0.5 >= 4 AND j - 0.5 <= 24 AND abs(i - 0.5 - 20.1) < (24 - (j - 0.5)) / 2.0)")
def rasterized_polygons(spark, d):
    """Pixels of polygons: a box, then a triangle."""
    shapes = [(1, [(2.0, -4.0), (10.0, -4.0), (10.0, -9.0), (2.0, -9.0)]), (2, [(10.1, -4.0), (30.1, -4.0), (20.1, -24.0)])]
    return spatial.rasterized(spark.createDataFrame(shapes, "poly_id int, ring array<struct<x: double, y: double>>"), 1.0, 0.0, 0.0)


@query("WITH p AS (SELECT region AS bus, popdens, land, protected FROM v_pixel), n AS (SELECT bus, land, count(*) AS n FROM p GROUP BY ALL) SELECT p.bus, sum(popdens) AS pop, count(*) AS pixels, (SELECT arg_min(land, (-n.n, land)) FROM n WHERE n.bus = p.bus) AS main_land FROM p GROUP BY p.bus", "v_pixel")
def bus_statistics(spark, d):
    """Sums and the most frequent code of each bus."""
    p = view(spark, d, "v_pixel").withColumnRenamed("region", "bus")
    return p.groupBy("bus").agg(F.sum("popdens").alias("pop"), F.count("*").alias("pixels")).join(raster.mode_by(p, ["bus"], "land").withColumnRenamed("land", "main_land"), "bus")


@query("SELECT p.pixel_id, p.atlas AS first_atlas, q.atlas AS second_atlas FROM v_pixel p JOIN v_pixel q ON p.lon_idx = q.lon_idx + 1 AND p.lat_idx = q.lat_idx WHERE p.region = 1 AND p.land NOT IN (0, 11, 13)", "v_pixel")
def atlas_pairs(spark, d):
    """Two aligned layers side by side."""
    p = view(spark, d, "v_pixel")
    good = p.where("region = 1").where(~F.col("land").isin(*WindOptions().exclude_landtypes))
    return relational.side_by_side(good, p, "atlas", ("first_atlas", "second_atlas"), (1, 0)).select("pixel_id", "first_atlas", "second_atlas")


@query("WITH c(region, centre, era_lon) AS (VALUES (1, 1, 1), (1, 2, 3), (2, 1, 4)) SELECT region, hour, max(value) FILTER (WHERE centre = 1) AS temp1, avg(value) AS temp_top3 FROM c JOIN v_cell_hour v ON v.era_lon = c.era_lon GROUP BY ALL", "v_cell_hour")
def centre_temperatures(spark, d):
    """Hourly temperature at the centres of regions."""
    centres = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 3, 1), (2, 1, 4, 1)], "region int, centre int, era_lon int, era_lat int")
    cells = view(spark, d, "v_cell_hour").withColumn("era_lat", F.lit(1))
    return entry.top_temperatures(entry.temperatures(centres, cells))


@query("WITH g AS (SELECT CAST(s_suppkey // 10 AS INT) AS \"row\", CAST(s_suppkey % 10 AS INT) AS col, s_suppkey // 10 * 0.3 + s_suppkey % 10 * 0.05 AS lat, s_suppkey % 10 * 0.4 + s_suppkey * 0.01 AS lon FROM supplier) SELECT a.\"row\", a.col, min(sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2))) AS spacing FROM g a JOIN g b ON abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.col - b.col) <= 1 AND (a.\"row\" <> b.\"row\" OR a.col <> b.col) GROUP BY ALL")
def grid_spacing(spark, d):
    """Least spacing of a curvilinear grid."""
    k = F.col("s_suppkey")
    g = view(spark, d, "supplier").select(F.floor(k / 10).cast("int").alias("row"), (k % 10).cast("int").alias("col"), (k % 10 * 0.4 + k * 0.01).cast("double").alias("lon"), (F.floor(k / 10) * 0.3 + k % 10 * 0.05).cast("double").alias("lat"))
    return raster.local_spacing(g)


# Turbines

TURBINES = "t AS (SELECT pixel_id, count(*) AS nturbines, max(yr) AS turbineyear, sum(capac_kw) AS turbinecapac FROM v_turbine GROUP BY 1), pt AS (SELECT px.*, coalesce(t.nturbines, 0) AS nturbines, coalesce(t.turbineyear, 0) AS turbineyear, coalesce(t.turbinecapac, 0.0) AS turbinecapac FROM px LEFT JOIN t USING (pixel_id))"


def turbine_pixels(spark, d):
    return turbines.pixel_table(pixels(spark, d), view(spark, d, "v_turbine"))


@query(f"WITH {PIXELS}, {TURBINES} SELECT pixel_id, nturbines, turbineyear, turbinecapac, round(area_km2, 4) AS area FROM pt", "v_pixel", "v_turbine")
def pixel_turbines(spark, d):
    """Turbines of every pixel."""
    return turbine_pixels(spark, d).select("pixel_id", "nturbines", "turbineyear", "turbinecapac", F.round("area_km2", 4).alias("area"))


IN_YEARS = "turbineyear BETWEEN 1993 AND 1997"


@query(
    f"""WITH {PIXELS}, {TURBINES} SELECT region, protected, sum(area_km2) / 1000 AS area, CAST(sum(CASE WHEN {IN_YEARS} THEN nturbines ELSE 0 END) AS BIGINT) AS nturbines, sum(CASE WHEN {IN_YEARS} THEN turbinecapac / 1000 ELSE 0.0 END) AS capac_mw,
    sum(CASE WHEN {IN_YEARS} THEN turbinecapac / 1000 ELSE 0.0 END) / sum(area_km2) AS density FROM pt GROUP BY GROUPING SETS ((region, protected), (region))""",
    "v_pixel", "v_turbine",
)
def turbines_by_protection(spark, d):
    """Turbines by region and code, with totals."""
    return turbines.by_code(turbine_pixels(spark, d), ["region", "protected"], 1993, 1997, "region")


BREAKS = scalar.density_breaks()


@query(
    f"""WITH {PIXELS}, {TURBINES}, b(bin, low, high) AS (VALUES {", ".join(f"({k}, CAST({x!r} AS DOUBLE), CAST({BREAKS[k + 1]!r} AS DOUBLE))" if k + 1 < len(BREAKS) else f"({k}, CAST({x!r} AS DOUBLE), CAST(NULL AS DOUBLE))" for k, x in enumerate(BREAKS))})
    SELECT b.bin, b.low, b.high, count(pt.pixel_id) AS pixels, coalesce(sum(area_km2), 0) AS area, CAST(coalesce(sum(CASE WHEN {IN_YEARS} THEN nturbines ELSE 0 END), 0) AS BIGINT) AS nturbines, coalesce(sum(CASE WHEN {IN_YEARS} THEN turbinecapac / 1000 ELSE 0.0 END), 0.0) AS capac_mw
    FROM b LEFT JOIN pt ON popdens >= b.low AND (popdens < b.high OR b.high IS NULL) GROUP BY ALL""",
    "v_pixel", "v_turbine",
)
def density_histogram(spark, d):
    """Histogram with its empty bins."""
    return turbines.histogram(turbine_pixels(spark, d), "popdens", BREAKS, 1993, 1997)


@query("SELECT protected, " + ", ".join(f"count(*) FILTER (WHERE land % 4 = {k}) AS c{k}" for k in range(4)) + " FROM v_pixel GROUP BY 1", "v_pixel")
def protection_contingency(spark, d):
    """Counts of one code by another."""
    return turbines.contingency(view(spark, d, "v_pixel").withColumn("natura", F.col("land") % 4), "protected", "natura", [0, 1, 2, 3])


@query("WITH n AS (SELECT region, land, count(*) AS n FROM v_pixel GROUP BY ALL) SELECT region, land, n, CAST(row_number() OVER (PARTITION BY region ORDER BY n DESC, land DESC) AS INT) AS rank FROM n QUALIFY rank <= 3", "v_pixel")
def top_land_types(spark, d):
    """The three most frequent codes."""
    return turbines.top_codes(view(spark, d, "v_pixel"), "region", "land")


@query(
    f"""WITH {PIXELS}, q AS (SELECT *, {ON} AS class, onshore_a AS ok, NOT grid_a AS nogrid, popdens >= 150 AS highpop, NOT good_wind AS badland FROM px),
    a AS (SELECT region, sum(area_km2) AS area, sum(CASE WHEN ok THEN area_km2 ELSE 0.0 END) AS area_ok FROM q GROUP BY 1),
    s AS (SELECT q.region, count(*) AS n, sum(capac_kw) / 1000 AS mw, sum(CASE WHEN ok THEN capac_kw ELSE 0.0 END) / 1000 AS mw_ok, 100.0 * count(*) FILTER (WHERE onshore) / count(*) AS onshore_pct, avg(class) AS mean_class, avg(atlas) AS windspeed,
      100.0 * count(*) FILTER (WHERE onshore AND NOT ok) / count(*) AS masked_pct, {", ".join(f"100.0 * count(*) FILTER (WHERE onshore AND NOT ok AND {c}) / nullif(count(*) FILTER (WHERE onshore AND NOT ok), 0) AS {c}_pct" for c in ("nogrid", "highpop", "badland", "kept"))},
      sum(capac_kw * popdens) / sum(capac_kw) AS turbine_popdens FROM v_turbine t JOIN q ON t.pixel_id = q.pixel_id GROUP BY 1)
    SELECT a.region, a.area, a.area_ok, coalesce(s.n, 0) AS n, coalesce(s.mw, 0) AS mw, coalesce(s.mw_ok, 0) AS mw_ok, s.onshore_pct, s.mean_class, s.windspeed, s.masked_pct, s.nogrid_pct, s.highpop_pct, s.badland_pct, s.kept_pct, s.turbine_popdens,
      a.area * 5.0 * 0.08 AS maxcap_mw, coalesce(s.mw, 0) / nullif(a.area, 0) AS dens_tot, coalesce(s.mw_ok, 0) / nullif(a.area_ok, 0) AS dens_ok, 100 * 0.08 * coalesce(s.mw, 0) / nullif(a.area * 5.0 * 0.08, 0) AS exploit_pct FROM a LEFT JOIN s ON a.region = s.region""",
    "v_pixel", "v_turbine",
)
def municipal_statistics(spark, d):
    """Exploitation of each region."""
    p = pixels(spark, d)
    w = WindOptions()
    p = p.withColumns({"class": scalar.classes(F.col("atlas"), w.onshoreclasses_min, w.onshoreclasses_max), "ok": F.col("onshore_a"), "nogrid": ~(F.col("gridaccess") > 0), "highpop": F.col("popdens") >= 150, "badland": ~((F.col("region") > 0) & ~F.col("land").isin(0, 11, 13)), "kept": F.col("protected").isin(1, 2, 3, 4, 5, 8)})
    return turbines.municipal(p, view(spark, d, "v_turbine"))


@query("WITH p AS (SELECT n_regionkey + 1 AS munic, n_name, 1 AS k FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_regionkey + 1, n_name, 2 FROM nation WHERE n_nationkey >= 10), s AS (SELECT k, max(munic) AS size FROM p GROUP BY 1) SELECT p.n_name, p.k AS country, CAST(p.munic + CASE WHEN p.k = 2 THEN (SELECT size FROM s WHERE k = 1) ELSE 0 END AS BIGINT) AS munic FROM p")
def numbered_union(spark, d):
    """Tables one below the other, with running numbers."""
    n = view(spark, d, "nation").select((F.col("n_regionkey") + 1).alias("munic"), "n_name", "n_nationkey")
    return turbines.numbered_union([("a", n.where("n_nationkey < 10").drop("n_nationkey")), ("b", n.where("n_nationkey >= 10").drop("n_nationkey"))]).select("n_name", "country", "munic")


# Hydro power

SITES = "hs AS (SELECT o_orderkey AS site_id, CAST(1 + o_custkey % 5 AS INT) AS region, CAST(0.02 + o_custkey % 90 / 500.0 AS DOUBLE) AS coe, CAST(o_totalprice / 1000 AS DOUBLE) AS production_gwh, CAST(1500 + o_custkey % 2000 AS DOUBLE) AS capcost, CAST(1 + o_orderkey % 2 AS INT) AS system, CAST(o_orderkey % 300 AS DOUBLE) AS volume_mm3 FROM orders)"


def hydro_sites(spark, d):
    k = F.col("o_orderkey")
    flow = F.array(*[(F.lit(5.0) + k % 50 + F.pmod(k * (m + 3), F.lit(17))).cast("double") for m in range(12)])
    return hydro.potential_rows(view(spark, d, "orders").select(k.alias("site_id"), (1 + F.col("o_custkey") % 5).cast("int").alias("region"), (0.02 + F.col("o_custkey") % 90 / 500.0).cast("double").alias("coe"), (F.col("o_totalprice") / 1000).cast("double").alias("production_gwh"), (1500 + F.col("o_custkey") % 2000).cast("double").alias("capcost"), (1 + k % 2).cast("int").alias("system"), (k % 300).cast("double").alias("volume_mm3"), flow.alias("flow")))


HYDRO = f"""{SITES}, f AS (SELECT *, capcost * (0.1 / (1 - pow(1.1, -40))) / 8760.0 / coe AS cf, CASE system WHEN 1 THEN 0.9 ELSE 0.7 END AS eff,
  list_sort(list_transform(range(12), lambda m: CAST(5.0 + site_id % 50 + (site_id * (m + 3)) % 17 AS DOUBLE)))[9] AS design FROM hs),
 h AS (SELECT *, production_gwh * 1e9 / 8760.0 / cf / (eff * design * (997.0 * 9.81)) AS uncut FROM f),
 r AS (SELECT *, least(uncut, 2000.0) AS head_m, CASE WHEN uncut = 0 THEN 1.0 ELSE least(uncut, 2000.0) / uncut END AS cut FROM h),
 pr AS (SELECT *, production_gwh * cut * 1000.0 / 8760.0 / cf AS capacity_mw, coe / cut AS cost, head_m * volume_mm3 * (997.0 * 9.81 / 3600.0 / 1000.0) AS reservoir_gwh FROM r),
 hydro AS (SELECT *, reservoir_gwh * 1000.0 / nullif(capacity_mw, 0) AS discharge_h FROM pr)"""


@query(f"WITH {HYDRO} SELECT site_id, cf, capacity_mw, head_m, reservoir_gwh, discharge_h FROM hydro")
def hydro_sites_physics(spark, d):
    """Physics of potential sites."""
    return hydro_sites(spark, d).select("site_id", "cf", "capacity_mw", "head_m", "reservoir_gwh", "discharge_h")


@query(
    f"""WITH {HYDRO}, c AS (SELECT *, CASE WHEN cost * 1000 >= 0 AND cost * 1000 < 50 THEN 1 WHEN cost * 1000 >= 50 AND cost * 1000 < 100 THEN 2 WHEN cost * 1000 >= 100 AND cost * 1000 < 9999 THEN 3 END AS cost_class,
    CASE WHEN discharge_h / 168 >= 0 AND discharge_h / 168 < 1e-6 THEN 1 WHEN discharge_h / 168 >= 1e-6 AND discharge_h / 168 < 12 THEN 2 WHEN discharge_h / 168 >= 12 AND discharge_h / 168 < 9e9 THEN 3 END AS storage_class FROM hydro)
    SELECT region, cost_class, storage_class, sum(capacity_mw) / 1000 AS capacity_gw, avg(cost * 1000) AS mean_cost, avg(least(8760.0, discharge_h)) AS mean_discharge_h FROM c WHERE cost_class IS NOT NULL AND storage_class IS NOT NULL GROUP BY ALL"""
)
def hydro_potential(spark, d):
    """Potential by region, cost and storage."""
    return hydro.potential(hydro_sites(spark, d), HydroOptions())[0]


@query(
    f"""WITH {HYDRO}, c AS (SELECT *, CASE WHEN cost * 1000 >= 0 AND cost * 1000 < 50 THEN 1 WHEN cost * 1000 >= 50 AND cost * 1000 < 100 THEN 2 WHEN cost * 1000 >= 100 AND cost * 1000 < 9999 THEN 3 END AS cost_class,
    CASE WHEN discharge_h / 168 >= 0 AND discharge_h / 168 < 1e-6 THEN 1 WHEN discharge_h / 168 >= 1e-6 AND discharge_h / 168 < 12 THEN 2 WHEN discharge_h / 168 >= 12 AND discharge_h / 168 < 9e9 THEN 3 END AS storage_class FROM hydro),
    m AS (SELECT c.*, k.m, [31,28,31,30,31,30,31,31,30,31,30,31][k.m] AS days, 5.0 + site_id % 50 + (site_id * (k.m + 2)) % 17 AS q FROM c, (SELECT unnest(range(1, 13)) AS m) k)
    SELECT region, cost_class, storage_class, CAST(m AS INT) AS month, sum(head_m * days * 24.0 / 1e9 * q * (997.0 * 9.81) * 1000 / 24 / days) / sum(capacity_mw) AS inflow_cf FROM m WHERE cost_class IS NOT NULL AND storage_class IS NOT NULL GROUP BY ALL"""
)
def hydro_inflow(spark, d):
    """Monthly inflow of the potential."""
    return hydro.potential(hydro_sites(spark, d), HydroOptions())[1]


NATIONAL = "nat AS (SELECT n_nationkey AS country, CAST(500 + n_nationkey * 100 AS DOUBLE) AS national_mw, CAST(1000 + n_nationkey * 200 AS DOUBLE) AS generation_gwh FROM nation)"


def existing_hydro(spark, d):
    plants = view(spark, d, "v_plant").withColumn("region", (1 + F.col("country") % 4).cast("int"))
    k = F.col("site_id")
    sites = view(spark, d, "v_site").select("site_id", "lon", "lat", F.array(*[(1.0 + F.pmod(k * (m + 2), F.lit(11))).cast("double") for m in range(12)]).alias("profile"))
    national = view(spark, d, "nation").select(F.col("n_nationkey").alias("country"), (500 + F.col("n_nationkey") * 100).cast("double").alias("capacity_mw"), (1000 + F.col("n_nationkey") * 200).cast("double").alias("generation_gwh"))
    return hydro.existing(plants, sites, national)


EXISTING = f"""{NATIONAL}, tot AS (SELECT country, sum(capacity_mw) AS reg_mw FROM v_plant GROUP BY 1),
 sc AS (SELECT p.*, 1 + p.country % 4 AS region, p.capacity_mw * national_mw / reg_mw AS mw, generation_gwh * 1000 / 8760 / national_mw AS cf FROM v_plant p JOIN tot USING (country) JOIN nat USING (country))"""


@query(f"WITH {EXISTING} SELECT region, sum(mw) / 1000 AS capacity_gw FROM sc GROUP BY 1", "v_plant")
def hydro_existing(spark, d):
    """I8: existing capacity by region, scaled to the country's."""
    return existing_hydro(spark, d)[0]


@query(
    f"""WITH {EXISTING}, near AS (SELECT p.plant_id, arg_min(s.site_id, 111.0 * sqrt(pow(p.lon - s.lon, 2) + pow(p.lat - s.lat, 2))) AS site_id FROM v_plant p, (SELECT * FROM v_site ORDER BY site_id) s GROUP BY 1),
    prof AS (SELECT site_id, m, (1.0 + (site_id * (m + 1)) % 11) * [31,28,31,30,31,30,31,31,30,31,30,31][m] AS e FROM v_site, (SELECT unnest(range(1, 13)) AS m)),
    sh AS (SELECT site_id, m, e / sum(e) OVER (PARTITION BY site_id) AS share FROM prof)
    SELECT sc.region, CAST(sh.m AS INT) AS month, sum(mw * cf * share * 365 / [31,28,31,30,31,30,31,31,30,31,30,31][sh.m]) / sum(mw) AS inflow_cf FROM sc JOIN near USING (plant_id) JOIN sh ON near.site_id = sh.site_id GROUP BY ALL""",
    "v_plant", "v_site",
)
def hydro_existing_inflow(spark, d):
    """I8, F8: monthly inflow after the nearest site's profile."""
    return existing_hydro(spark, d)[1]


# Joins, windows and reshaping


@query("WITH t AS (SELECT CAST(cell % 5 AS INT) AS country, month, avg(value) AS temp FROM v_month GROUP BY ALL), h AS (SELECT CAST(user_id % 5 AS INT) AS country, CAST(1 + event_id % 12 AS INT) AS month, event_id FROM events), c AS (SELECT CAST(n_nationkey AS INT) AS country, n_name FROM nation) SELECT h.event_id, h.country, h.month, t.temp, c.n_name FROM h JOIN t USING (country, month) JOIN c USING (country)", "v_month")
def feature_joins(spark, d):
    """hours with monthly and regional attributes."""
    t = view(spark, d, "v_month").groupBy((F.col("cell") % 5).cast("int").alias("country"), "month").agg(F.avg("value").alias("temp"))
    h = view(spark, d, "events").select((F.col("user_id") % 5).cast("int").alias("country"), (1 + F.col("event_id") % 12).cast("int").alias("month"), "event_id")
    c = view(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("country"), "n_name")
    return relational.with_attributes(h, (t, ["country", "month"]), (c, ["country"]))


@query("WITH a AS (SELECT n_nationkey AS bus, count(c_custkey) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1), b AS (SELECT s_nationkey + 2 AS bus, sum(s_acctbal) AS balance FROM supplier GROUP BY 1) SELECT coalesce(a.bus, b.bus) AS bus, coalesce(customers, 0) AS customers, coalesce(balance, 0.0) AS balance FROM a FULL JOIN b ON a.bus = b.bus")
def bus_outer_join(spark, d):
    """Two aggregates, whichever is there."""
    return both_buses(view(spark, d, "customer"), view(spark, d, "supplier").withColumn("s_nationkey", F.col("s_nationkey") + 2))


def both_buses(customers, suppliers):
    a = customers.groupBy(F.col("c_nationkey").alias("bus")).agg(F.count("*").alias("customers"))
    b = suppliers.groupBy(F.col("s_nationkey").alias("bus")).agg(F.sum("s_acctbal").alias("balance"))
    return relational.whichever(a, b, "bus")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '5-LOW') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%1')")
def missing_buses(spark, d):
    """Members without data, of some countries."""
    some = view(spark, d, "nation").where(F.col("n_name").endswith("1")).select(F.col("n_nationkey").alias("c_nationkey"))
    present = view(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.without_data(view(spark, d, "customer"), present, "c_custkey", some, "c_nationkey").select("c_custkey")


@query("WITH m AS (SELECT CAST(cell % 7 AS INT) AS country, month, avg(value) AS temp FROM v_month GROUP BY ALL) SELECT country, month, temp, CAST(row_number() OVER (PARTITION BY country ORDER BY temp, month) AS INT) AS ranked, temp / avg(temp) OVER (PARTITION BY country) AS norm, sum(temp) OVER (PARTITION BY country ORDER BY month) AS running FROM m", "v_month")
def ranked_months(spark, d):
    """Rank, normalisation and running sum."""
    m = view(spark, d, "v_month").groupBy((F.col("cell") % 7).cast("int").alias("country"), "month").agg(F.avg("value").alias("temp"))
    m = m.withColumn("ranked", F.row_number().over(Window.partitionBy("country").orderBy("temp", "month")))
    return raster.running_total(hydro.normalised(m, ["country"], "temp", "norm"), ["country"], ["month"], "temp", "running")


@query("WITH s AS (SELECT CAST(era_lon AS INT) AS region, CAST(date_diff('hour', TIMESTAMP '2024-01-01', hour) AS BIGINT) AS hour, value FROM v_cell_hour) SELECT region, ((hour + CAST(round_even(region * 1.5 - 3, 0) AS BIGINT)) % 744 + 744) % 744 AS hour, value FROM s", "v_cell_hour")
def cyclic_shift(spark, d):
    """A series moved around its end, by an offset rounded half to even."""
    s = view(spark, d, "v_cell_hour").select(F.col("era_lon").alias("region"), F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("hour")).alias("hour"), "value")
    return demand.shifted(s, ["region"], F.col("region") * 1.5 - 3, 744)


@query("SELECT era_lon, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.95) AS high FROM v_cell_hour GROUP BY 1", "v_cell_hour")
def quantiles(spark, d):
    """Interpolated quantiles."""
    q = view(spark, d, "v_cell_hour").groupBy("era_lon").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select("era_lon", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))


TYPES = "click purchase signup view error".split()


@query("WITH w AS (SELECT CAST(user_id % 4 AS INT) AS bus, event_type, sum(value) AS v FROM events GROUP BY ALL) SELECT bus, event_type, v FROM w")
def pivot_round_trip(spark, d):
    """K4, K5: long to wide and back."""
    e = view(spark, d, "events").withColumn("bus", (F.col("user_id") % 4).cast("int"))
    wide = e.groupBy("bus").pivot("event_type", TYPES).agg(F.sum("value"))
    return wide.unpivot(["bus"], TYPES, "event_type", "v").where("v is not null")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def value_counts(spark, d):
    """I31."""
    return relational.counted(view(spark, d, "events"), "event_type", "user_id").withColumnRenamed("user_id", "users")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_of_key(spark, d):
    """The first row of each key."""
    return relational.first_of_key(view(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("SELECT c.c_nationkey AS country, h.range AS hour FROM (SELECT DISTINCT c_nationkey FROM customer) c, range(24) h")
def expansion(spark, d):
    """Every region with every hour."""
    return relational.expanded(view(spark, d, "customer").select(F.col("c_nationkey").alias("country")), "hour", 0, 23)


@query("SELECT pixel_id, lon_idx FROM v_pixel WHERE (pixel_id - 1) % 7 = 0", "v_pixel")
def downsample(spark, d):
    """Every seventh pixel."""
    return relational.every_nth(view(spark, d, "v_pixel"), F.col("pixel_id") - 1, 7).select("pixel_id", "lon_idx")


# Time, sun and text


@query("""SELECT event_id, CAST(hour(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE) AS INT) AS localhour, CAST(month(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE) AS INT) AS month,
 CASE WHEN isodow(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE) >= 6 THEN 1 ELSE 0 END AS weekend01, 5.5 AS offset_h FROM events""")  # fmt: skip
def calendar(spark, d):
    """Local hour, month and weekend in a half-hour zone."""
    e = view(spark, d, "events").withColumn("t", scalar.local_time(F.col("ts"), F.lit("Asia/Kolkata")))
    return e.select("event_id", F.hour("t").alias("localhour"), F.month("t").alias("month"), scalar.weekend(F.col("t")).alias("weekend01"), scalar.tz_offset_hours(F.col("ts"), F.lit("Asia/Kolkata")).alias("offset_h"))


SUN = """s0 AS (SELECT event_id, CAST(user_id % 120 - 60 AS DOUBLE) AS lat, CAST(user_id * 7 % 360 - 180 AS DOUBLE) AS lon, ts, value, {ts} AS t0 FROM events),
s1 AS (SELECT *, date_diff('microsecond', TIMESTAMP '2060-01-01', t0) / 86400e6 AS t FROM s0), s2 AS (SELECT *, 0.017202786 * (t + 1.1574e-5 * (96.4 + 0.00158 * t)) AS w, t + 1.1574e-5 * (96.4 + 0.00158 * t) AS te FROM s1),
s3 AS (SELECT *, sin(w) AS s, cos(w) AS c FROM s2), s4 AS (SELECT *, 2 * s * c AS ss, (c + s) * (c - s) AS cc FROM s3),
s5 AS (SELECT *, -1.38880 + 1.72027920e-2 * te + 3.199e-2 * s - 2.65e-3 * c + 4.050e-2 * ss + 1.525e-2 * cc AS ra, 6.57e-3 + 7.347e-2 * s - 3.9919e-1 * c + 7.3e-4 * ss - 6.60e-3 * cc AS dec FROM s4),
s6 AS (SELECT *, 1.75283 + 6.3003881 * t + radians(lon) - (ra - 2 * pi() * floor(ra / (2 * pi()))) + pi() AS h0 FROM s5), s7 AS (SELECT *, h0 - 2 * pi() * floor(h0 / (2 * pi())) - pi() AS ha, radians(lat) AS p FROM s6),
s8 AS (SELECT *, sin(p) * sin(dec) + cos(p) * cos(dec) * cos(ha) AS se FROM s7), sun AS (SELECT *, pi() / 2 - asin(se) + 4.26e-5 * sqrt(greatest(1 - se * se, 0)) AS zen, atan2(sin(ha), cos(ha) * sin(p) - sin(dec) * cos(p) / cos(dec)) AS az FROM s8)"""


def sunny(spark, d):
    return view(spark, d, "events").select("event_id", "ts", "value", (F.col("user_id") % 120 - 60).cast("double").alias("lat"), (F.col("user_id") * 7 % 360 - 180).cast("double").alias("lon"))


@query(f"WITH {SUN.format(ts='ts')} SELECT event_id, degrees(dec) AS declination, degrees(zen) AS zenith, cos(az) AS cos_azimuth FROM sun")
def sun_position(spark, d):
    """L2, L3: declination and zenith of the sun."""
    p = solar.sun_position(F.col("ts"), F.col("lat"), F.col("lon"))
    return sunny(spark, d).select("event_id", p.alias("p")).select("event_id", "p.declination", "p.zenith", F.cos(F.radians("p.azimuth")).alias("cos_azimuth"))


@query(
    f"""WITH {SUN.format(ts="ts - INTERVAL 30 MINUTE")},
    a AS (SELECT *, 1.361 * (1 + 0.034 * cos(2 * pi() * (dayofyear(t0) - 1 + (hour(t0) * 3600 + minute(t0) * 60 + floor(second(t0))) / 86400.0) / 365.25)) AS tsi, value * 20000 / 3.6e6 AS ghi, value * 12000 / 3.6e6 AS fd, greatest(cos(zen), pow(2.0, -23)) AS cz,
      radians(abs(CASE WHEN lat > 0 THEN least(90.0, greatest(0.0, 1.3793 + lat * (1.2011 + lat * (-0.014404 + lat * 0.000080509)))) ELSE greatest(-90.0, least(0.0, -0.41657 + lat * (1.4216 + lat * (0.024051 + lat * 0.00021828)))) END)) AS beta FROM sun),
    b AS (SELECT *, least(greatest(fd / (cz + pow(greatest(degrees(zen) - 85, 0), 2) / 50), 0), tsi) AS dni, greatest(cz * cos(beta) + sin(zen) * sin(beta) * cos(az - CASE WHEN lat < 0 THEN pi() ELSE 0 END), 0) AS aoi FROM a)
    SELECT event_id, dni, dni * aoi + ghi * 0.2 * (1 - cos(beta)) / 2 + (ghi - fd) * (dni / tsi) * aoi / greatest(cz, 0.017) + (ghi - fd) * (1 - dni / tsi) * (1 + cos(beta)) / 2 AS gti FROM b"""
)
def irradiance(spark, d):
    """Tilted and direct irradiance."""
    rows = sunny(spark, d).withColumns({"ssrd": F.col("value") * 20000, "fdir": F.col("value") * 12000})
    return solar.with_irradiance(rows, "ssrd", "fdir").select("event_id", "dni", "gti")


@query("SELECT event_id, sqrt(pow(value / 10, 2) + pow(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 20 END, 0), 2)) AS speed, CASE WHEN event_id % 5 > 0 THEN value + 200 - 273.15 ELSE 0 END AS celsius FROM events")
def weather_ingest(spark, d):
    """Speed from components, temperature over land."""
    e = view(spark, d, "events")
    return e.select("event_id", wind.speed(F.col("value") / 10, F.when(F.col("event_id") % 3 != 0, F.col("value") / 20)).alias("speed"), scalar.celsius_over_land(F.col("value") + 200, F.col("event_id") % 5 > 0).alias("celsius"))


@query("SELECT n_nationkey AS id, upper(n_name) AS up, substr(n_name, 1, 2) AS two, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS padded, right(n_name, 3) AS tail, replace(n_name, 'A', '-') AS swapped, contains(n_name, 'AN') AS has, printf('%.1f%%', n_nationkey * 10.0 / 4) AS pct FROM nation")
def text_functions(spark, d):
    """Strings."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    return view(spark, d, "nation").select(k.alias("id"), F.upper(n).alias("up"), F.substring(n, 1, 2).alias("two"), F.lpad(k.cast("string"), 4, "0").alias("padded"), F.right(n, F.lit(3)).alias("tail"), F.replace(n, F.lit("A"), F.lit("-")).alias("swapped"), n.contains("AN").alias("has"), scalar.percent_text(k / 40).alias("pct"))


@query("SELECT pixel_id, CASE WHEN popdens = 0 THEN 0 ELSE round(popdens * 1.2345678, CAST(3 - floor(log10(popdens * 1.2345678)) AS INT)) END AS rounded, [" + ", ".join(f"'{n}'" for n in scalar.LAND_TYPES) + "][land + 1] AS land_name FROM v_pixel", "v_pixel")
def significant_digits(spark, d):
    """Significant digits; names of codes."""
    return view(spark, d, "v_pixel").select("pixel_id", scalar.significant(F.col("popdens") * 1.2345678).alias("rounded"), scalar.land_name(F.col("land")).alias("land_name"))


@query("WITH p AS (SELECT region, CASE WHEN land % 3 = 0 THEN 'Etc/GMT-5' WHEN land % 3 = 1 THEN 'Asia/Kolkata' ELSE 'UTC' END AS tz, CASE WHEN land % 3 = 0 THEN 5.0 WHEN land % 3 = 1 THEN 5.5 ELSE 0.0 END AS o, popdens FROM v_pixel), b AS (SELECT region, tz, any_value(o) AS o, sum(popdens) AS pop FROM p GROUP BY ALL) SELECT region, arg_max(tz, pop) AS tz, sum(pop * o) / sum(pop) AS \"offset\", sum(pop) AS population FROM b GROUP BY 1", "v_pixel")
def region_zones(spark, d):
    """Zones and offsets of regions."""
    land = F.col("land") % 3
    p = view(spark, d, "v_pixel").select("region", F.when(land == 0, "Etc/GMT-5").when(land == 1, "Asia/Kolkata").otherwise("UTC").alias("tz"), F.col("popdens").alias("population"))
    return demand.zones(p, F.lit("2015-01-01 00:00:00").cast("timestamp_ntz"))


@query("WITH n AS (SELECT n_nationkey AS country, 2.0 + n_nationkey AS dpc, 1.0 + n_nationkey / 100.0 AS mult FROM nation) SELECT region, sum(coalesce(dpc * mult, 0) * popdens) / sum(popdens) AS demandpercapita, sum(abs(topo)) / sum(popdens) AS gdppercapita, sum(popdens) AS people FROM v_pixel LEFT JOIN n ON land = country GROUP BY 1", "v_pixel")
def regional_economics(spark, d):
    """Demand and income per head."""
    p = view(spark, d, "v_pixel").select("region", F.col("land").alias("country"), F.col("popdens").alias("population"), "popdens", F.abs("topo").alias("gdp"))
    n = view(spark, d, "nation").select(F.col("n_nationkey").alias("country"), (2.0 + F.col("n_nationkey")).alias("demand_percapita"), (1.0 + F.col("n_nationkey") / 100.0).alias("multiplier"))
    return demand.regional_economics(p, n)


@query("WITH e AS (SELECT n_regionkey AS region, 100.0 + n_nationkey AS a, 150.0 + n_nationkey * 2 AS b FROM nation) SELECT region, pow(avg(b / a), CAST(2050 - 2016 AS DOUBLE) / (2050 - 2020)) AS multiplier FROM e GROUP BY 1")
def demand_growth(spark, d):
    """Growth of demand."""
    e = view(spark, d, "nation").select(F.col("n_regionkey").alias("region"), (100.0 + F.col("n_nationkey")).alias("2020"), (150.0 + F.col("n_nationkey") * 2).alias("2050"))
    return demand.growth(e, 2050)


# Sinks


@query("SELECT printf('%-3s . %s%-2d . h%04d %10.6f', 'R' || CAST(region AS VARCHAR), 'PV', class, h, cf) AS value FROM (SELECT CAST(1 + user_id % 4 AS INT) AS region, CAST(1 + event_id % 5 AS INT) AS class, CAST(event_id % 9000 + 1 AS INT) AS h, value / 100 - 0.2 AS cf FROM events) WHERE cf > 0 AND h <= 8760")
def model_lines(spark, d):
    """Fixed-width text."""
    e = view(spark, d, "events").select(F.concat(F.lit("R"), (1 + F.col("user_id") % 4).cast("string")).alias("region_name"), F.lit("PV").alias("tech"), (1 + F.col("event_id") % 5).cast("int").alias("class"), (F.col("event_id") % 9000).alias("hour"), (F.col("value") / 100 - 0.2).alias("cf"))
    return tables.model_lines(e)


@query("WITH c AS (SELECT CAST(event_id % 24 AS INT) AS hour, CAST(user_id % 3 AS INT) AS bus, avg(value - 50) AS cf FROM events GROUP BY ALL) SELECT hour, " + ", ".join(f"replace(printf('%.4f', greatest(coalesce(max(cf) FILTER (WHERE bus = {b}), 0), 0)), '.', ',') AS \"{b}\"" for b in range(4)) + " FROM c GROUP BY 1")
def wide_by_bus(spark, d):
    """A column per bus, with decimal commas."""
    c = view(spark, d, "events").groupBy((F.col("event_id") % 24).cast("int").alias("hour"), (F.col("user_id") % 3).cast("int").alias("bus_id")).agg(F.avg(F.col("value") - 50).alias("cf"))
    return tables.wide_by_bus(c, [0, 1, 2, 3], 4)


# Demand model


def demand_rows(spark, d):
    """Hourly features of four regions over one month, with normalised demand."""
    s = view(spark, d, "v_cell_hour").select(F.col("era_lon").alias("region"), F.col("hour").alias("utc"), F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("hour")).alias("hour"), F.col("value").alias("temp1"), (F.col("value") * 0.9 + 1).alias("temp_top3"))
    zone = spark.range(1, 5).select(F.col("id").cast("int").alias("region"), F.lit("Asia/Kolkata").alias("tz"), F.lit(5.5).alias("offset"), F.lit(1000.0).alias("population"))
    money = spark.range(1, 5).select(F.col("id").cast("int").alias("region"), (5.0 + F.col("id")).alias("demandpercapita"), (20.0 + F.col("id")).alias("gdppercapita"))
    rows = demand.features(s, zone, money).withColumn("d", 10 + F.col("localhour") - F.col("temp1") / 10 + F.col("region"))
    return hydro.normalised(rows, ["region"], "d", "normdemand").drop("d"), zone


@query(
    """WITH s AS (SELECT era_lon AS region, hour + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS t, date_diff('hour', TIMESTAMP '2024-01-01', hour) AS hour, value AS temp1, value * 0.9 + 1 AS temp_top3 FROM v_cell_hour),
    m AS (SELECT region, month(t) AS month, avg(temp_top3) AS temp_monthly FROM s GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY temp_monthly, month) AS INT) AS ranked_month FROM m), q AS (SELECT region, quantile_cont(temp1, 0.05) AS lo, quantile_cont(temp1, 0.5) AS mid, quantile_cont(temp1, 0.95) AS hi FROM s GROUP BY 1),
    f AS (SELECT s.region, s.hour, temp1, temp_top3, CAST(hour(t) AS INT) AS localhour, CAST(month(t) AS INT) AS month, CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END AS weekend01, temp_monthly, ranked_month, lo AS temp1_qlow, mid AS temp1_mean, hi AS temp1_qhigh, 5.0 + s.region AS demandpercapita, 20.0 + s.region AS gdppercapita FROM s JOIN r ON s.region = r.region AND month(t) = r.month JOIN q ON s.region = q.region)
    SELECT *, (10 + localhour - temp1 / 10 + region) / avg(10 + localhour - temp1 / 10 + region) OVER (PARTITION BY region) AS normdemand FROM f""",
    "v_cell_hour",
)
def demand_features(spark, d):
    """The hourly feature table."""
    return demand_rows(spark, d)[0]


@query()
def demand_prediction(spark, d):
    """M2, M3: boosted trees; tested by their error."""
    rows, zone = demand_rows(spark, d)
    return demand.predicted(demand.train(rows), rows, zone, 744)


@query()
def demand_cross_validation(spark, d):
    """M4, M5: out-of-fold predictions; tested by their error."""
    from .options import DemandOptions

    return demand.cross_validated(demand_rows(spark, d)[0], DemandOptions(rounds=3, depth=3, eta=0.3))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
