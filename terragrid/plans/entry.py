"""Whole computations over a folder of tables: regions, distances, solar, wind, hydro, temperature.

Tables (all with a column per layer, keyed by lon_idx, lat_idx): ``places`` (admin_uid, code_uid,
land), ``layers`` (land, protected, popdens, population, gridaccess, topo, atlas or atlas_<altitude>,
mean_gti, mean_dni), ``cells/wind``, ``cells/gti``, ``cells/dni``, ``cells/temp`` (era_lon, era_lat, year,
series, mean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, wind
from ..functions.scalar import leap_hours
from ..operators import masks, raster, regions, spatial
from ..options import DemandOptions, HydroOptions, SolarOptions, WindOptions, with_options
from ..sources import tables
from ..sources.tables import Data
from . import demand, hydro, resource

KEYS = ["lon_idx", "lat_idx"]
#: Resolution and extent (west, south, east, north) in degrees of the climate models' grids.
CLIMATE_GRIDS = {"HCLIM": (0.03, (2.0, 50.5, 32.0, 71.5)), "CORDEX": (0.1, (-10.5, 34.5, 32.0, 71.5))}


def save_regions(spark: SparkSession, data: Data, name: str, definitions: DataFrame) -> DataFrame:
    """Paint, mark foreign land, fill the sea, split at the shore, write."""
    places = spark.read.parquet(data.path("places"))
    admin, codes = (spark.read.parquet(data.path(x)) for x in ("admin_names", "code_names"))
    painted = regions.painted(places, admin, codes, definitions)
    return tables.write_if_absent(regions.saved_regions(painted), data.path("regions", name))


def located(pixels: DataFrame, res: float) -> DataFrame:
    lat = grid.col_to_lat(F.col("lat_idx"), res)
    return pixels.withColumns({"lat": lat, "lon": grid.row_to_lon(F.col("lon_idx"), res), "area_km2": grid.cell_area_km2(lat, res), "era_lon": grid.coarse_index(F.col("lon_idx")), "era_lat": grid.coarse_index(F.col("lat_idx"))})


def region_distances(spark: SparkSession, data: Data, name: str, res: float) -> DataFrame:
    r = spark.read.parquet(data.path("regions", name))
    px = located(r.join(spark.read.parquet(data.path("layers")).select(*KEYS, "popdens"), KEYS), res)
    return regions.region_graph(r, regions.centres(px))


def prepared(px: DataFrame, o: SolarOptions | WindOptions, nlon: int, nlat: int, tile: int = 512) -> DataFrame:
    """Located pixels (region, offshore and layers) with the two disk means that masks need."""
    radius = o.distance_elec_access / grid.KM_PER_DEGREE / o.res
    buffered = raster.disk_mean(px.select(*KEYS, F.col("gridaccess").alias("value")), radius, nlon, nlat, tile).withColumnRenamed("value", "buffered")
    px = px.join(buffered, KEYS)
    if isinstance(o, WindOptions):
        near = raster.disk_mean(px.select(*KEYS, (F.col("region") > 0).cast("double").alias("value")), o.min_shore_distance / grid.KM_PER_DEGREE / o.res, nlon, nlat, tile)
        px = px.join(near.withColumnRenamed("value", "near_shore"), KEYS)
    return px


def pixels(spark: SparkSession, data: Data, o: SolarOptions | WindOptions, nlon: int, nlat: int) -> DataFrame:
    """Layers with regions and disk means."""
    r = spark.read.parquet(data.path("regions", o.gisregion))
    return prepared(located(r.join(spark.read.parquet(data.path("layers")), KEYS), o.res), o, nlon, nlat)


def masked(px: DataFrame, o: SolarOptions | WindOptions) -> DataFrame:
    """Pixels with the masks of their kind as columns."""
    layers = [F.col(c) for c in ("region", "land", "protected", "popdens", "gridaccess", "buffered")]
    if isinstance(o, WindOptions):
        m = masks.wind_masks(o, *layers, *(F.col(c) for c in ("topo", "offshore", "near_shore")))
        return px.withColumns({"onshore_a": m["onshore_a"], "onshore_b": m["onshore_b"], "offshore_ok": m["offshore"]})
    m = masks.solar_masks(o, *layers)
    return px.withColumns({"roof": m["roof"], "plant_a": m["plant_a"], "plant_b": m["plant_b"]})


def wind_atlas(px: DataFrame, altitude: int) -> Column:
    """Mean wind speed at an altitude, between 0 and 25 m/s: the layer of that altitude, or ``atlas`` for 100 m."""
    name = f"atlas_{altitude}"
    if name not in px.columns:
        if altitude != 100:
            raise KeyError(f"no layer {name}")
        name = "atlas"
    return F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(25.0))


def climate_cells(px: DataFrame, source: str) -> DataFrame:
    """Pixels with the cell of a climate model's own grid instead of the reanalysis's; those outside its extent go."""
    res, (west, south, east, north) = CLIMATE_GRIDS[source]
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    i, j = F.floor((F.col("lon") - west) / res) + 1, F.floor((F.lit(north) - F.col("lat")) / res) + 1
    return px.where(inside).withColumns({"era_lon": i.cast("int"), "era_lat": j.cast("int")})


def wind_result(px: DataFrame, means: DataFrame, year: DataFrame, o: WindOptions) -> tuple[DataFrame, DataFrame]:
    """Capacity and hourly factors from masked pixels, the cells' means over all years (keys, mean_all) and one
    year's series (keys, mean, hours, values).  Cells without wind in that year have no capacity either.

    Classes are those of the atlas; without rescaling, and for climate models, those of the cell's mean.
    """
    blowing = year.where("mean > 0")
    px = px.join(means.join(blowing.select(*resource.CELL), resource.CELL), resource.CELL)
    px = px.withColumns({"power_atlas": wind_atlas(px, o.wind_speed_altitude), "class_atlas": wind_atlas(px, o.wind_class_altitude)})
    by_atlas = o.rescale_to_wind_atlas and not o.climate_scenario
    techs = resource.wind_techs(px, o, "class_atlas" if by_atlas else "mean_all")
    series = blowing.select(*resource.CELL, "hours", "values")
    if o.rescale_to_wind_atlas:
        hourly = resource.hourly(techs, series, F.try_divide("power_atlas", F.nullif("mean_all", F.lit(0.0))), wind.capacity_factor)
    else:  # the curve is applied once to each cell's hour
        long = series.select(*resource.CELL, F.inline(F.arrays_zip(F.col("hours").alias("hour"), F.col("values").alias("value"))))
        hourly = resource.hourly(techs, long.withColumn("value", wind.capacity_factor(F.col("value"))))
    return resource.capacity(techs), hourly


def with_hours(cells: DataFrame) -> DataFrame:
    """A year's series with the numbers of its hours, from 0."""
    return cells.select(*resource.CELL, "mean", F.sequence(F.lit(0), F.size("series") - 1).alias("hours"), F.col("series").cast("array<double>").alias("values"))


def wind_potential(spark: SparkSession, data: Data, o: WindOptions, nlon: int = 36000, nlat: int = 18000) -> tuple[DataFrame, DataFrame]:
    """Capacity and hourly capacity factors of onshore wind of two classes and offshore wind.

    With a climate scenario, named source_..._year, the cells are those of ``climate/wind`` (source, scenario,
    year, era_lon, era_lat, series, mean), and all years are the ten that stand for that year's climate.
    """
    px = masked(pixels(spark, data, o, nlon, nlat), o)
    if o.climate_scenario:
        source, year = o.climate_scenario.split("_")[0], int(o.climate_scenario[-4:])
        cells, period = spark.read.parquet(data.path("climate", "wind")).where(F.col("source") == source), resource.climate_period(year)
        px, all_years, now = climate_cells(px, source), cells.where(F.col("year").between(period[0], period[-1])), cells.where(F.col("scenario") == o.climate_scenario)
    else:
        all_years = spark.read.parquet(data.path("cells", "wind"))
        now = all_years.where(F.col("year") == o.era_year)
    means = all_years.groupBy(*resource.CELL).agg(F.avg("mean").alias("mean_all"))
    return wind_result(px, means, with_hours(now), o)


def solar_result(px: DataFrame, gti: DataFrame, dni: DataFrame, o: SolarOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Capacity, hourly factors and shared area from masked pixels and the hours (keys, hour, value) of two irradiances."""
    techs = resource.solar_techs(px, o)
    csp = F.col("tech").startswith("csp")
    factors = resource.hourly(techs.where(~csp), gti).unionByName(resource.hourly(techs.where(csp), dni))
    return resource.capacity(techs), factors, resource.overlap(px, o)


def solar_potential(spark: SparkSession, data: Data, o: SolarOptions, nlon: int = 36000, nlat: int = 18000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Capacity, hourly capacity factors, and the area that PV and CSP plants share."""
    px = masked(pixels(spark, data, o, nlon, nlat), o)
    return solar_result(px, *(tables.hourly(spark, data.path("cells", kind), o.era_year) for kind in ("gti", "dni")), o)


def hydro_potential(spark: SparkSession, data: Data, o: HydroOptions, res: float = 0.01) -> dict[str, DataFrame]:
    """Existing and potential hydro power of a region set, from the registers as tables.

    ``hydro_potential`` (site_id, lat, lon, coe, production_gwh, capcost, system, volume_mm3, flow),
    ``hydro_existing`` (site_id, lat, lon, profile), ``power_plants`` (plant_id, lat, lon, country, capacity_mw)
    and ``national_hydro`` (country, capacity_mw, generation_gwh).
    """
    regions_ = spark.read.parquet(data.path("regions", o.gisregion)).select(*KEYS, "region")

    def placed(name: str) -> DataFrame:
        return spatial.point_region(hydro.repaired(spark.read.parquet(data.path(name))), regions_, res)

    built, inflow = hydro.existing(placed("power_plants"), hydro.repaired(spark.read.parquet(data.path("hydro_existing"))), spark.read.parquet(data.path("national_hydro")))
    could, could_inflow = hydro.potential(hydro.potential_rows(placed("hydro_potential")), o)
    return {"existing": built, "existing_inflow": inflow, "potential": could, "potential_inflow": could_inflow}


def demand_table(spark: SparkSession, data: Data, name: str, year: int, res: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Hourly features of a region set, and its zones, from ``layers`` (population, popdens, gdp), ``zones`` (lon_idx,
    lat_idx, tz), ``places`` (country) and ``national`` (country, demand_percapita, multiplier)."""
    start = F.make_timestamp_ntz(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    r = spark.read.parquet(data.path("regions", name)).where("region > 0 AND region <> 32767").select(*KEYS, "region")
    px = r.join(spark.read.parquet(data.path("layers")).select(*KEYS, "population", "popdens", "gdp"), KEYS)
    zone = demand.zones(px.join(spark.read.parquet(data.path("zones")), KEYS), start)
    money = demand.regional_economics(px.join(spark.read.parquet(data.path("places")).select(*KEYS, "country"), KEYS), spark.read.parquet(data.path("national")))
    heat = top_temperatures(centre_temperature(spark, data, name, year, res=res)).join(demand.hours(spark, year), "hour")
    return demand.features(heat, zone, money), zone


def demand_result(spark: SparkSession, data: Data, name: str, training: DataFrame, o: DemandOptions, year: int, res: float = 0.01) -> DataFrame:
    """(region, hour, mw): demand of a region set by a model of the training rows."""
    rows, zone = demand_table(spark, data, name, year, res)
    return demand.predicted(demand.train(training, o), rows, zone, leap_hours(year))


def centre_temperature(spark: SparkSession, data: Data, name: str, year: int, n: int = 3, mindist: float = 3.3, res: float = 0.01) -> DataFrame:
    """(region, centre, hour, celsius) at the most populous coarse cells of each region."""
    px = located(spark.read.parquet(data.path("regions", name)).join(spark.read.parquet(data.path("layers")).select(*KEYS, "population"), KEYS), res)
    coarse = px.where("region > 0 AND region <> 32767").groupBy("region", F.col("era_lon").alias("lon_idx"), F.col("era_lat").alias("lat_idx")).agg(F.sum("population").alias("population"))
    centres = raster.population_centres(coarse, n, mindist).withColumnsRenamed({"lon_idx": "era_lon", "lat_idx": "era_lat"})
    return temperatures(centres, tables.hourly(spark, data.path("cells", "temp"), year))


def temperatures(centres: DataFrame, cells: DataFrame) -> DataFrame:
    """Hourly values of each region's centres; centres are few per region."""
    return cells.join(centres, ["era_lon", "era_lat"]).select("region", "centre", "hour", F.col("value").alias("celsius"))


def top_temperatures(at_centres: DataFrame) -> DataFrame:
    """(region, hour, temp1, temp_top3): of the first centre, and the mean of all."""
    return at_centres.groupBy("region", "hour").agg(F.max(F.when(F.col("centre") == 1, F.col("celsius"))).alias("temp1"), F.avg("celsius").alias("temp_top3"))


def run(spark: SparkSession, data: Data, name: str, definitions: DataFrame, nlon: int = 36000, nlat: int = 18000, options: dict | None = None) -> None:
    """The whole sequence for a region set, written below ``results``: regions, distances, solar, wind, hydro and, if
    there is a table ``training``, demand.  ``options`` changes defaults of those that know them."""
    out, given = data.path("results", name), {"gisregion": name, **(options or {})}

    def of(defaults):
        return with_options(defaults, {k: v for k, v in given.items() if hasattr(defaults, k)})

    save_regions(spark, data, name, definitions)
    o = of(SolarOptions())
    region_distances(spark, data, name, o.res).write.mode("overwrite").parquet(f"{out}/distances")
    for kind, result in (("solar", solar_potential(spark, data, o, nlon, nlat)), ("wind", wind_potential(spark, data, of(WindOptions()), nlon, nlat))):
        for table, df in zip(("capacity", "cf", "overlap"), result, strict=False):
            tables.write_result(df, f"{out}/{kind}_{table}", () if table == "overlap" else ("tech",))
    for table, df in hydro_potential(spark, data, of(HydroOptions()), o.res).items():
        tables.write_result(df, f"{out}/hydro_{table}", ())
    if tables.exists(spark, data.path("training")):
        demand_of = demand_result(spark, data, name, spark.read.parquet(data.path("training")), of(DemandOptions()), o.era_year, o.res)
        tables.write_result(demand_of, f"{out}/demand", ("region",))
