"""Potentials and hourly capacity factors of wind and solar power.

Pixels carry masks and classes; coarse cells carry hourly series.  Fine pixels meet their cell by the
integer key ``coarse_index``.  The number of pixels of a (tech, region, class, cell[, factor]) is
aggregated first, and only these weights meet the series.  With a factor per pixel, a cell's weights and
its series, one array, come together in one group, and only sums by class leave it: no rows are pixels
times hours, and the hourly part writes at most cells times classes times hours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import wind
from ..functions.scalar import classes, is_region
from ..options import SolarOptions, WindOptions

CELL = ["era_lon", "era_lat"]
#: So many factors of a cell meet its hours at once.
FACTORS = 256


def stacked(pixels: DataFrame, techs: list[tuple[str, Column, Column, Column, Column]]) -> DataFrame:
    """One row per pixel and tech that applies: (tech, region, class, capacity_gw)."""
    rows = F.filter(F.array(*[F.struct(F.lit(t).alias("tech"), r.cast("int").alias("region"), c.alias("class"), (m & (c > 0) & is_region(r)).alias("on"), gw.alias("capacity_gw")) for t, m, r, c, gw in techs]), lambda x: x["on"])
    return pixels.select("*", F.explode(rows).alias("t")).select(*(c for c in pixels.columns if c not in ("tech", "region", "class", "capacity_gw")), "t.tech", "t.region", "t.class", "t.capacity_gw")


def wind_techs(pixels: DataFrame, o: WindOptions, atlas: str = "atlas") -> DataFrame:
    """Pixels with mask columns onshore_a, onshore_b, offshore_ok, columns region, offshore, area_km2 and the speed that
    tells the class, named by ``atlas``."""
    on = classes(F.col(atlas), o.onshoreclasses_min, o.onshoreclasses_max)
    off = classes(F.col(atlas), o.offshoreclasses_min, o.offshoreclasses_max)
    gw, gw_off = (wind.capacity_gw(d, s, F.col("area_km2")) for d, s in ((o.onshore_density, o.area_onshore), (o.offshore_density, o.area_offshore)))
    return stacked(pixels, [("onshoreA", F.col("onshore_a"), F.col("region"), on, gw), ("onshoreB", F.col("onshore_b") & ~F.col("onshore_a"), F.col("region"), on, 2 * gw), ("offshore", F.col("offshore_ok"), F.col("offshore"), off, gw_off)])


def solar_techs(pixels: DataFrame, o: SolarOptions, pv: str = "mean_gti", csp: str = "mean_dni") -> DataFrame:
    """Pixels with mask columns roof, plant_a, plant_b: roofs before plants of class A before class B."""
    a, b, roof = F.col("plant_a"), F.col("plant_b"), F.col("roof")
    pc, cc = classes(F.col(pv), o.pvclasses_min, o.pvclasses_max), classes(F.col(csp), o.cspclasses_min, o.cspclasses_max)
    region = F.col("region")
    gw = {k: wind.capacity_gw(d, s, F.col("area_km2")) for k, d, s in (("roof", o.pv_density, o.pvroof_area), ("pv", o.pv_density, o.plant_area), ("csp", o.csp_density, o.plant_area))}
    return stacked(pixels, [("pvrooftop", roof, region, pc, gw["roof"]), ("pvplantA", a & ~roof, region, pc, gw["pv"]), ("pvplantB", b & ~a & ~roof, region, pc, 2 * gw["pv"]), ("cspplantA", a, region, cc, gw["csp"]), ("cspplantB", b & ~a, region, cc, 2 * gw["csp"])])


def overlap(pixels: DataFrame, o: SolarOptions, pv: str = "mean_gti", csp: str = "mean_dni") -> DataFrame:
    """Area in 1000 km² that PV and CSP plants both could use, by their classes."""
    pc, cc = classes(F.col(pv), o.pvclasses_min, o.pvclasses_max), classes(F.col(csp), o.cspclasses_min, o.cspclasses_max)
    kind = F.when(F.col("plant_a"), "A").when(F.col("plant_b"), "B")
    area = F.when(F.col("plant_a"), 1.0).otherwise(2.0) * F.col("area_km2") * (o.plant_area / 1000)
    rows = pixels.select(kind.alias("kind"), "region", pc.alias("pvclass"), cc.alias("cspclass"), area.alias("area")).where(F.col("kind").isNotNull() & (F.col("pvclass") > 0) & (F.col("cspclass") > 0) & is_region(F.col("region")))
    return rows.groupBy("kind", "region", "pvclass", "cspclass").agg(F.sum("area").alias("area"))


def capacity(techs: DataFrame) -> DataFrame:
    """(tech, region, class, capacity_gw, pixels)."""
    return techs.groupBy("tech", "region", "class").agg(F.sum("capacity_gw").alias("capacity_gw"), F.count("*").alias("pixels"))


def as_series(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, hours, values): one row with two arrays per cell, without nulls."""
    held = cells.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("hour", F.col(value).cast("double").alias("v")))).alias("s"))
    return held.select(*keys, F.col("s.hour").alias("hours"), F.col("s.v").alias("values"))


def hourly(techs: DataFrame, cells: DataFrame, factor: Column | None = None, curve=None, keys: list[str] = CELL, value: str = "value") -> DataFrame:
    """(tech, region, class, hour, cf): mean over pixels.

    ``cells`` is (keys, hour, value), or (keys, hours, values) with a cell's series as arrays.  ``factor``
    scales a pixel's series and ``curve``, a function of numpy arrays, is applied to the scaled values.
    """
    weights = techs.select("tech", "region", "class", *keys, (factor if factor is not None else F.lit(1.0)).cast("double").alias("factor")).where("factor is not null")
    weights = weights.groupBy("tech", "region", "class", *keys, "factor").agg(F.count("*").alias("w"))
    group = ["tech", "region", "class"]
    if factor is None and curve is None:  # linear: a cell's value counts as often as it has pixels
        if "hours" in cells.columns:
            cells = cells.select(*keys, F.inline(F.arrays_zip(F.col("hours").alias("hour"), F.col("values").alias(value))))
        met = weights.drop("factor").join(cells, keys)
        return met.groupBy(*group, "hour").agg(F.try_divide(F.sum(F.col("w") * F.col(value).cast("double")), F.sum("w")).alias("cf"))
    series = cells if "hours" in cells.columns else as_series(cells, keys, value)
    series = series.select(*(F.col(c).alias(f"{c}_") for c in keys), "hours", "values")  # names apart, should both sides come from one table

    def meet(mine: pa.Table, cell: pa.Table) -> pa.Table:
        names = [*group, "w", "sums", "hours"]
        types = [*(mine.schema.field(c).type for c in group), pa.int64(), pa.list_(pa.float64()), cell.schema.field("hours").type]
        if not mine.num_rows or not cell.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        values = np.asarray(cell.column("values").combine_chunks().values, float)
        factors, at = np.unique(mine.column("factor").to_numpy(), return_inverse=True)
        rows = list(zip(*(mine.column(c).to_pylist() for c in group), strict=True))
        number = {r: k for k, r in enumerate(dict.fromkeys(rows))}
        pixels = np.zeros((len(number), len(factors)))
        np.add.at(pixels, ([number[r] for r in rows], at), mine.column("w").to_numpy())
        sums = np.zeros((len(number), len(values)))
        for k in range(0, len(factors), FACTORS):  # factors meet the hours in blocks of bounded size
            x = values * factors[k : k + FACTORS, None]
            sums += pixels[:, k : k + FACTORS] @ (curve(x) if curve else x)
        columns = [*zip(*number, strict=True), pixels.sum(axis=1).astype(np.int64), list(sums), cell.column("hours").to_pylist() * len(number)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = StructType([*(weights.schema[c] for c in group), StructField("w", LongType()), StructField("sums", ArrayType(DoubleType())), series.schema["hours"]])
    of_class = weights.groupBy(*keys).cogroup(series.groupBy(*(f"{c}_" for c in keys))).applyInArrow(meet, schema)
    by_hour = of_class.select(*group, "w", F.inline(F.arrays_zip(F.col("hours").alias("hour"), F.col("sums").alias("total"))))
    return by_hour.groupBy(*group, "hour").agg(F.try_divide(F.sum("total"), F.sum("w")).alias("cf"))


def class_map(pixels: DataFrame, o: WindOptions, atlas: str = "atlas") -> DataFrame:
    """Wind class of each pixel of class A or offshore, 0 elsewhere."""
    on = classes(F.col(atlas), o.onshoreclasses_min, o.onshoreclasses_max)
    off = classes(F.col(atlas), o.offshoreclasses_min, o.offshoreclasses_max)
    return pixels.withColumn("onshore_class", F.when(F.col("onshore_a"), on).otherwise(0)).withColumn("offshore_class", F.when(F.col("offshore_ok"), off).otherwise(0))


def solar_class_map(pixels: DataFrame, o: SolarOptions, pv: str = "mean_gti", csp: str = "mean_dni") -> DataFrame:
    pc, cc = classes(F.col(pv), o.pvclasses_min, o.pvclasses_max), classes(F.col(csp), o.cspclasses_min, o.cspclasses_max)
    return pixels.withColumn("pv_class", F.when(F.col("plant_a"), pc).otherwise(0)).withColumn("roof_class", F.when(F.col("roof"), pc).otherwise(0)).withColumn("csp_class", F.when(F.col("plant_a"), cc).otherwise(0))


def annual_index(cells: DataFrame, quantile: float, group: str = "grp") -> DataFrame:
    """(group, year, index): yearly mean over the best sites, relative to the mean over years.

    ``cells`` is (group, cell, year, value).  A site is in if its mean over years exceeds the
    (1 - quantile) quantile of its group; with quantile 1 the poorest site is out.
    """
    means = cells.groupBy(group, "cell").agg(F.avg("value").alias("m"))
    cut = means.groupBy(group).agg(F.percentile("m", F.lit(1 - quantile)).alias("cut"))
    best = means.join(cut, group).where("m > cut").select(group, "cell")
    yearly = cells.join(best, [group, "cell"]).groupBy(group, "year").agg(F.avg("value").alias("mean"))
    return yearly.select(group, "year", F.try_divide(F.col("mean"), F.avg("mean").over(Window.partitionBy(group))).alias("index"))


def seasonal_profile(cells: DataFrame, quantile: float, group: str = "grp") -> DataFrame:
    """(group, month, mean) over the cells above one cutoff for all groups."""
    means = cells.groupBy(group, "cell").agg(F.avg("value").alias("m"))
    cut = means.agg(F.percentile("m", F.lit(1 - quantile)).alias("cut"))
    best = means.join(F.broadcast(cut)).where("m > cut").select(group, "cell")
    return cells.join(best, [group, "cell"]).groupBy(group, "month").agg(F.avg("value").alias("mean"))


def site_cf(sites: DataFrame, cells: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Mean speed and mean capacity factor of points (site_id, keys, atlas) from hourly cells with their all-year mean."""
    met = sites.join(cells, keys)
    v = wind.rescaled(F.col("value"), F.col("atlas"), F.col("mean_all"))
    return met.groupBy("site_id").agg(F.avg(v).alias("speed"), F.avg(wind.capacity_factor(v)).alias("cf"))


def site_cf_years(sites: DataFrame, cells: DataFrame, years: list[int], keys: list[str] = CELL) -> DataFrame:
    """Mean over some years of the yearly means of points; hours of all years are (keys, year, hour, value, mean_all)."""
    met = sites.join(cells.where(F.col("year").isin(*years)), keys)
    v = wind.rescaled(F.col("value"), F.col("atlas"), F.col("mean_all"))
    yearly = met.groupBy("site_id", "year").agg(F.avg(v).alias("speed"), F.avg(wind.capacity_factor(v)).alias("cf"))
    return yearly.groupBy("site_id").agg(F.avg("speed").alias("speed"), F.avg("cf").alias("cf"))


def deviations(yearly: DataFrame) -> DataFrame:
    """(y1, y2, deviation): mean absolute difference over cells of every two different years of (cell, year, value).

    The years of a cell are one short array, so cells, not pairs of rows, are shuffled.
    """
    per = yearly.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("year", "value"))).alias("ys"))
    pairs = per.select(F.explode("ys").alias("a"), "ys").select("a", F.explode("ys").alias("b")).where("a.year <> b.year")
    return pairs.groupBy(F.col("a.year").alias("y1"), F.col("b.year").alias("y2")).agg(F.avg(F.abs(F.col("a.value") - F.col("b.value"))).alias("deviation"))


def climate_period(year: int) -> range:
    """The ten years whose mean stands for the climate around a year."""
    return range(1996, 2006) if year < 2030 else range(2046, 2056) if year < 2070 else range(2091, 2101)
