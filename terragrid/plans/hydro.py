"""Existing and potential hydro power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import dms_to_degrees
from ..functions.scalar import DAYS, first_interval, hydro_site
from ..operators.spatial import nearest_few
from ..options import HydroOptions

MONTHS = [f"m{k}" for k in range(1, 13)]


def repaired(plants: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Coordinates written as DDDMMSS are converted; swapped ones are swapped back."""
    a, o = F.col(lat).cast("double"), F.col(lon).cast("double")
    packed = (F.abs(a) > 1000) | (F.abs(o) > 1000)
    a, o = F.when(packed, dms_to_degrees(a)).otherwise(a), F.when(packed, dms_to_degrees(o)).otherwise(o)
    swapped = (F.abs(a) > 90) & (F.abs(o) <= 90)
    return plants.withColumns({lat: F.when(swapped, o).otherwise(a), lon: F.when(swapped, a).otherwise(o)})


def monthly_share(profile: Column) -> Column:
    """Share of the year's energy in each month, from flows."""
    energy = F.zip_with(profile, F.array(*[F.lit(float(d)) for d in DAYS]), lambda q, d: q * d)
    return F.transform(energy, lambda x: F.try_divide(x, F.aggregate(energy, F.lit(0.0), lambda a, b: a + b)))


def existing(plants: DataFrame, sites: DataFrame, national: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, capacity_gw) and (region, month, inflow_cf).

    Plants (plant_id, lon, lat, country, region, capacity_mw) are scaled to the capacity of their country
    (country, capacity_mw, generation_gwh) and follow the profile of the nearest site (site_id, lon, lat,
    profile).
    """
    total = plants.groupBy("country").agg(F.sum("capacity_mw").alias("register_mw"))
    ratio = F.try_divide(F.col("national_mw"), F.col("register_mw"))
    scaled = plants.join(total, "country").join(national.select("country", F.col("capacity_mw").alias("national_mw"), "generation_gwh"), "country", "left")
    scaled = scaled.withColumn("mw", F.col("capacity_mw") * F.when(ratio > 0, ratio).otherwise(1.0)).withColumn("cf", F.coalesce(F.try_divide(F.col("generation_gwh") * 1000 / 8760, F.col("national_mw")), F.lit(0.0)))
    held = scaled.where("region > 0 AND region <> 32767")
    near = nearest_few(held, sites, "plant_id", "site_id").join(sites.select("site_id", monthly_share(F.col("profile")).alias("share")), "site_id")
    months = near.select("region", "mw", "cf", F.posexplode("share").alias("k", "share")).withColumn("days", F.get(F.array(*map(F.lit, DAYS)), F.col("k")))
    inflow = months.groupBy("region", (F.col("k") + 1).alias("month")).agg(F.try_divide(F.sum(F.col("mw") * F.col("cf") * F.col("share") * 365 / F.col("days")), F.sum("mw")).alias("inflow_cf"))
    return held.groupBy("region").agg((F.sum("mw") / 1000).alias("capacity_gw")), inflow


def potential_rows(sites: DataFrame) -> DataFrame:
    """Physics of each site (coe, production_gwh, capcost, system, volume_mm3, flow: array of twelve)."""
    h = hydro_site(F.col("coe"), F.col("production_gwh"), F.col("capcost"), F.col("system"), F.col("volume_mm3"), F.col("flow"))
    return sites.select("*", h.capacity_mw.alias("capacity_mw"), h.cf.alias("cf"), h.head_m.alias("head_m"), h.reservoir_gwh.alias("reservoir_gwh"), h.discharge_h.alias("discharge_h"), h.monthly_gwh.alias("monthly_gwh"), h.coe.alias("cost"))


def potential(rows: DataFrame, o: HydroOptions = HydroOptions()) -> tuple[DataFrame, DataFrame]:
    """(region, cost_class, storage_class, capacity_gw, mean_cost, mean_discharge_h) and the monthly inflow.

    Sites outside all classes have null classes and are left out.
    """
    cost = first_interval(F.col("cost") * 1000, o.costclasses_min, o.costclasses_max)
    store = first_interval(F.col("discharge_h") / 168.0, o.storageclasses_min, o.storageclasses_max)
    held = rows.withColumn("cost_class", cost).withColumn("storage_class", store).where("cost_class is not null and storage_class is not null and region > 0 and region <> 32767")
    keys = ["region", "cost_class", "storage_class"]
    total = held.groupBy(*keys).agg((F.sum("capacity_mw") / 1000).alias("capacity_gw"), F.avg(F.col("cost") * 1000).alias("mean_cost"), F.avg(F.least(F.lit(8760.0), F.col("discharge_h"))).alias("mean_discharge_h"))
    months = held.select(*keys, "capacity_mw", F.posexplode("monthly_gwh").alias("k", "gwh")).withColumn("days", F.get(F.array(*map(F.lit, DAYS)), F.col("k")))
    inflow = months.groupBy(*keys, (F.col("k") + 1).alias("month")).agg(F.try_divide(F.sum(F.col("gwh") * 1000 / 24 / F.col("days")), F.sum("capacity_mw")).alias("inflow_cf"))
    return total, inflow


def excluded(rows: DataFrame, o: HydroOptions = HydroOptions()) -> DataFrame:
    """How many sites have no class."""
    cost = first_interval(F.col("cost") * 1000, o.costclasses_min, o.costclasses_max)
    store = first_interval(F.col("discharge_h") / 168.0, o.storageclasses_min, o.storageclasses_max)
    return rows.agg(F.count_if(cost.isNull() | store.isNull()).alias("excluded"))


def normalised(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A value relative to its group's mean."""
    return df.withColumn(name, F.try_divide(F.col(value), F.avg(value).over(Window.partitionBy(*keys))))
