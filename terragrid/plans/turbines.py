"""Statistics of existing wind turbines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bin_index


def by_pixel(turbines: DataFrame, key: str = "pixel_id") -> DataFrame:
    """(pixel, n, latest, capacity_kw)."""
    return turbines.groupBy(key).agg(F.count("*").alias("nturbines"), F.max("yr").alias("turbineyear"), F.sum("capac_kw").alias("turbinecapac"))


def pixel_table(pixels: DataFrame, turbines: DataFrame, key: str = "pixel_id") -> DataFrame:
    """Pixels with their turbines; those without have zeros."""
    return pixels.join(by_pixel(turbines, key), key, "left").fillna(0, ["nturbines", "turbineyear", "turbinecapac"])


def in_years(first: int, last: int) -> Column:
    return F.col("turbineyear").between(first, last)


def by_code(table: DataFrame, keys: list[str], first: int, last: int, total: str | None = None) -> DataFrame:
    """Area (1000 km²), turbines, capacity (MW) and density per code; with ``total``, also over all codes (null)."""
    use = in_years(first, last)
    mw, n = F.when(use, F.col("turbinecapac") / 1000).otherwise(0.0), F.when(use, F.col("nturbines")).otherwise(0)
    groups = table.rollup(*keys) if total else table.groupBy(*keys)
    out = groups.agg((F.sum("area_km2") / 1000).alias("area"), F.sum(n).cast("long").alias("nturbines"), F.sum(mw).alias("capac_mw"), F.grouping_id().alias("lvl") if total else F.lit(0).alias("lvl"))
    out = out.withColumn("density", F.try_divide(F.col("capac_mw"), F.col("area") * 1000))
    return out.where("lvl <= 1").drop("lvl") if total else out.drop("lvl")


def histogram(table: DataFrame, value: str, breaks: list[float], first: int, last: int) -> DataFrame:
    """(bin, low, high, pixels, area, nturbines, capac_mw), zeros for empty bins."""
    use = in_years(first, last)
    held = table.groupBy(bin_index(F.col(value), breaks).alias("bin")).agg(F.count("*").alias("pixels"), F.sum("area_km2").alias("area"), F.sum(F.when(use, F.col("nturbines")).otherwise(0)).alias("nturbines"), F.sum(F.when(use, F.col("turbinecapac") / 1000).otherwise(0.0)).alias("capac_mw"))
    edges = F.array(*map(F.lit, breaks))
    bins = table.sparkSession.range(len(breaks)).select(F.col("id").cast("int").alias("bin"))
    return bins.join(held, "bin", "left").fillna(0).select("bin", F.get(edges, F.col("bin")).alias("low"), F.get(edges, F.col("bin") + 1).alias("high"), "pixels", "area", "nturbines", "capac_mw")


def contingency(pixels: DataFrame, row: str, col: str, values: list[int]) -> DataFrame:
    """Counts of rows by columns, 0 where there is none."""
    out = pixels.groupBy(row).pivot(col, values).count().fillna(0)
    return out.select(row, *(F.col(str(v)).alias(f"c{v}") for v in values))


def top_codes(pixels: DataFrame, key: str, code: str, k: int = 3) -> DataFrame:
    """The k most frequent codes of each group, the higher code of a tie first."""
    n = pixels.groupBy(key, code).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), F.desc(code))
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def municipal(pixels: DataFrame, turbines: DataFrame, density: float = 5.0, share: float = 0.08, minclass: int = 0, key: str = "region") -> DataFrame:
    """Exploitation of each region: areas, turbines, and shares of turbines at excluded places.

    ``pixels`` has pixel_id, region, area_km2, popdens, class, atlas and booleans nogrid, highpop,
    badland, kept, ok.  A turbine may count in several shares.
    """
    area = pixels.groupBy(key).agg(F.sum("area_km2").alias("area"), F.sum(F.when(F.col("ok") & (F.col("class") >= minclass), F.col("area_km2")).otherwise(0.0)).alias("area_ok"))
    met = turbines.join(pixels, "pixel_id").where(F.col("class") >= minclass)
    on = F.coalesce("onshore", F.lit(True))
    masked = on & ~F.col("ok")
    pct = lambda c, of: 100 * F.try_divide(F.count_if(c), of)
    stats = met.groupBy(key).agg(
        F.count("*").alias("n"), (F.sum("capac_kw") / 1000).alias("mw"), (F.sum(F.when(F.col("ok"), F.col("capac_kw")).otherwise(0.0)) / 1000).alias("mw_ok"),
        pct(on, F.count("*")).alias("onshore_pct"), F.avg("class").alias("mean_class"), F.avg("atlas").alias("windspeed"), pct(masked, F.count("*")).alias("masked_pct"),
        *(pct(masked & F.col(c), F.count_if(masked)).alias(f"{c}_pct") for c in ("nogrid", "highpop", "badland", "kept")),
        F.try_divide(F.sum(F.col("capac_kw") * F.col("popdens")), F.sum("capac_kw")).alias("turbine_popdens"),
    )
    out = area.join(stats, key, "left").fillna(0, ["n", "mw", "mw_ok"])
    maxcap = F.col("area") * density * share
    return out.withColumn("maxcap_mw", maxcap).withColumn("dens_tot", F.try_divide("mw", "area")).withColumn("dens_ok", F.try_divide("mw_ok", "area_ok")).withColumn("exploit_pct", F.try_divide(100 * share * F.col("mw"), maxcap))


def numbered_union(tables: list[tuple[str, DataFrame]], id_col: str = "munic") -> DataFrame:
    """Tables one below the other, with ids running on and the table's number."""
    out, spark = None, tables[0][1].sparkSession
    for k, (name, df) in enumerate(tables, 1):
        part = df.withColumn("country", F.lit(k)).withColumn("country_name", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    sizes = out.groupBy("country").agg(F.max(id_col).alias("size")).withColumn("start", F.coalesce(F.sum("size").over(Window.orderBy("country").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("country", "start")
    return out.join(sizes, "country").withColumn(id_col, F.col(id_col) + F.col("start")).drop("start")
