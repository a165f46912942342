"""Spatial joins, all of them as equi-joins on integer keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import haversine_km, lon_to_row, plant_lat_index
from ..options import NOREGION

#: Tables up to this number of rows may be sent to every task.
FEW_SITES = 100_000
#: Into so many blocks one side of all pairs is cut.
PAIR_BLOCKS = 64
#: So many regions of equal place meet a block at once; Spark holds all their pairs with it in memory.
PAIR_HELD = 16


def few(df: DataFrame, most: int = FEW_SITES) -> DataFrame:
    """The table with a broadcast hint, after its size has been checked."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows are too many to broadcast")
    return F.broadcast(df)


def point_region(points: DataFrame, regions: DataFrame, res: float, value: str = "region", search: int = 2) -> DataFrame:
    """Region of each point; where it is 0, the largest one within ``search`` pixels; 0 outside the raster.

    The pixels that hold points look around themselves; the raster is only read and joined once.
    """
    at = points.withColumn("lon_idx", lon_to_row(F.col("lon"), res)).withColumn("lat_idx", plant_lat_index(F.col("lat"), res))
    shift = F.explode(F.sequence(F.lit(-search), F.lit(search)))
    asked = at.select(F.col("lon_idx").alias("i"), F.col("lat_idx").alias("j")).distinct().select("i", "j", shift.alias("a")).select("*", shift.alias("b"))
    asked = asked.withColumn("lon_idx", F.col("i") + F.col("a")).withColumn("lat_idx", F.col("j") + F.col("b"))
    held = regions.select("lon_idx", "lat_idx", F.col(value).alias("held"))
    here = (F.col("a") == 0) & (F.col("b") == 0)
    found = asked.join(held, ["lon_idx", "lat_idx"]).groupBy("i", "j").agg(F.max(F.when(here, F.col("held"))).alias("own"), F.max(F.when(F.col("held") > 0, F.col("held"))).alias("near"))
    met = at.join(found.withColumnsRenamed({"i": "lon_idx", "j": "lat_idx"}), ["lon_idx", "lat_idx"], "left")
    region = F.when(F.col("own").isNull(), 0).when(F.col("own") > 0, F.col("own")).otherwise(F.coalesce("near", F.lit(0)))
    return met.select(*points.columns, region.cast("int").alias(value))


def point_region_offshore(points: DataFrame, regions: DataFrame, offshore: DataFrame, res: float, value: str = "region") -> DataFrame:
    """Region of each point, else its offshore region, else NOREGION; and its pixel."""
    at = points.withColumn("lon_idx", lon_to_row(F.col("lon"), res)).withColumn("lat_idx", plant_lat_index(F.col("lat"), res))
    on = regions.select("lon_idx", "lat_idx", F.nullif(F.col(value), F.lit(0)).alias("on_"))
    off = offshore.select("lon_idx", "lat_idx", F.nullif(F.col(value), F.lit(0)).alias("off_"))
    met = at.join(on, ["lon_idx", "lat_idx"], "left").join(off, ["lon_idx", "lat_idx"], "left")
    return met.select(*points.columns, "lon_idx", "lat_idx", F.coalesce("on_", "off_", F.lit(NOREGION)).cast("int").alias(value), F.col("on_").isNotNull().alias("onshore"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Is a point inside a ring, given as array<struct<x, y>>?  By crossings of a ray to the east."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))
    crossed = F.filter(edges, lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < e.x1 + F.try_divide((y - e.y1) * (e.x2 - e.x1), e.y2 - e.y1)))
    return F.size(crossed) % 2 == 1


def point_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, id_col: str = "point_id", poly_col: str = "poly_id") -> DataFrame:
    """First polygon (the least number) that holds each point, else 0.

    Both sides are cut into square cells; a ring goes to the cells of its box.  A polygon may have several
    rings, a row each: a point is inside if it lies in an odd number of them, so holes and parts count.
    """
    xs, ys = F.transform("ring", lambda p: p.x), F.transform("ring", lambda p: p.y)

    def cells(v: Column) -> Column:
        return F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell))

    spread = polygons.select(poly_col, "ring", F.explode(cells(xs)).alias("ci")).withColumn("cj", F.explode(cells(ys)))
    at = points.withColumn("ci", F.floor(F.col("x") / cell)).withColumn("cj", F.floor(F.col("y") / cell))
    hit = at.join(spread, ["ci", "cj"]).where(inside(F.col("x"), F.col("y"), F.col("ring"))).groupBy(id_col, poly_col).agg(F.count("*").alias("rings")).where("rings % 2 = 1").groupBy(id_col).agg(F.min(poly_col).alias(poly_col))
    return points.join(hit, id_col, "left").withColumn(poly_col, F.coalesce(poly_col, F.lit(0)))


def degrees_apart_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """The plain distance by degrees that registers are matched with."""
    return 111.0 * F.sqrt(F.pow(lon1 - lon2, 2) + F.pow(lat1 - lat2, 2))


def places(sites: DataFrame, site_col: str) -> DataFrame:
    """Sites of equal place once, under their least id: the only one that can be nearest."""
    return sites.groupBy(F.col("lon").alias("x"), F.col("lat").alias("y")).agg(F.min(site_col).alias(site_col))


def candidate_cells(spark: SparkSession, asking: DataFrame, occupied: DataFrame, cell: float, limit: int = 1 << 20) -> DataFrame:
    """``pi, pj, ci, cj``: for each square cell (pi, pj) the occupied cells that can hold the site nearest to one of its points.

    Of a cell's occupied cells, the one whose farthest place is nearest bounds the distance; every cell with a
    place within that bound is a candidate.  Occupied cells are at most as many as the earth has (64,800 of one
    degree), and that is checked before they reach the driver.
    """
    held = occupied.limit(limit + 1).collect()
    if len(held) > limit:
        raise ValueError(f"more than {limit} cells with sites: choose larger cells")
    sent = spark.sparkContext.broadcast(np.array(sorted((r["ci"], r["cj"]) for r in held), np.int64).reshape(-1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        for batch in batches:
            for i, j in zip(batch.column("pi").to_pylist(), batch.column("pj").to_pylist(), strict=True):
                apart = np.abs(cells - (i, j))
                most = ((apart + 1) ** 2).sum(axis=1).min() if len(cells) else 0
                near = cells[(np.maximum(apart - 1, 0) ** 2).sum(axis=1) <= most]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), i)), pa.array(np.full(len(near), j)), pa.array(near[:, 0]), pa.array(near[:, 1])], ["pi", "pj", "ci", "cj"])

    return asking.mapInArrow(run, "pi long, pj long, ci long, cj long")


def nearest_few(points: DataFrame, sites: DataFrame, id_col: str, site_col: str, cell: float = 1.0) -> DataFrame:
    """Nearest site to each point, the least id of a tie, however many points and sites there are.

    Both sides are cut into cells; a point meets the sites of the cells in which its nearest one can be,
    so the work follows the density of sites, not points times sites.
    """
    once = places(sites, site_col).select(site_col, "x", "y", F.floor(F.col("x") / cell).alias("ci"), F.floor(F.col("y") / cell).alias("cj"))
    at = points.select(id_col, "lon", "lat", F.floor(F.col("lon") / cell).alias("pi"), F.floor(F.col("lat") / cell).alias("pj"))
    cells = candidate_cells(points.sparkSession, at.select("pi", "pj").distinct(), once.select("ci", "cj").distinct(), cell)
    # sites meet the point cells that ask for them before the points do
    offered = cells.join(once, ["ci", "cj"]).select("pi", "pj", site_col, "x", "y")
    km = degrees_apart_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    best = at.join(offered, ["pi", "pj"]).groupBy(id_col, "lon", "lat").agg(F.min(F.struct(km.alias("km"), F.col(site_col).alias("id"))).alias("n"))
    return points.join(best, [id_col, "lon", "lat"], "left").select(*points.columns, F.col("n.id").alias(site_col), F.col("n.km").alias("km"))


def nearest_within(points: DataFrame, sites: DataFrame, id_col: str, site_col: str, most: float) -> DataFrame:
    """Nearest site within ``most`` degrees of each point, else null, for any number of sites: sites are
    copied to the nine cells around theirs."""
    shift = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    spread = places(sites, site_col).select(site_col, "x", "y", shift.alias("a")).withColumn("b", shift)
    spread = spread.withColumn("ci", F.floor(F.col("x") / most) + F.col("a")).withColumn("cj", F.floor(F.col("y") / most) + F.col("b"))
    at = points.select(id_col, "lon", "lat").withColumn("ci", F.floor(F.col("lon") / most)).withColumn("cj", F.floor(F.col("lat") / most))
    d2 = F.pow(F.col("lon") - F.col("x"), 2) + F.pow(F.col("lat") - F.col("y"), 2)
    best = at.join(spread, ["ci", "cj"]).withColumn("d2", d2).where(F.col("d2") < most * most).groupBy(id_col).agg(F.min(F.struct("d2", F.col(site_col))).alias("n"))
    return points.join(best, id_col, "left").select(*points.columns, F.col(f"n.{site_col}").alias(site_col), F.sqrt("n.d2").alias("degrees"))


def regridded(grid: DataFrame, curvilinear: DataFrame, series: DataFrame, res: float, cutoff: float) -> DataFrame:
    """Series of the nearest curvilinear cell for each cell of a regular grid (cell, lon, lat); null where
    the squared distance reaches ``cutoff`` times the squared resolution."""
    near = nearest_within(grid, curvilinear, "cell", "source_cell", res * cutoff**0.5)
    return near.join(series, "source_cell", "left")


def distances(centres: DataFrame, compat: bool = False) -> DataFrame:
    """All pairs of region centres (region, lat, lon), each with itself: that is the result, n² rows for n regions.

    Regions of equal place are held together, some at once, so that a distance is computed once for their pairs.
    One side is cut into blocks of regions, and both are dealt to as many tasks as there are blocks, however small
    the table: its size tells nothing about the number of pairs, and by size all would be made in one task.
    """
    block, held = F.pmod(F.xxhash64("region", "lat", "lon"), F.lit(PAIR_BLOCKS)).alias("block"), F.collect_list(F.struct("region"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_BLOCKS - 1).cast("long"))).alias("block")
    a = centres.groupBy(F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).agg(held.alias("held1"))
    a = a.select("lat1", "lon1", "held1", F.explode(F.sequence(F.lit(1), F.size("held1"), F.lit(PAIR_HELD))).alias("first")).withColumn("held1", F.slice("held1", F.col("first"), PAIR_HELD))
    b = centres.groupBy(block, F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).agg(held.alias("held2"))
    blocks = b.groupBy("block").agg(F.collect_list(F.struct("lat2", "lon2", "held2")).alias("b")).repartition(PAIR_BLOCKS, "block")
    dealt = a.select("lat1", "lon1", "held1", every).repartition(PAIR_BLOCKS, "block")
    met = dealt.join(blocks.hint("shuffle_hash"), "block").select("lat1", "lon1", "held1", F.inline("b"))
    km = met.select("held1", "held2", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), compat).alias("km"))
    return km.select("held2", "km", F.inline("held1").alias("r1")).select("r1", F.inline("held2").alias("r2"), "km")


def rasterized(polygons: DataFrame, res: float, west: float, north: float) -> DataFrame:
    """(lon_idx, lat_idx, poly_id) of the pixels whose centre lies in a polygon (poly_id, ring); the first of several.

    By scan lines: every edge tells where it crosses the centre lines of its rows; between the first and the
    second crossing of a row, the third and the fourth, and so on, all pixels are inside.  A polygon may have
    several rows: its rings, holes among them.
    """
    n = F.size("ring")
    edges = polygons.select("poly_id", F.explode(F.zip_with("ring", F.concat(F.slice("ring", 2, n), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))).alias("e")).select("poly_id", "e.*").where("y1 <> y2")
    # rows j with the lower end <= north - res * (j - 0.5) < the upper end
    first = F.floor((F.lit(north) - F.greatest("y1", "y2")) / res + 0.5) + 1
    last = F.floor((F.lit(north) - F.least("y1", "y2")) / res + 0.5)
    rows = edges.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("j"))
    y = F.lit(north) - res * (F.col("j") - 0.5)
    crossing = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    lines = rows.groupBy("poly_id", "j").agg(F.sort_array(F.collect_list(crossing)).alias("xs"))
    low, high = F.col("xs")[F.col("k") * 2], F.col("xs")[F.col("k") * 2 + 1]
    runs = lines.select("*", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1)).alias("k")).select("poly_id", "j", F.ceil((low - west) / res + 0.5).alias("a"), (F.ceil((high - west) / res + 0.5) - 1).alias("b"))
    cells = runs.where("a <= b").select("poly_id", F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))).alias("lon_idx"), F.col("j").cast("int").alias("lat_idx"))
    return cells.groupBy("lon_idx", "lat_idx").agg(F.min("poly_id").cast("int").alias("poly_id"))


def service_areas(pixels: DataFrame, sites: DataFrame) -> DataFrame:
    """Pixels (lon, lat) with their nearest site: a Voronoi division by raster.  Sites of equal place count once."""
    once = sites.groupBy("lon", "lat").agg(F.min("site_id").alias("site_id"))
    return nearest_few(pixels, once, "pixel_id", "site_id")


def area_sizes(areas: DataFrame, sites: DataFrame, land: str = "land") -> DataFrame:
    """Pixels on land and at sea of every site's area, 0 for a site without any."""
    n = areas.groupBy("site_id").agg(F.count_if(F.col(land) > 0).alias("onshore"), F.count_if(F.col(land) == 0).alias("offshore"))
    return sites.select("site_id").join(n, "site_id", "left").fillna(0)
