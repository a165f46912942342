"""Geometry of regular longitude/latitude grids as column expressions and driver-side scalars.

Pixel indexes are one-based and global; longitude runs east from -180, latitude south from 90.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 2 * math.pi * EARTH_KM / 360


@dataclass(frozen=True)
class GridSpec:
    """Resolution and extent; the extent must be a whole number of pixels."""

    res: float = 0.01
    lonlim: tuple[float, float] = (-180.0, 180.0)
    latlim: tuple[float, float] = (-90.0, 90.0)

    def __post_init__(self) -> None:
        for low, high in (self.lonlim, self.latlim):
            n = (high - low) / self.res
            if n <= 0 or abs(n - round(n)) > 1e-6:
                raise ValueError("the extent isn't a whole number of pixels")

    @property
    def nlon(self) -> int:
        return round((self.lonlim[1] - self.lonlim[0]) / self.res)

    @property
    def nlat(self) -> int:
        return round((self.latlim[1] - self.latlim[0]) / self.res)

    def lon(self, i: Column) -> Column:
        return F.lit(self.lonlim[0]) + self.res * (i - 0.5)

    def lat(self, j: Column) -> Column:
        return F.lit(self.latlim[1]) - self.res * (j - 0.5)

    def lon_index(self, lon: Column, restrict: bool = False) -> Column:
        return self._clamped(F.floor((lon - self.lonlim[0]) / self.res) + 1, self.nlon, restrict)

    def lat_index(self, lat: Column, restrict: bool = False) -> Column:
        return self._clamped(F.floor((F.lit(self.latlim[1]) - lat) / self.res) + 1, self.nlat, restrict)

    @staticmethod
    def _clamped(i: Column, n: int, restrict: bool) -> Column:
        return (F.least(F.greatest(i, F.lit(1)), F.lit(n)) if restrict else i).cast("int")

    def crop(self, left: float, bottom: float, right: float, top: float) -> GridSpec:
        """The grid of the pixels that the box touches."""
        return GridSpec(self.res, (round_out(left, self.res, False), round_out(right, self.res, True)), (round_out(bottom, self.res, False), round_out(top, self.res, True)))

    def lons(self) -> list[float]:
        return [self.lonlim[0] + self.res * (k + 0.5) for k in range(self.nlon)]

    def lats(self) -> list[float]:
        return [self.latlim[1] - self.res * (k + 0.5) for k in range(self.nlat)]


def round_out(x: float, res: float, up: bool) -> float:
    """The next edge of the grid outwards."""
    n = x / res
    return (math.ceil(n - 1e-9) if up else math.floor(n + 1e-9)) * res


def row_to_lon(i: Column, res: float) -> Column:
    return (i - 0.5) * res - 180.0


def col_to_lat(j: Column, res: float) -> Column:
    return F.lit(90.0) - (j - 0.5) * res


def lon_to_row(lon: Column, res: float) -> Column:
    """Pixel of a longitude, which may lie any number of turns off."""
    return (F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / res) + 1).cast("int")


def lat_to_col(lat: Column, res: float) -> Column:
    """Pixel of a latitude; the south pole is in the last one."""
    return F.least(F.floor((F.lit(90.0) - lat) / res) + 1, F.lit(round(180 / res))).cast("int")


def plant_lat_index(lat: Column, res: float) -> Column:
    """Pixel whose lower edge belongs to it: how registers of plants are looked up."""
    return F.greatest(F.ceil((F.lit(90.0) - lat) / res), F.lit(1)).cast("int")


def checked_lonlat(lon: Column, lat: Column) -> Column:
    """Null for coordinates on the globe, an error otherwise."""
    return F.assert_true(lon.between(-180, 180) & lat.between(-90, 90), "coordinates aren't on the globe")


def cell_area_km2(lat: Column, res: float) -> Column:
    """Area of a pixel at a latitude."""
    return F.cos(F.radians(lat)) * (KM_PER_DEGREE * res) ** 2


def coarse_index(p: Column, num: int = 8, den: int = 225) -> Column:
    """Coarse cell of a fine pixel, by its far edge: the ratio of the resolutions is num / den."""
    x = p.cast("long") * num + (den - 1)
    return ((x - F.pmod(x, F.lit(den))) / den).cast("int")


def index_ranges(west: float, east: float, res: float) -> list[tuple[int, int]]:
    """Pixel ranges of a box's longitudes: two if it crosses the antimeridian."""
    n = round(360 / res)
    first = math.floor(((west + 180) % 360) / res + 1e-9) + 1
    last = math.ceil(((east + 180) % 360) / res - 1e-9) or n
    return [(first, last)] if first <= last else [(first, n), (1, last)]


def lat_range(south: float, north: float, res: float) -> tuple[int, int]:
    return math.floor((90 - north) / res + 1e-9) + 1, math.ceil((90 - south) / res - 1e-9)


def within(i: Column, ranges: list[tuple[int, int]]) -> Column:
    """One pushed-down predicate for all ranges."""
    return reduce(lambda a, b: a | b, [i.between(a, b) for a, b in ranges])


def crop(raster: DataFrame, west: float, south: float, east: float, north: float, res: float) -> DataFrame:
    """Rows of a raster in a box; a box across the antimeridian has west > east."""
    return raster.where(within(F.col("lon_idx"), index_ranges(west, east, res)) & F.col("lat_idx").between(*lat_range(south, north, res)))


def axes(spark: SparkSession, grid: GridSpec) -> tuple[DataFrame, DataFrame]:
    """Dimension tables of a grid: (lon_idx, lon) and (lat_idx, lat, area_km2)."""
    lon = spark.range(1, grid.nlon + 1).select(F.col("id").cast("int").alias("lon_idx"), grid.lon(F.col("id")).alias("lon"))
    lat = spark.range(1, grid.nlat + 1).select(F.col("id").cast("int").alias("lat_idx"), grid.lat(F.col("id")).alias("lat"), cell_area_km2(grid.lat(F.col("id")), grid.res).alias("area_km2"))
    return lon, lat


def mesh(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """All pixels of a grid."""
    return spark.range(grid.nlon * grid.nlat).select((F.pmod(F.col("id"), F.lit(grid.nlon)) + 1).cast("int").alias("lon_idx"), (F.floor(F.col("id") / grid.nlon) + 1).cast("int").alias("lat_idx"))


def uncrop(raster: DataFrame, grid: GridSpec, zero=0) -> DataFrame:
    """A raster filled up to a whole grid."""
    return mesh(raster.sparkSession, grid).join(raster, ["lon_idx", "lat_idx"], "left").fillna(zero)


def lat_extent(raster: DataFrame, padding: int = 0, value: str = "region", noregion: int = 32767, nlat: int = 18000) -> DataFrame:
    """First and last latitude index with data, with padding."""
    held = raster.where((F.col(value) > 0) & (F.col(value) != noregion))
    return held.agg(F.greatest(F.min("lat_idx") - padding, F.lit(1)).alias("first_lat"), F.least(F.max("lat_idx") + padding, F.lit(nlat)).alias("last_lat"))


def lon_extent(raster: DataFrame, n: int, padding: int = 0, value: str = "region", noregion: int = 32767) -> DataFrame:
    """The longitudes with data around a circle of n: the longest empty run is left out.

    Distinct indexes reach one window, at most n of them.  ``first_lon`` to ``last_lon`` goes around
    the circle if the first is larger.  The run that begins last wins a tie.
    """
    lons = raster.where((F.col(value) > 0) & (F.col(value) != noregion)).select("lon_idx").distinct()
    order = Window.orderBy("lon_idx")
    all_of = Window.partitionBy()
    gaps = lons.withColumn("next", F.coalesce(F.lead("lon_idx").over(order), F.min("lon_idx").over(all_of) + n)).withColumn("gap", F.col("next") - F.col("lon_idx"))
    widest = gaps.agg(F.max_by(F.struct("lon_idx", "next", "gap"), F.struct("gap", "lon_idx")).alias("g"))
    # padding may use up the empty run, but not more
    pad = F.least(F.lit(padding), F.floor((F.col("g.gap") - 1) / 2))
    return widest.select((F.pmod(F.col("g.next") - pad - 1, F.lit(n)) + 1).cast("int").alias("first_lon"), (F.pmod(F.col("g.lon_idx") + pad - 1, F.lit(n)) + 1).cast("int").alias("last_lon"))


def dms_to_degrees(dms: Column) -> Column:
    """DDDMMSS as decimal degrees."""
    a = F.abs(dms)
    d = F.floor(a / 10000)
    m = F.floor((a - d * 10000) / 100)
    return F.signum(dms) * (d + m / 60 + (a - d * 10000 - m * 100) / 3600)


def leap_year(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, compat: bool = False) -> Column:
    """Great-circle distance; ``compat`` swaps the coordinates, as the original does."""
    if compat:
        lat1, lon1, lat2, lon2 = lon1, lat1, lon2, lat2
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def intermediate_point(lat1: Column, lon1: Column, lat2: Column, lon2: Column, f: Column) -> Column:
    """The point a fraction f along a great circle, as struct(lat, lon)."""
    d = haversine_km(lat1, lon1, lat2, lon2) / EARTH_KM
    a, b = F.sin((1 - f) * d) / F.sin(d), F.sin(f * d) / F.sin(d)
    p1, l1, p2, l2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    x, y = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2), a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))


def great_circle_track(lat1: Column, lon1: Column, lat2: Column, lon2: Column, n: int) -> Column:
    """n points from one end to the other."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: intermediate_point(lat1, lon1, lat2, lon2, k / (n - 1)))
