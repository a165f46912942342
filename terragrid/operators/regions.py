"""Region definitions and the tables made from them."""

from __future__ import annotations

import random
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import NOREGION
from .raster import KEYS, adjacency, nearest_fill, split_shore
from .spatial import distances

#: A pixel of the administrative raster that isn't painted: an inland sea.
SKIPPED = 78413


@dataclass(frozen=True)
class Admin:
    """Places by name: all of ``names`` below ``parents`` (at most two)."""

    parents: tuple[str, ...] = ()
    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Statistical:
    """Places by the beginning of their code."""

    codes: tuple[str, ...]


Definition = Admin | Statistical | tuple


def definition_rows(defs: Iterable[tuple[str, Definition]]) -> list[tuple]:
    """(region, name, kind, n0, n1, n2, order) of every part of every region, numbered from 1."""
    out = []
    for k, (name, d) in enumerate(defs, 1):
        for part in d if isinstance(d, tuple) else (d,):
            if isinstance(part, Statistical):
                out += [(k, name, "code", c, None, None) for c in part.codes]
            elif part.names:
                for n in part.names:
                    path = (*part.parents, n)
                    out.append((k, name, "admin", *path, *[None] * (3 - len(path))))
            else:
                out.append((k, name, "admin", *part.parents, *[None] * (3 - len(part.parents))))
    return [(*row, i) for i, row in enumerate(out)]


def definitions(spark: SparkSession, defs: Iterable[tuple[str, Definition]]) -> DataFrame:
    return spark.createDataFrame(definition_rows(defs), "region int, name string, kind string, n0 string, n1 string, n2 string, ord int")


def lookup_admin(places: DataFrame, defs: DataFrame) -> DataFrame:
    """Region of each place (n0, n1, n2): a definition of the whole country wins over one of the province,
    that over one of the district; of equal keys the last.  Definitions are few: written by hand."""
    own = defs.where("kind = 'admin'").groupBy("n0", "n1", "n2").agg(F.max_by("region", "ord").alias("r"))
    out = places
    for depth in (1, 2, 3):
        level = own.where(" AND ".join(f"n{k} IS {'NOT ' if k < depth else ''}NULL" for k in range(3))).select(*(f"n{k}" for k in range(depth)), F.col("r").alias(f"r{depth}"))
        out = out.join(level, [f"n{k}" for k in range(depth)], "left")
    return out.select(*places.columns, F.coalesce("r1", "r2", "r3", F.lit(0)).alias("region"))


def lookup_codes(codes: DataFrame, defs: DataFrame, col: str = "code", longest: int = 5) -> DataFrame:
    """Region of each code by its longest defined beginning, of at least two characters."""
    own = defs.where("kind = 'code'").groupBy(F.col("n0").alias("key")).agg(F.max_by("region", "ord").alias("r"))
    out = codes
    for n in range(longest, 1, -1):
        part = own.where(F.length("key") == n).select(F.col("key").alias(f"key{n}"), F.col("r").alias(f"r{n}"))
        out = out.join(part, F.substring(F.col(col), 1, n) == F.col(f"key{n}"), "left")
    return out.select(*codes.columns, F.coalesce(*(f"r{n}" for n in range(longest, 1, -1)), F.lit(0)).alias("region"))


def painted(pixels: DataFrame, admin: DataFrame, codes: DataFrame, defs: DataFrame) -> DataFrame:
    """Region of each pixel (lon_idx, lat_idx, admin_uid, code_uid): codes are painted first and stay."""
    a = lookup_admin(admin.where((F.col("uid") != 0) & (F.col("uid") != SKIPPED)), defs).select(F.col("uid").alias("admin_uid"), F.nullif("region", F.lit(0)).alias("ra"))
    c = lookup_codes(codes, defs).select(F.col("uid").alias("code_uid"), F.nullif("region", F.lit(0)).alias("rc"))
    return pixels.join(a, "admin_uid", "left").join(c, "code_uid", "left").select(*pixels.columns, F.coalesce("rc", "ra", F.lit(0)).alias("region"))


def saved_regions(pixels: DataFrame, background: bool = False) -> DataFrame:
    """From (lon_idx, lat_idx, region, admin_uid, land): foreign land is NOREGION, the sea belongs to the
    nearest region, and both are split into regions and offshore regions."""
    marked = pixels.withColumn("marked", F.when((F.col("region") == 0) & (F.col("admin_uid") > 0), NOREGION).otherwise(F.col("region")))
    filled = nearest_fill(marked.select(*KEYS, F.col("marked").alias("region"))).withColumnRenamed("region", "territory")
    on, off = split_shore(F.col("territory"), F.col("land"), background)
    return marked.drop("region").join(filled, KEYS).select(*KEYS, on.alias("region"), off.alias("offshore"))


def subregions(places: DataFrame, *path: str) -> DataFrame:
    """Sorted names directly below a place."""
    held = places
    for k, name in enumerate(path):
        held = held.where(F.col(f"n{k}") == name)
    return held.select(F.col(f"n{len(path)}").alias("name")).where("name is not null and name <> ''").distinct().orderBy("name")


def code_subregions(codes: DataFrame, prefix: str = "", col: str = "code") -> DataFrame:
    """Codes that begin with ``prefix``; all two-letter beginnings without one."""
    out = codes.where(F.col(col).startswith(prefix)).select(F.col(col).alias("name")) if prefix else codes.select(F.substring(col, 1, 2).alias("name"))
    return out.distinct().orderBy("name")


def all_subregions(places: DataFrame, level: int) -> DataFrame:
    """Every place at a level, or its deepest ancestor where it has none there."""
    best = F.coalesce(*(F.nullif(F.col(f"n{k}"), F.lit("")) for k in range(level, -1, -1)))
    return places.select(F.col("n0"), *(F.col(f"n{k}") for k in range(1, level)), best.alias("name")).distinct()


def grouped_countries(groups: dict[str, list[str]], countries: DataFrame, spark: SparkSession) -> DataFrame:
    """Country to scenario group; '' for one without; an unknown country in the groups is an error."""
    rows = [(g, c) for g, members in groups.items() for c in members]
    known = spark.createDataFrame(rows, "grp string, country string")
    unknown = known.join(countries, "country", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"no such country: {', '.join(r['country'] for r in unknown)}")
    return countries.join(known, "country", "left").select(*countries.columns, F.coalesce("grp", F.lit("")).alias("grp"))


def centres(pixels: DataFrame, weight: str = "popdens") -> DataFrame:
    """Plain and weighted centre of each region of (region, lon, lat, weight)."""

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight))

    held = pixels.where((F.col("region") > 0) & (F.col("region") != NOREGION))
    return held.groupBy("region").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), mean("lat").alias("pop_lat"), mean("lon").alias("pop_lon"))


def land_near_centre(pixels: DataFrame, middle: DataFrame) -> DataFrame:
    """Per region, the pixel that is best by nearness to the centre and share of land around it."""
    from ..functions.grid import haversine_km

    met = pixels.join(middle.select("region", "pop_lat", "pop_lon"), "region")
    score = 0.1 * haversine_km(F.col("lat"), F.col("lon"), F.col("pop_lat"), F.col("pop_lon")) / 10000 + 0.9 * (1 - F.col("landshare"))
    return met.groupBy("region").agg(F.min_by(F.struct("lat", "lon"), F.struct(score, F.col("lat"), F.col("lon"))).alias("p")).select("region", "p.lat", "p.lon")


def region_graph(regions: DataFrame, middle: DataFrame) -> DataFrame:
    """(r1, r2, km, connected, connected_offshore): regions joined at sea only if not on land."""
    on = adjacency(regions).withColumn("connected", F.lit(True))
    off = adjacency(regions.select(*KEYS, F.col("offshore").alias("region"))).withColumn("at_sea", F.lit(True))
    pairs = distances(middle.select("region", F.col("pop_lat").alias("lat"), F.col("pop_lon").alias("lon")))
    met = pairs.join(on, ["r1", "r2"], "left").join(off, ["r1", "r2"], "left")
    yes = F.coalesce("connected", F.lit(False))
    return met.select("r1", "r2", "km", yes.alias("connected"), (F.coalesce("at_sea", F.lit(False)) & ~yes).alias("connected_offshore"))


def greedy_colours(edges: list[tuple[int, int]], nodes: list[int], colours: int, seed: int = 1, tries: int = 1000) -> dict[int, int]:
    """Colours of a map's regions, on the driver: a few hundred nodes."""
    rng, near = random.Random(seed), {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for _ in range(tries):
        out: dict[int, int] = {}
        for n in rng.sample(nodes, len(nodes)):
            free = [c for c in range(colours) if c not in {out.get(m) for m in near[n]}]
            if not free:
                break
            out[n] = free[0]
        if len(out) == len(nodes):
            return out
    raise ValueError("more colours are needed")
