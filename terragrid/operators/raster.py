"""Raster algebra: focal, zonal and resampling operators on tables (lon_idx, lat_idx, value).

Focal operators work on tiles with a halo, one bounded array per group: a pixel is shuffled once, and
only pixels near a border of tiles more often.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_region
from ..options import NOREGION

KEYS = ["lon_idx", "lat_idx"]
#: Values that are filled by distance are below this.
DIGIT = 1 << 20


def covered(x0: float, x1: float, y0: float, y1: float, r: float) -> float:
    """Area of a rectangle in the first quadrant that lies within a circle around the origin."""

    def under(a: float, b: float) -> float:
        """Area under the circle's arc from a to b."""
        a, b = min(a, r), min(b, r)
        return 0.5 * (b * np.sqrt(r * r - b * b) - a * np.sqrt(r * r - a * a) + r * r * (np.arcsin(b / r) - np.arcsin(a / r)))

    whole = np.sqrt(max(r * r - y1 * y1, 0)) if r > y1 else 0.0  # up to here the rectangle's height is inside
    none = np.sqrt(max(r * r - y0 * y0, 0)) if r > y0 else 0.0  # from here nothing is
    a, b = np.clip([whole, none], x0, x1)
    return (a - x0) * (y1 - y0) + under(a, b) - y0 * (b - a)


@lru_cache(maxsize=8)
def disk_kernel(radius: float) -> np.ndarray:
    """Weights of a disk, each the share of its pixel that the disk covers, with sum 1."""
    n = max(int(np.ceil(radius - 0.5)), 0)
    edges = [(0.0, 0.5, 2), *((k - 0.5, k + 0.5, 1) for k in range(1, n + 1))]  # a pixel on an axis is twice its half
    quarter = np.array([[u * v * covered(x0, x1, y0, y1, radius) for y0, y1, v in edges] for x0, x1, u in edges])
    side = np.concatenate([quarter[:0:-1], quarter])
    k = np.concatenate([side[:, :0:-1], side], axis=1)
    return k / k.sum()


def offsets(weights: np.ndarray) -> list[tuple[int, int, float]]:
    n = len(weights) // 2
    return [(i - n, j - n, float(weights[i, j])) for i in range(len(weights)) for j in range(len(weights)) if weights[i, j] > 0]


def focal(raster: DataFrame, weights: list[tuple[int, int, float]], nlon: int, nlat: int, how: str = "sum", value: str = "value", tile: int = 512) -> DataFrame:
    """Weighted sum, or maximum, over neighbours of every pixel of the raster; the border is repeated
    outwards, and pixels that aren't in the table count 0."""
    halo = max(max(abs(a), abs(b)) for a, b, _ in weights)

    def gather(a: np.ndarray) -> np.ndarray:
        height, width = a.shape[0] - 2 * halo, a.shape[1] - 2 * halo
        out = None
        for i, j, w in weights:
            x = a[halo + i : halo + i + height, halo + j : halo + j + width]
            x = x * w if how == "sum" else x
            out = x.copy() if out is None else out + x if how == "sum" else np.maximum(out, x)
        return out

    return tiled(raster, gather, nlon, nlat, tile, halo, value)


def disk_mean_small(raster: DataFrame, radius: float, nlon: int, nlat: int, value: str = "value") -> DataFrame:
    """Disk mean with every weight by itself, for radii of a few pixels."""
    return focal(raster, offsets(disk_kernel(radius)), nlon, nlat, "sum", value)


def convolved(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Valid part of a correlation with a disk: whole runs by prefix sums, edge weights one by one."""
    n, height, width = len(k), a.shape[0] - len(k) + 1, a.shape[1] - len(k) + 1
    full = k.max()
    runs = np.concatenate([np.zeros((a.shape[0], 1)), a.cumsum(axis=1)], axis=1)
    out = np.zeros((height, width))
    for i in range(n):
        whole = np.flatnonzero(np.isclose(k[i], full, rtol=1e-9, atol=0))
        if len(whole):
            first, last = whole[0], whole[-1] + 1
            out += full * (runs[i : i + height, last : last + width] - runs[i : i + height, first : first + width])
        for j in np.flatnonzero((k[i] > 0) & ~np.isclose(k[i], full, rtol=1e-9, atol=0)):
            out += k[i, j] * a[i : i + height, j : j + width]
    return out


def by_tile(raster: DataFrame, run, schema: str, tile: int, halo: int, value: str, nlon: int | None = None, nlat: int | None = None) -> DataFrame:
    """``run`` on each tile's pixels, those of its halo included: columns lon_idx, lat_idx, v, ti, tj.

    Each pixel goes to the tiles whose halo holds it; a group is at most (tile + 2 halo)² pixels.
    """

    def tiles(i: Column, n: int | None) -> Column:
        last = F.floor((i - 1 + halo) / tile)
        return F.sequence(F.greatest(F.floor((i - 1 - halo) / tile), F.lit(0)), last if n is None else F.least(last, F.lit((n - 1) // tile)))

    spread = raster.select(*KEYS, F.col(value).cast("double").alias("v"), F.explode(tiles(F.col("lon_idx"), nlon)).alias("ti")).withColumn("tj", F.explode(tiles(F.col("lat_idx"), nlat)))
    return spread.groupBy("ti", "tj").applyInPandas(run, schema)


def as_array(pdf: pd.DataFrame, tile: int, halo: int, missing: float) -> tuple[int, int, np.ndarray]:
    """What lies before a tile in the grid, and the tile with its halo."""
    i0, j0 = int(pdf.ti.iloc[0]) * tile, int(pdf.tj.iloc[0]) * tile
    a = np.full((tile + 2 * halo, tile + 2 * halo), missing)
    a[pdf.lon_idx - 1 - i0 + halo, pdf.lat_idx - 1 - j0 + halo] = pdf.v
    return i0, j0, a


def tiled(raster: DataFrame, fn, nlon: int | None, nlat: int | None, tile: int = 512, halo: int = 0, value: str = "value", result: str = "double", missing: float = 0.0) -> DataFrame:
    """Apply ``fn`` to arrays of a tile with its halo; it returns the tile's part.

    Outside the grid the border is repeated, if its size is given.  Only pixels of the table come back,
    without those that are NaN.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i0, j0, a = as_array(pdf, tile, halo, missing)
        if nlon is not None:
            rows = np.clip(np.arange(i0 - halo, i0 + tile + halo), 0, nlon - 1) - i0 + halo
            cols = np.clip(np.arange(j0 - halo, j0 + tile + halo), 0, nlat - 1) - j0 + halo
            a = a[np.ix_(rows.clip(0, len(a) - 1), cols.clip(0, len(a) - 1))]
        out = fn(a)
        own = pdf[pdf.lon_idx.between(i0 + 1, i0 + tile) & pdf.lat_idx.between(j0 + 1, j0 + tile)]
        v = out[own.lon_idx - 1 - i0, own.lat_idx - 1 - j0]
        return pd.DataFrame({"lon_idx": own.lon_idx, "lat_idx": own.lat_idx, value: v})[~np.isnan(v)]

    return by_tile(raster, run, f"lon_idx int, lat_idx int, {value} {result}", tile, halo, value, nlon, nlat)


def disk_mean(raster: DataFrame, radius: float, nlon: int, nlat: int, tile: int = 512, value: str = "value") -> DataFrame:
    """Disk mean for any radius, on tiles."""
    k = disk_kernel(radius)
    return tiled(raster, lambda a: convolved(a, k), nlon, nlat, tile, len(k) // 2, value)


def half_cell_shift(raster: DataFrame, value: str = "value", tile: int = 512) -> DataFrame:
    """Mean of each pixel and its eastern, southern and southeastern neighbours; missing where one is."""
    return tiled(raster, lambda a: (a[1:-1, 1:-1] + a[2:, 1:-1] + a[1:-1, 2:] + a[2:, 2:]) / 4, None, None, tile, 1, value, missing=np.nan)


def least_by_distance(at: np.ndarray, x: np.ndarray, height: np.ndarray, scale: int) -> np.ndarray:
    """For each place of ``at`` the least ``scale * (at - x)² + height``; both are sorted.

    The best x never moves back as ``at`` moves on, so a place has only the ones between its
    neighbours' best to look at: places are taken in halving steps, and every step looks at about
    len(x) + len(at) values.
    """
    n, out = len(at), np.zeros(len(at), np.int64)
    best = np.zeros(n, np.int64)
    step = 1 << max(n - 1, 1).bit_length()
    while step:
        q = np.arange(step - 1, n, 2 * step)
        low = np.where(q - step >= 0, best[np.maximum(q - step, 0)], 0)
        high = np.where(q + step < n, best[np.minimum(q + step, n - 1)], len(x) - 1)
        if len(q):
            size = high - low + 1
            start = np.cumsum(size) - size
            k = np.repeat(low - start, size) + np.arange(size.sum())
            value = scale * (np.repeat(at[q], size) - x[k]) ** 2 + height[k]
            least = np.minimum.reduceat(value, start)
            hit = np.flatnonzero(value == np.repeat(least, size))
            first = hit[np.searchsorted(hit, start)]
            best[q], out[q] = k[first], least
        step //= 2
    return out


def nearest_fill(regions: DataFrame, value: str = "region") -> DataFrame:
    """Every pixel gets the value of the nearest pixel with a value over 0; of equally near ones the least.

    An exact Euclidean transform in two passes: along columns, then along rows.  A group is one column
    or one row of the grid, so its size is bounded by the grid, and costs n log n.  Values are below 2 ** 20.
    """
    far = 1 << 40

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, v = pdf.lat_idx.to_numpy(), pdf[value].to_numpy()
        seeds = np.flatnonzero(v > 0)
        if not len(seeds):
            return pd.DataFrame({"lon_idx": pdf.lon_idx, "lat_idx": lat, "d2": np.full(len(lat), far), value: np.zeros(len(lat), int)})
        order = seeds[np.argsort(lat[seeds])]
        at = np.searchsorted(lat[order], lat)
        above, below = order[np.maximum(at - 1, 0)], order[np.minimum(at, len(order) - 1)]
        da, db = (lat - lat[above]) ** 2, (lat - lat[below]) ** 2
        use = np.where((da < db) | ((da == db) & (v[above] < v[below])), above, below)
        return pd.DataFrame({"lon_idx": pdf.lon_idx, "lat_idx": lat, "d2": (lat - lat[use]) ** 2, value: v[use]})

    def row(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lon_idx")
        lon, d2, v = (pdf[c].to_numpy().astype(np.int64) for c in ("lon_idx", "d2", value))
        some, out = np.flatnonzero(d2 < far), np.zeros(len(lon), np.int64)
        if len(some):  # the value is the last digit, so of equally near ones the least wins
            out = least_by_distance(lon, lon[some], d2[some] * DIGIT + v[some], DIGIT) % DIGIT
        return pd.DataFrame({"lon_idx": lon, "lat_idx": pdf.lat_idx.to_numpy(), value: out})

    first = regions.select(*KEYS, F.col(value).cast("int").alias(value)).groupBy("lon_idx").applyInPandas(column, f"lon_idx int, lat_idx int, d2 long, {value} int")
    return first.groupBy("lat_idx").applyInPandas(row, f"lon_idx int, lat_idx int, {value} int")


def split_shore(territory: Column, land: Column, background: bool = False) -> tuple[Column, Column]:
    """(region, offshore region) of a pixel; a background set keeps the sea in its regions."""
    return (territory if background else F.when(land > 0, territory).otherwise(0)), F.when(land == 0, territory).otherwise(0)


def adjacency(regions: DataFrame, value: str = "region", tile: int = 512) -> DataFrame:
    """(r1, r2) of regions that touch in one of eight directions, both ways, each with itself.  A tile emits each pair once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, a = as_array(pdf, tile, 1, 0)
        a, pairs = a.astype(np.int64), []
        mine = a[1:-1, 1:-1]
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                there = a[1 + i : 1 + i + tile, 1 + j : 1 + j + tile]
                both = (mine > 0) & (there > 0)
                pairs.append(np.unique(mine[both] << 32 | there[both]))
        pairs = np.unique(np.concatenate(pairs))
        return pd.DataFrame({"r1": pairs >> 32, "r2": pairs & 0xFFFFFFFF})

    return by_tile(regions.where(is_region(F.col(value))), run, "r1 int, r2 int", tile, 1, value).distinct()


def block_sum(raster: DataFrame, n: int, nlon: int, nlat: int, value: str = "value") -> DataFrame:
    """Sum over blocks of n by n pixels; incomplete blocks at the end are left out."""
    inside = raster.where((F.col("lon_idx") <= nlon // n * n) & (F.col("lat_idx") <= nlat // n * n))
    return inside.groupBy(*((F.floor((F.col(k) - 1) / n) + 1).cast("int").alias(k) for k in KEYS)).agg(F.sum(value).alias(value))


def mode_by(raster: DataFrame, keys: list[str], value: str, skip: bool = False) -> DataFrame:
    """Most frequent value of each group, the least of a tie; with ``skip``, 0 and NOREGION don't vote
    and a group without a vote is 0."""
    counts = raster.groupBy(*keys, value).agg(F.count("*").alias("n"))
    votes = F.when(F.col(value).isin(0, NOREGION), 0).otherwise(F.col("n")) if skip else F.col("n")
    best = counts.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(votes, -F.col(value))).alias(value), F.max(votes).alias("n"))
    return best.select(*keys, F.when(F.col("n") > 0, F.col(value)).otherwise(0).cast("int").alias(value))


def zonal_sum(raster: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return raster.groupBy(*keys).agg(F.sum(value).alias(value))


def cubic_weights(t: np.ndarray) -> np.ndarray:
    """Weights of the four samples around a place t of the way between the two in the middle: the cubic
    convolution of Keys (1981) with a = -1/2, which gives parabolas back exactly."""
    return np.stack([-0.5 * t + t**2 - 0.5 * t**3, 1 - 2.5 * t**2 + 1.5 * t**3, 0.5 * t + 2 * t**2 - 1.5 * t**3, -0.5 * t**2 + 0.5 * t**3])


def linear_weights(t: np.ndarray) -> np.ndarray:
    return np.stack([np.zeros_like(t), 1 - t, t, np.zeros_like(t)])


def finer(raster: DataFrame, factor: int, nlon: int, nlat: int, weights, value: str = "value", tile: int = 256) -> DataFrame:
    """Interpolate to a grid ``factor`` times as fine: every pixel of the table is cut into pixels of its own.

    ``weights`` gives those of four neighbours in a row, two on each side, for a place between the middle
    ones.  The border is repeated; pixels that aren't in the table count 0.
    """
    place = (np.arange(factor) + 0.5) / factor - 0.5
    base, w = np.floor(place).astype(int), weights(place - np.floor(place))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i0, j0, a = as_array(pdf, tile, 2, 0.0)
        rows = (np.clip(np.arange(i0 - 2, i0 + tile + 2), 0, nlon - 1) - i0 + 2).clip(0, len(a) - 1)
        cols = (np.clip(np.arange(j0 - 2, j0 + tile + 2), 0, nlat - 1) - j0 + 2).clip(0, len(a) - 1)
        a = a[np.ix_(rows, cols)]
        wide = np.zeros((tile * factor, a.shape[1]))
        out = np.zeros((tile * factor, tile * factor))
        for f in range(factor):
            for k in range(4):
                first = 2 + base[f] + k - 1
                wide[f::factor] += w[k, f] * a[first : first + tile]
        for f in range(factor):
            for k in range(4):
                first = 2 + base[f] + k - 1
                out[:, f::factor] += w[k, f] * wide[:, first : first + tile]
        own = pdf[pdf.lon_idx.between(i0 + 1, i0 + tile) & pdf.lat_idx.between(j0 + 1, j0 + tile)]
        u = ((own.lon_idx.to_numpy() - 1)[:, None, None] * factor + np.arange(factor)[None, :, None] + np.zeros((1, 1, factor), int)).ravel()
        v = ((own.lat_idx.to_numpy() - 1)[:, None, None] * factor + np.arange(factor)[None, None, :] + np.zeros((1, factor, 1), int)).ravel()
        return pd.DataFrame({"lon_idx": u + 1, "lat_idx": v + 1, value: out[u - i0 * factor, v - j0 * factor]})

    return by_tile(raster, run, f"lon_idx int, lat_idx int, {value} double", tile, 2, value, nlon, nlat)


def bilinear(raster: DataFrame, factor: int, nlon: int, nlat: int, value: str = "value") -> DataFrame:
    """Bilinear interpolation to a grid ``factor`` times as fine."""
    return finer(raster, factor, nlon, nlat, linear_weights, value)


def bicubic(raster: DataFrame, factor: int, nlon: int, nlat: int, value: str = "value") -> DataFrame:
    """Interpolation by cubic convolution to a grid ``factor`` times as fine."""
    return finer(raster, factor, nlon, nlat, cubic_weights, value)


def downscaled(coarse: DataFrame, factor: int, nlon: int, nlat: int, value: str = "value", tile: int = 256) -> DataFrame:
    """A coarse total, as population, on fine pixels: interpolated by cubic convolution, never negative, and
    scaled so that every coarse pixel keeps its total."""
    fine = bicubic(coarse, factor, nlon, nlat, value).withColumn(value, F.greatest(F.col(value), F.lit(0.0)))
    parent = [(F.floor((F.col(k) - 1) / factor) + 1).cast("int").alias(f"c_{k}") for k in KEYS]
    fine = fine.select("*", *parent)
    total = coarse.select(*(F.col(k).alias(f"c_{k}") for k in KEYS), F.col(value).alias("total"))
    share = F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy("c_lon_idx", "c_lat_idx")))
    return fine.withColumn("share", F.coalesce(share, F.lit(1.0 / factor**2))).join(total, ["c_lon_idx", "c_lat_idx"]).select(*KEYS, (F.col("share") * F.col("total")).alias(value))


def resized(raster: DataFrame, nlon: int, nlat: int, new_lon: int, new_lat: int, value: str = "value") -> DataFrame:
    """A raster of nlon by nlat pixels at another, coarser size: each new pixel is the mean of the old ones that
    it covers, by the share of them that it covers."""

    def shares(i: Column, n: int, m: int) -> Column:
        """New pixels that an old one reaches into, with the share of the new one's width."""
        low, high = (i - 1) * (m / n), i * (m / n)
        return F.transform(F.sequence(F.floor(low), F.least(F.ceil(high - 1e-12) - 1, F.lit(m - 1))), lambda k: F.struct((k + 1).cast("int").alias("k"), (F.least(high, k + 1) - F.greatest(low, k)).alias("w")))

    at = raster.select(value, F.explode(shares(F.col("lon_idx"), nlon, new_lon)).alias("x"), "lat_idx").select(value, "x", F.explode(shares(F.col("lat_idx"), nlat, new_lat)).alias("y"))
    return at.groupBy(F.col("x.k").alias("lon_idx"), F.col("y.k").alias("lat_idx")).agg(F.sum(F.col(value) * F.col("x.w") * F.col("y.w")).alias(value))


def gdp_per_capita(gdp: Column, population: Column) -> Column:
    """In thousand dollars of 2010 at the later price level; 0 without people."""
    return F.when(population > 0, F.try_divide(gdp, population) * (218.056 / 195.3 * 1000)).otherwise(0.0)


def spread_to_fine(coarse: DataFrame, fine: DataFrame, ratio: int, value: str, weight: str, name: str) -> DataFrame:
    """A coarse value on every fine pixel, times the pixel's weight."""
    c = coarse.select(F.col("lon_idx").alias("ci"), F.col("lat_idx").alias("cj"), F.col(value).alias("coarse_value"))
    f = fine.withColumn("ci", (F.floor((F.col("lon_idx") - 1) / ratio) + 1).cast("int")).withColumn("cj", (F.floor((F.col("lat_idx") - 1) / ratio) + 1).cast("int"))
    return f.join(c, ["ci", "cj"]).select(*fine.columns, (F.col("coarse_value") * F.col(weight)).alias(name))


def grid_access(gdp: DataFrame, radius: float, nlon: int, nlat: int, least: float = 100_000, value: str = "gdp") -> DataFrame:
    """Disk mean of pixels with much economic activity; values under 1e-6 are 0."""
    lit = gdp.select(*KEYS, (F.col(value) > least).cast("double").alias("value"))
    mean = disk_mean(lit, radius, nlon, nlat)
    return mean.select(*KEYS, F.when(F.col("value") < 1e-6, 0.0).otherwise(F.col("value")).alias("gridaccess"))


def merged_layers(first: DataFrame, *others: DataFrame, value: str = "protected") -> DataFrame:
    """Highest code of aligned layers; missing pixels are 0."""
    out = first
    for o in others:
        out = out.unionByName(o)
    return out.groupBy(*KEYS).agg(F.max(value).alias(value))


def fill_zeros_from_neighbours(raster: DataFrame, nlon: int, nlat: int, value: str = "value", tile: int = 512) -> DataFrame:
    """Zero pixels take the largest value of their three by three neighbourhood."""

    def fill(a: np.ndarray) -> np.ndarray:
        most = np.max([a[i : i + a.shape[0] - 2, j : j + a.shape[1] - 2] for i in range(3) for j in range(3)], axis=0)
        return np.where(a[1:-1, 1:-1] == 0, most, a[1:-1, 1:-1])

    return tiled(raster, fill, nlon, nlat, tile, 1, value)


def local_spacing(grid: DataFrame) -> DataFrame:
    """Least distance in degrees of each cell of a curvilinear grid (row, col, lon, lat) to its eight neighbours."""
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)])
    ask = grid.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.explode(near).alias("o")).withColumn("row", F.col("r") + F.col("o.a")).withColumn("col", F.col("c") + F.col("o.b"))
    return ask.join(grid, ["row", "col"]).groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.min(F.hypot(F.col("lon") - F.col("x"), F.col("lat") - F.col("y"))).alias("spacing"))


def population_centres(population: DataFrame, n: int, mindist: float, region: str = "region", value: str = "population") -> DataFrame:
    """Up to n most populous cells of each region, each at least ``mindist`` cells off the others.

    Greedy; where fewer than n are left the distance is halved and the search starts again; where cells
    run out the list repeats.  One region's coarse cells are one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, "lon_idx", "lat_idx"], ascending=[False, True, True])
        x, y, p = pdf.lon_idx.to_numpy(float), pdf.lat_idx.to_numpy(float), pdf[value].to_numpy(float)
        apart = mindist
        while True:
            open_, chosen = p > 0, []
            while len(chosen) < n and open_.any():
                k = int(np.argmax(open_))
                chosen.append(k)
                open_ &= (x - x[k]) ** 2 + (y - y[k]) ** 2 > apart**2
            if len(chosen) == n or apart < 0.5 or not chosen:
                break
            apart /= 2
        rows = [chosen[i % len(chosen)] for i in range(n)] if chosen else []
        return pd.DataFrame({region: pdf[region].iloc[rows].to_numpy(), "centre": range(1, len(rows) + 1), "lon_idx": pdf.lon_idx.iloc[rows].to_numpy(), "lat_idx": pdf.lat_idx.iloc[rows].to_numpy()})

    return population.select(region, *KEYS, value).groupBy(region).applyInPandas(run, f"{region} int, centre int, lon_idx int, lat_idx int")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
