"""Land exclusion as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import is_region
from ..options import NOREGION, SolarOptions, WindOptions


def grid_near(disk_mean_access: Column, threshold: float) -> Column:
    """Is there grid access within the buffer?"""
    return disk_mean_access > max(1e-9, threshold)


def wind_masks(o: WindOptions, region: Column, land: Column, protected: Column, popdens: Column, access: Column, buffered: Column, topo: Column, offshore: Column, near_shore: Column) -> dict[str, Column]:
    """onshore_a, onshore_b and offshore, and what they are made of.

    ``buffered`` is the disk mean of grid access, ``near_shore`` the one of land within the least
    distance to the shore.
    """
    good = (region > 0) & ~land.isin(*o.exclude_landtypes)
    kept = protected.isin(*o.protected_codes)
    grid_a = F.lit(True) if o.grid_everywhere else access > 0
    grid_b = F.lit(True) if o.grid_everywhere else grid_near(buffered, o.classB_threshold)
    sparse = popdens < o.persons_per_km2
    shore = near_shore > 1e-6
    return {
        "goodland": good, "kept": kept, "grid_a": grid_a, "grid_b": grid_b, "sparse": sparse, "shore": shore,
        "onshore_a": grid_a & sparse & good & ~kept,
        "onshore_b": grid_b & ~grid_a & sparse & good & ~kept,
        "offshore": grid_b & ~shore & (topo > -o.max_depth) & is_region(offshore) & ~kept,
    }


def solar_masks(o: SolarOptions, region: Column, land: Column, protected: Column, popdens: Column, access: Column, buffered: Column) -> dict[str, Column]:
    good = (region > 0) & ~land.isin(*o.exclude_landtypes)
    kept = protected.isin(*o.protected_codes)
    grid_a = F.lit(True) if o.grid_everywhere else access > 0
    grid_b = F.lit(True) if o.grid_everywhere else grid_near(buffered, o.classB_threshold)
    plant = (popdens < o.plant_persons_per_km2) & good & ~kept
    return {"goodland": good, "kept": kept, "grid_a": grid_a, "grid_b": grid_b, "roof": grid_a & (popdens > o.pvroof_persons_per_km2) & ~kept, "plant_a": grid_a & plant, "plant_b": grid_b & ~grid_a & plant}


def wind_code(o: WindOptions, m: dict[str, Column], region: Column, popdens: Column) -> Column:
    """Why a pixel is in or out, for maps; the first that holds counts."""
    code = F.when(region == 0, 0).when(region == NOREGION, NOREGION).when(popdens > o.persons_per_km2, 2).when(m["kept"], 3).when(~m["grid_a"] & ~m["grid_b"], 4)
    return code.when(~m["goodland"], 1).when(~m["grid_a"], 8).otherwise(7)


def solar_code(o: SolarOptions, m: dict[str, Column], region: Column, popdens: Column) -> Column:
    code = F.when(region == 0, 0).when(region == NOREGION, NOREGION).when(popdens > o.plant_persons_per_km2, 2).when(m["kept"], 3).when(~m["grid_a"] & ~m["grid_b"], 4)
    return code.when(~m["goodland"], 1).when(~m["grid_a"], 6).otherwise(5)


def offshore_code(o: WindOptions, m: dict[str, Column], topo: Column, offshore: Column) -> Column:
    """The same at sea, where the two ends are the other way round: what is no sea of a region is NOREGION, what is NOREGION is 0."""
    code = F.when(offshore == 0, NOREGION).when(offshore == NOREGION, 0).when(m["shore"], 1).when(m["kept"], 3)
    return code.when(topo <= -o.max_depth, 8).when(~m["grid_b"], 4).otherwise(7)
