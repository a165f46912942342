"""Wind power as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capacity factor of a wind park at 0, 1, ... 29 m/s.
PARK_CURVE = (
    0.0, 0.0014, 0.0071, 0.0229, 0.0545, 0.1067, 0.1831, 0.2850, 0.4085, 0.5434, 0.6744, 0.7847, 0.8614, 0.9048, 0.9266,
    0.9353, 0.9373, 0.9375, 0.9375, 0.9375, 0.9375, 0.9375, 0.9375, 0.9311, 0.8683, 0.6416, 0.2948, 0.0688, 0.0063, 0.0,
)


def capacity_factor(speed: Column | np.ndarray) -> Column | np.ndarray:
    """Linear between whole speeds; 0 below 0, from 29 m/s, and for NaN; null for null.  Of a column or of an array."""
    last = len(PARK_CURVE) - 1
    if isinstance(speed, np.ndarray):
        return np.where((speed >= 0) & (speed < last), np.interp(speed, np.arange(last + 1), PARK_CURVE), 0.0)
    curve = F.array(*map(F.lit, PARK_CURVE))
    low = F.floor(speed).cast("int")
    part = speed - low
    value = (1 - part) * F.get(curve, low) + part * F.get(curve, low + 1)
    return F.when(speed.isNull(), None).when((speed >= 0) & (speed < last), value).otherwise(0.0)


def rescaled(speed: Column, atlas: Column, mean_all_years: Column) -> Column:
    """Speed at a pixel: the cell's speed times the ratio of the atlas to the cell's mean; null where the mean is 0."""
    return speed * F.try_divide(atlas, F.nullif(mean_all_years, F.lit(0.0)))


def speed(u: Column, v: Column) -> Column:
    """Speed from its two components; a missing one is 0."""
    return F.hypot(F.coalesce(u, F.lit(0.0)), F.coalesce(v, F.lit(0.0)))


def capacity_gw(density: float, share: float, area_km2: Column) -> Column:
    """Installable capacity of a pixel, from MW per km² and the share of the area that is used."""
    return F.lit(density * share / 1000.0) * area_km2
