"""Scalar functions: finance, hydro power, time, text, classes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import LAND_TYPES, NOREGION

WATER, GRAVITY = 997.0, 9.81
DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def capital_recovery(rate: Column | float, years: Column | float) -> Column:
    """Yearly share of an investment that repays it."""
    r, n = (x if isinstance(x, Column) else F.lit(float(x)) for x in (rate, years))
    return r / (1 - F.pow(1 + r, -n))


@dataclass(frozen=True)
class HydroSite:
    """Expressions of a potential hydro site; ``monthly_flow`` is an array of twelve m³/s."""

    cf: Column
    capacity_mw: Column
    head_m: Column
    production_gwh: Column
    coe: Column
    monthly_gwh: Column
    reservoir_gwh: Column
    discharge_h: Column


def hydro_site(coe: Column, production_gwh: Column, capcost: Column, system: Column, volume_mm3: Column, monthly_flow: Column, max_head: float = 2000.0) -> HydroSite:
    """Capacity, head, monthly energy, storage and discharge time of a site.

    Design flow is the ninth smallest month.  A head above ``max_head`` is cut, and production, cost
    and capacity follow it.  Ratios with a zero denominator are null.
    """
    crf = capital_recovery(0.1, 40.0)
    efficiency = F.when(system == 1, 0.9).when(system == 2, 0.7)
    cf = F.try_divide(capcost * crf / 8760.0, coe)
    design = F.element_at(F.array_sort(monthly_flow), 9)
    full = F.try_divide(F.try_divide(production_gwh * 1e9 / 8760.0, cf), efficiency * design * (WATER * GRAVITY))
    head = F.least(full, F.lit(max_head))
    cut = F.coalesce(F.try_divide(head, full), F.lit(1.0))
    production = production_gwh * cut
    capacity = F.try_divide(production * 1000.0 / 8760.0, cf)
    monthly = F.zip_with(monthly_flow, F.array(*[F.lit(float(d)) for d in DAYS]), lambda q, d: head * d * 24.0 / 1e9 * q * (WATER * GRAVITY))
    reservoir = head * volume_mm3 * (WATER * GRAVITY / 3600.0 / 1000.0)
    return HydroSite(cf, capacity, head, production, F.try_divide(coe, cut), monthly, reservoir, F.try_divide(reservoir * 1000.0, capacity))


def demand_multiplier(growth_a: Column, growth_b: Column, year: int) -> Column:
    """Growth since 2016 from that since 2020, as the mean of two models; 1 in 2020."""
    return F.lit(1.0) if year == 2020 else F.pow((growth_a + growth_b) / 2, F.lit((year - 2016) / (year - 2020)))


def tz_offset_hours(t: Column, zone: Column) -> Column:
    """Offset of a zone at a UTC time without zone."""
    return F.timestamp_diff("SECOND", t, F.convert_timezone(F.lit("UTC"), zone, t)) / 3600.0


def local_time(t: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, t)


def weekend(t: Column) -> Column:
    return (F.weekday(t) >= 5).cast("int")


def classes(x: Column, low: Sequence[float], high: Sequence[float]) -> Column:
    """Class by upper bounds; 0 below the first lower bound, from the last upper bound, and for NaN or null."""
    out = F.when(x.isNull() | F.isnan(x) | (x < low[0]) | (x >= high[-1]), 0)
    for k, bound in enumerate(high, 1):
        out = out.when(x < bound, k)
    return out.otherwise(0).cast("int")


def interval_classes(x: Column, low: Sequence[float], high: Sequence[float]) -> Column:
    """Class by half-open intervals; 0 in a gap; a later interval wins."""
    out = F.when(x.isNull() | F.isnan(x), 0)
    for k in range(len(low), 0, -1):
        out = out.when((x >= low[k - 1]) & (x < high[k - 1]), k)
    return out.otherwise(0).cast("int")


def first_interval(x: Column, low: Sequence[float], high: Sequence[float]) -> Column:
    """First half-open interval that holds x; null if there is none."""
    out = F.when(x.isNull(), None)
    for k in range(len(low)):
        out = out.when((x >= low[k]) & (x < high[k]), k + 1)
    return out.cast("int")


def bin_index(x: Column, breaks: Sequence[float]) -> Column:
    """Left-closed bin of x, 0 upwards; below the first break the first bin, from the last one the last."""
    out = F.when(x.isNull(), None)
    for k, b in enumerate(breaks[1:]):
        out = out.when(x < b, k)
    return out.otherwise(len(breaks) - 1).cast("int")


def density_breaks() -> list[float]:
    """Lower bounds of the bins of population density, and the last upper one: 1, 2 and 5 times powers of ten."""
    return [0.0, *(round(m * 10.0**j, 1) for j in range(-1, 4) for m in (1, 2, 5))][:16] + [100000.0]


def speed_breaks() -> list[float]:
    return [k * 0.25 for k in range(85)]


def is_region(x: Column) -> Column:
    return (x > 0) & (x != NOREGION)


def land_name(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, LAND_TYPES)), code)


def percent_text(x: Column) -> Column:
    """A share in percent with one decimal."""
    return F.concat(F.format_string("%.1f", F.round(100 * x, 1)), F.lit("%"))


def significant(x: Column, digits: int = 4) -> Column:
    """Rounded to a number of significant digits; null and 0 stay."""
    out = F.when(x.isNull() | (x == 0), x)
    power = F.floor(F.log10(F.abs(x)))
    for k in range(-12, 13):
        scale = digits - 1 - k
        out = out.when(power == k, F.round(x, scale))
    return out.otherwise(x)


def decimal_comma(x: Column, digits: int = 6) -> Column:
    return F.translate(F.format_string(f"%.{digits}f", x), ".", ",")


def leap_hours(year: int) -> int:
    return 24 * (366 if (year % 4 == 0 and year % 100 != 0) or year % 400 == 0 else 365)


def celsius_over_land(kelvin: Column, on_land: Column) -> Column:
    """Temperature in Celsius on land, 0 at sea."""
    return F.when(on_land, kelvin - 273.15).otherwise(0.0)


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == math.inf), None).otherwise(x)
