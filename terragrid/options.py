"""Parameters of the resource computations: frozen, with defaults; an unknown name is an error."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any, TypeVar

#: Land marked as outside the model's regions.
NOREGION = 32767
#: Land cover codes 0 to 16.
LAND_TYPES = (
    "Water", "Evergreen Needleleaf Forests", "Evergreen Broadleaf Forests", "Deciduous Needleleaf Forests", "Deciduous Broadleaf Forests", "Mixed Forests",
    "Closed Shrublands", "Open Shrublands", "Woody Savannas", "Savannas", "Grasslands", "Permanent Wetlands", "Croplands", "Urban",
    "Cropland/Natural", "Snow/Ice", "Barren",
)
#: Protection codes 1 to 10.
PROTECTION = ("Ia", "Ib", "II", "III", "IV", "V", "VI", "Not Reported", "Not Applicable", "Not Assigned")

O = TypeVar("O")


def with_options(defaults: O, given: Mapping[str, Any]) -> O:
    """Defaults with some of them changed."""
    unknown = set(given) - {f.name for f in fields(defaults)}
    if unknown:
        raise KeyError(f"no such option: {', '.join(sorted(unknown))}")
    return replace(defaults, **given)


# The defaults below are fixed values.


@dataclass(frozen=True)
class SolarOptions:
    gisregion: str = "Europe8"
    filenamesuffix: str = ""
    pv_density: float = 45.0
    csp_density: float = 35.0
    pvroof_area: float = 0.05
    plant_area: float = 0.05
    distance_elec_access: float = 150.0
    plant_persons_per_km2: float = 150.0
    pvroof_persons_per_km2: float = 200.0
    exclude_landtypes: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 8)
    protected_codes: tuple[int, ...] = (1, 2, 3, 4, 5, 8)
    scenarioyear: str = "ssp2_2050"
    era_year: int = 2018
    res: float = 0.01
    erares: float = 0.28125
    pvclasses_min: tuple[float, ...] = (0.08, 0.14, 0.18, 0.22, 0.26)
    pvclasses_max: tuple[float, ...] = (0.14, 0.18, 0.22, 0.26, 1.0)
    cspclasses_min: tuple[float, ...] = (0.10, 0.18, 0.24, 0.28, 0.32)
    cspclasses_max: tuple[float, ...] = (0.18, 0.24, 0.28, 0.32, 1.0)
    downsample_masks: int = 1
    classB_threshold: float = 0.001
    grid_everywhere: bool = False


@dataclass(frozen=True)
class WindOptions:
    gisregion: str = "Europe8"
    filenamesuffix: str = ""
    onshore_density: float = 5.0
    offshore_density: float = 8.0
    area_onshore: float = 0.08
    area_offshore: float = 0.33
    distance_elec_access: float = 150.0
    persons_per_km2: float = 150.0
    max_depth: float = 40.0
    min_shore_distance: float = 5.0
    exclude_landtypes: tuple[int, ...] = (0, 11, 13)
    protected_codes: tuple[int, ...] = (1, 2, 3, 4, 5, 8)
    scenarioyear: str = "ssp2_2050"
    era_year: int = 2018
    rescale_to_wind_atlas: bool = True
    wind_speed_altitude: int = 100
    wind_class_altitude: int = 100
    res: float = 0.01
    erares: float = 0.28125
    onshoreclasses_min: tuple[float, ...] = (2.0, 5.0, 6.0, 7.0, 8.0)
    onshoreclasses_max: tuple[float, ...] = (5.0, 6.0, 7.0, 8.0, 99.0)
    offshoreclasses_min: tuple[float, ...] = (3.0, 6.0, 7.0, 8.0, 9.0)
    offshoreclasses_max: tuple[float, ...] = (6.0, 7.0, 8.0, 9.0, 99.0)
    downsample_masks: int = 1
    classB_threshold: float = 0.001
    grid_everywhere: bool = False
    climate_scenario: str = ""


@dataclass(frozen=True)
class HydroOptions:
    gisregion: str = "Europe8"
    costclasses_min: tuple[float, ...] = (0.0, 50.0, 100.0)
    costclasses_max: tuple[float, ...] = (50.0, 100.0, 9999.0)
    storageclasses_min: tuple[float, ...] = (0.0, 1e-6, 12.0)
    storageclasses_max: tuple[float, ...] = (1e-6, 12.0, 9e9)


@dataclass(frozen=True)
class DemandOptions:
    variables: tuple[str, ...] = ("localhour", "weekend01", "temp_monthly", "ranked_month", "temp_top3", "temp1_mean", "temp1_qlow", "temp1_qhigh", "demandpercapita", "gdppercapita")
    rounds: int = 100
    depth: int = 7
    eta: float = 0.05
    subsample: float = 0.75
    seed: int = 1
