"""Sources and sinks.

Rasters are Parquet tables with a row per pixel (or per coarse cell with a year's series as an array),
partitioned by layer, year or scenario, so that a crop and a choice of year are pushed into the scan.
"""

from __future__ import annotations

import tomllib
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import crop
from ..functions.scalar import decimal_comma

#: Name spaces of workbooks.
SHEETS, OFFICE = "http://schemas.openxmlformats.org/spreadsheetml/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Column types of the registers that come as CSV.
SCHEMAS = {
    "hydro_potential": "lat double, lon double, COE double, Production_GWh double, Lake_surface_m2 double, Lake_volume_m3 double, " + ", ".join(f"Qm{k} double" for k in range(1, 14)) + ", ContID int, BasinID int, SysID int, CapCost double",
    "hydro_existing": "GrandID int, lat double, lon double, Production_kWh double, " + ", ".join(f"m{k} double" for k in range(1, 14)),
    "power_plants": "country string, country_long string, name string, gppd_idnr string, capacity_mw double, latitude double, longitude double, fuel1 string, fuel2 string, fuel3 string, fuel4 string",
    "national_hydro": "Country string, Capacity_MW double, Pumped_MW double, Other_MW double, Generation_GWh double, Generation_BP_GWh double",
    "turbines": "lon double, lat double, capac double, year int, onshore boolean, elec2018 double",
    "national_demand": "country string, demand double",
    "buses": "bus_id int, type string, voltage_kv double, x double, y double",
}


@dataclass(frozen=True)
class Data:
    """Where the tables are."""

    folder: str

    @classmethod
    def from_config(cls, path: str) -> Data:
        """From a TOML file with a key ``datafolder``."""
        return cls(tomllib.loads(Path(path).read_text())["datafolder"])

    def path(self, *names: str) -> str:
        return "/".join([self.folder.rstrip("/"), *names])


def raster(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, res: float = 0.01, **partitions) -> DataFrame:
    """A layer, cropped to (west, south, east, north) and to the given partitions in the scan."""
    df = spark.read.parquet(path)
    for name, value in partitions.items():
        df = df.where(F.col(name) == F.lit(value))
    return crop(df, *box, res) if box else df


def layers(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Layers of one grid side by side."""
    for o in others:
        first = first.join(o, ["lon_idx", "lat_idx"], "left")
    return first


def hourly(spark: SparkSession, path: str, year: int) -> DataFrame:
    """(era_lon, era_lat, hour, value) from a row per cell with the year's series."""
    cells = spark.read.parquet(path).where(F.col("year") == year)
    return cells.select("era_lon", "era_lat", F.posexplode("series").alias("hour", "value"))


def series(long: DataFrame, keys: list[str], order: str = "hour", value: str = "value") -> DataFrame:
    """Long rows as one array per cell, with its mean."""
    packed = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("s"), F.avg(value).alias("mean"))
    return packed.select(*keys, F.transform("s", lambda x: x[value]).alias("series"), "mean")


def register(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SCHEMAS[kind], enforceSchema=False)


def fuel(plants: DataFrame, name: str = "Hydro") -> DataFrame:
    return plants.where(F.col("fuel1") == name).select("country", "capacity_mw", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def national_demand(spark: SparkSession, path: str, countries: DataFrame) -> DataFrame:
    """Demand by country in TWh; aggregates, in capitals, are left out; an unknown name is an error."""
    rows = register(spark, path, "national_demand").where(F.col("country") != F.upper("country")).select("country", (F.col("demand") / 1000).alias("twh"))
    unknown = rows.join(countries, "country", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"no such country: {', '.join(r['country'] for r in unknown)}")
    return rows


def ascii_grid(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """An ESRI ASCII grid: six lines of header, then a line per row of pixels from the north.

    The file is one text split by lines, so its lines are numbered where they are read.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\r?\n")).alias("n", "line")).where("trim(line) <> ''")
    nodata = lines.where("n < 6").where(F.lower("line").startswith("nodata")).select(F.element_at(F.split("line", r"\s+"), 2).cast("double").alias("nodata"))
    cells = lines.where("n >= 6").select((F.col("n") - 5).alias("lat_idx"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("i", "v"))
    return cells.crossJoin(F.broadcast(nodata)).select((F.col("i") + 1).alias("lon_idx"), "lat_idx", F.nullif(F.col("v").cast("double"), F.col("nodata")).alias(name))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(poly_id, properties, ring) of a feature collection, features numbered from 1: a row for each ring of a
    Polygon or MultiPolygon, holes among them; joins and rasters count rings by the even-odd rule."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("k", "f"))
    rings = "array<array<array<double>>>"
    one, many = F.from_json("f.geometry.coordinates", rings), F.flatten(F.from_json("f.geometry.coordinates", f"array<{rings}>"))
    parts = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    held = rows.select((F.col("k") + 1).alias("poly_id"), F.col("f.properties").alias("properties"), F.explode(parts).alias("r"))
    return held.select("poly_id", "properties", F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def union_registers(tables: Iterable[DataFrame]) -> DataFrame:
    """Registers one below the other; a column that one lacks is null there."""
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def write_result(df: DataFrame, path: str, partitions: tuple[str, ...] = ("tech",)) -> None:
    """A result in long form; sizes of files follow the partitions."""
    spread = df.repartition(*partitions) if partitions else df
    spread.write.mode("overwrite").partitionBy(*partitions).option("compression", "zstd").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_if_absent(df: DataFrame, path: str) -> DataFrame:
    """Write a table once; later calls read it."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def export_regions(regions: DataFrame, names: DataFrame, path: str) -> None:
    """A region set for other programs: its raster (region, offshore) in tiles of a thousand rows, and its names."""
    band = (F.floor((F.col("lat_idx") - 1) / 1000)).cast("int").alias("band")
    write_result(regions.select("lon_idx", "lat_idx", "region", "offshore", band), f"{path}/raster", ("band",))
    write_result(names, f"{path}/names", ())


def sheet_xml(rows: list[tuple]) -> str:
    """A worksheet: numbers as numbers, null as an empty cell, all else as text."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{SHEETS}/main"><sheetData>{lines}</sheetData></worksheet>'


def write_workbook(sheets: dict[str, DataFrame], path: str, most: int = 1_000_000) -> None:
    """An XLSX file with a sheet per table, as one sheet per range of years; a sheet holds ``most`` rows at most, which
    is checked.  Its file is one and local: it is for people, not for pipelines."""
    held = {name: (df.columns, df.limit(most + 1).collect()) for name, df in sheets.items()}
    for name, (_, rows) in held.items():
        if len(rows) > most:
            raise ValueError(f"sheet {name} would have more than {most} rows")
    kinds = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(held) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{kinds}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(name[:31])} sheetId="{k}" r:id="r{k}"/>' for k, name in enumerate(held, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{SHEETS}/main" xmlns:r="{OFFICE}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(held) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{kinds}/relationships">{links}</Relationships>')
        for k, (columns, rows) in enumerate(held.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", sheet_xml([tuple(columns), *(tuple(r) for r in rows)]))


def model_lines(cf: DataFrame) -> DataFrame:
    """Fixed-width lines of hourly capacity factors (tech, region_name, class, hour from 0, cf); only
    values above 0 of the first 8760 hours."""
    held = cf.where(~F.isnan("cf") & (F.col("cf") > 0) & (F.col("hour") < 8760))
    return held.select(F.format_string("%-3s . %s%-2d . h%04d %10.6f", "region_name", "tech", "class", (F.col("hour") + 1).cast("int"), F.col("cf").cast("double")).alias("value"))


def wide_by_bus(cf: DataFrame, buses: list[int], digits: int = 6) -> DataFrame:
    """A row per hour and a column per bus, in numeric order; absent ones are 0, negative values too; with decimal commas."""
    clean = F.greatest(F.coalesce(F.nanvl(F.col("cf"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    wide = cf.groupBy("hour").pivot("bus_id", sorted(buses)).agg(F.first(clean)).fillna(0.0)
    return wide.select("hour", *(decimal_comma(F.col(str(b)), digits).alias(str(b)) for b in sorted(buses)))


def write_wide(cf: DataFrame, buses: list[int], path: str) -> None:
    wide_by_bus(cf, buses).orderBy("hour").write.mode("overwrite").csv(path, sep=";", header=True)


def simulations(spark: SparkSession, models: Iterable[tuple[str, str, str]], years: Iterable[int], scenarios: Iterable[str]) -> DataFrame:
    """Catalogue of climate simulations: years to 2005 are historical, later ones belong to a scenario."""
    rows = [(s, o, m, y, r if y > 2005 else "historical", f"{s}/{o}_{m}_{r if y > 2005 else 'historical'}_{y}") for s, o, m in models for y in years for r in scenarios]
    return spark.createDataFrame(rows, "source string, org string, model string, year int, scenario string, path string").distinct()
