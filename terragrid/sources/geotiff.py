"""GeoTIFF rasters as tables and back, by the TIFF 6.0 and GeoTIFF 1.1 formats.

A file is cut into strips or tiles; each is decoded by itself, so that a task holds one strip at a
time, and a file of any size becomes rows.  Written files are one per tile of the grid: a task holds
one tile.  Little- and big-endian files, whole numbers and floats of one sample, uncompressed or
deflated, with or without the horizontal predictor, are read; little-endian, deflated ones are written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..operators.raster import as_array, by_tile

#: Numbers of TIFF tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, GEOKEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
#: Bytes and struct codes of TIFF field types.
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
KINDS = {1: "u", 2: "i", 3: "f"}


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the values of the first directory's tags."""
    order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
    magic, first = struct.unpack_from(f"{order}HI", data, 2)
    if magic != 42:
        raise ValueError("not a TIFF of the classic kind")
    out = {}
    for k in range(struct.unpack_from(f"{order}H", data, first)[0]):
        at = first + 2 + 12 * k
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at)
        if kind not in FIELDS:
            continue
        size, code = FIELDS[kind]
        where = at + 8 if size * n <= 4 else struct.unpack_from(f"{order}I", data, at + 8)[0]
        out[tag] = (bytes(data[where : where + n]).rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack_from(f"{order}{n}{code}", data, where)
    return order, out


def pieces(data: bytes) -> tuple[dict[int, tuple], Iterator[tuple[int, int, np.ndarray]]]:
    """Tags, and (first column, first row, values by row and column) of each strip or tile."""
    order, t = tags(data)
    if t.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("rasters of one sample only")
    width, height = t[WIDTH][0], t[HEIGHT][0]
    kind = np.dtype(f"{order}{KINDS[t.get(FORMAT, (1,))[0]]}{t[BITS][0] // 8}")
    tiled = TILES in t
    across, down = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(t.get(ROWS, (height,))[0], height))
    offsets, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
    columns = -(-width // across)

    def decoded() -> Iterator[tuple[int, int, np.ndarray]]:
        for k, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
            i, j = k % columns * across, k // columns * down
            raw = bytes(data[at : at + size])
            packing = t.get(COMPRESSION, (1,))[0]
            if packing in (8, 32946):
                raw = zlib.decompress(raw)
            elif packing != 1:
                raise ValueError(f"compression {packing} isn't known")
            rows = down if tiled else min(down, height - j)
            a = np.frombuffer(raw, kind, rows * across).reshape(rows, across)
            if t.get(PREDICTOR, (1,))[0] == 2:
                a = np.cumsum(a, axis=1, dtype=kind.newbyteorder("="))
            yield i, j, a[: height - j, : width - i]

    return t, decoded()


def read(spark: SparkSession, path: str, name: str = "value", world: tuple[float, float] = (-180.0, 90.0)) -> DataFrame:
    """``lon_idx, lat_idx, <name>`` of the pixels of all files of a path, numbered in the grid that begins at the
    west and north of ``world``; a file's no-data value is no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                t, parts = pieces(content.as_py())
                dx, dy = t.get(SCALE, (1.0, 1.0))[:2]
                px, py, _, x, y = t.get(TIEPOINT, (0.0, 0.0, 0.0, *world, 0.0))[:5]
                first = round((x - px * dx - world[0]) / dx), round((world[1] - (y + py * dy)) / dy)
                nodata = float(t[NODATA][0]) if NODATA in t else None
                for i, j, a in parts:
                    v = a.astype(np.float64).ravel()
                    lat, lon = np.divmod(np.arange(v.size), a.shape[1])
                    keep = ~np.isnan(v) if nodata is None else ~np.isnan(v) & (v != nodata)
                    yield pa.RecordBatch.from_arrays([pa.array((lon + i + first[0] + 1)[keep].astype(np.int32)), pa.array((lat + j + first[1] + 1)[keep].astype(np.int32)), pa.array(v[keep])], ["lon_idx", "lat_idx", name])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"lon_idx int, lat_idx int, {name} double")


def encoded(a: np.ndarray, west: float, north: float, res: float) -> bytes:
    """A file of an array by row and column, in degrees (EPSG 4326), NaN where there is nothing."""
    body = zlib.compress(np.ascontiguousarray(a, "<f4").tobytes(), 6)
    keys = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)  # geographic, pixels as areas, WGS 84
    fields = [(WIDTH, 4, (a.shape[1],)), (HEIGHT, 4, (a.shape[0],)), (BITS, 3, (32,)), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (STRIPS, 4, (8,)), (SAMPLES, 3, (1,)), (ROWS, 4, (a.shape[0],)), (STRIP_BYTES, 4, (len(body),)), (FORMAT, 3, (3,)), (SCALE, 12, (res, res, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, west, north, 0.0)), (GEOKEYS, 3, keys)]
    start = 8 + len(body) + len(body) % 2
    extra, at, entries = b"", start + 2 + 12 * len(fields) + 4, b""
    for tag, kind, values in fields:
        raw = struct.pack(f"<{len(values)}{FIELDS[kind][1]}", *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), at + len(extra))
            extra += raw
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, start) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + extra


def files(raster: DataFrame, res: float, value: str = "value", tile: int = 4096, world: tuple[float, float] = (-180.0, 90.0)) -> DataFrame:
    """``name, content``: one GeoTIFF per tile of the grid that has pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i0, j0, a = as_array(pdf, tile, 0, np.nan)
        wide, high = int(pdf.lon_idx.max()) - i0, int(pdf.lat_idx.max()) - j0
        content = encoded(a[:wide, :high].T, world[0] + i0 * res, world[1] - j0 * res, res)
        return pd.DataFrame({"name": [f"{i0 // tile:05d}_{j0 // tile:05d}.tif"], "content": [content]})

    return by_tile(raster, run, "name string, content binary", tile, 0, value)


def write(raster: DataFrame, path: str, res: float, value: str = "value", tile: int = 4096) -> int:
    """Write the files below a shared path, each by the task that made it; their number.  A task that runs again
    writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content.as_buffer())
            yield batch.select(["name"])

    return files(raster, res, value, tile).mapInArrow(run, "name string").count()
