"""GeoTIFF rasters as tables: profiles, cells of the blocks that a mask needs, and tiles written from cells.

Files come as rows (path, content), from Spark's binaryFile reader or from any table that holds them, so they can lie wherever Spark reads.
A file's header is read first; of a file outside of the mask nothing else is looked at, and of one that meets it only the blocks
(strips or tiles) that do are decompressed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.operators.polygons import measures

#: Fixed values of the TIFF format: tags, sizes of field types, and sample kinds by (format, bits).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINTS, MATRIX, GEO_KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
PROJECTED_KEY, GEOGRAPHIC_KEY = 3072, 2048
PROFILE = "path string, width int, height int, bands int, dtype string, no_data double, epsg int, a double, c double, e double, f double, x_min double, y_min double, x_max double, y_max double"
CELLS = "path string, band int, row int, col int, x double, y double, z double"
#: Boxes of a mask that are sent to every task; of more, the one around all is.
MASK_BOXES = 4096


class Raster:
    """The header of a GeoTIFF and its blocks, each decoded when it is asked for."""

    def __init__(self, content: bytes):
        self.content = content
        order = {b"II": "<", b"MM": ">"}.get(content[:2])
        if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
            raise ValueError("not a TIFF file of the classic kind")
        self.order, self.tags = order, {}
        at = struct.unpack(order + "I", content[4:8])[0]
        for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
            entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            if kind in FIELD:
                size = struct.calcsize(FIELD[kind]) * count
                raw = entry[8 : 8 + size] if size <= 4 else content[(to := struct.unpack(order + "I", entry[8:])[0]) : to + size]
                self.tags[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(f"{order}{count}{FIELD[kind]}", raw)
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.kind = KINDS[one(SAMPLE_FORMAT, 1), one(BITS, 8)]
        self.compression, self.predictor, self.planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        if self.compression not in (1, 8, 32946) or self.predictor not in (1, 2):
            raise ValueError(f"compression {self.compression} with predictor {self.predictor} is not read")
        self.tiled = TILE_OFFSETS in self.tags
        self.block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if self.tiled else (min(one(STRIP_ROWS, self.height), self.height), self.width)
        self.places = list(zip(self.tags[TILE_OFFSETS if self.tiled else STRIP_OFFSETS], self.tags[TILE_SIZES if self.tiled else STRIP_SIZES]))
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
        self.epsg = codes.get(PROJECTED_KEY) or codes.get(GEOGRAPHIC_KEY)
        text = self.tags.get(NO_DATA)
        self.no_data = float(text) if isinstance(text, str) and text.strip() else None
        self.transform = None
        if PIXEL_SCALE in self.tags and TIE_POINTS in self.tags:
            (sx, sy, _), (i, j, _, x, y, _) = self.tags[PIXEL_SCALE], self.tags[TIE_POINTS][:6]
            self.transform = (sx, x - i * sx, -sy, y + j * sy)
        elif MATRIX in self.tags:
            m = self.tags[MATRIX]
            self.transform = (m[0], m[3], m[5], m[7])

    def placed(self, bounds: Sequence[float] | None) -> Raster:
        """With the transform of a box (x_min, y_min, x_max, y_max) if the file has none."""
        if self.transform is None:
            x0, y0, x1, y1 = bounds or (0.0, 0.0, float(self.width), float(self.height))
            self.transform = ((x1 - x0) / self.width, x0, -(y1 - y0) / self.height, y1)
        return self

    def bounds(self, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> tuple[float, float, float, float]:
        a, c, e, f = self.transform
        (r0, r1), (c0, c1) = rows or (0, self.height), cols or (0, self.width)
        xs, ys = sorted((c + c0 * a, c + c1 * a)), sorted((f + r0 * e, f + r1 * e))
        return xs[0], ys[0], xs[1], ys[1]

    def blocks(self) -> Iterator[tuple[int, tuple[int, int], tuple[int, int], int]]:
        """(index, rows, cols, first band) of each block, cut to the raster."""
        high, wide = self.block
        down, across = -(-self.height // high), -(-self.width // wide)
        for band in range(self.bands if self.planar == 2 else 1):
            for r in range(down):
                for c in range(across):
                    yield (band * down + r) * across + c, (r * high, min(self.height, (r + 1) * high)), (c * wide, min(self.width, (c + 1) * wide)), band

    def read(self, index: int, rows: tuple[int, int], cols: tuple[int, int]) -> np.ndarray:
        """The samples (rows, cols, bands of the block) of one block."""
        at, size = self.places[index]
        raw = self.content[at : at + size]
        if self.compression != 1:
            raw = zlib.decompress(raw)
        bands = 1 if self.planar == 2 else self.bands
        high = self.block[0] if self.tiled else rows[1] - rows[0]
        data = np.frombuffer(raw, self.order + self.kind)[: high * self.block[1] * bands].reshape(high, self.block[1], bands)
        if self.predictor == 2:
            data = np.cumsum(data, axis=1, dtype=data.dtype)
        return data[: rows[1] - rows[0], : cols[1] - cols[0]]


def encode(z: np.ndarray, transform: Sequence[float], epsg: int | None = None, no_data: float | None = None, compress: bool = True, strip_rows: int = 64) -> bytes:
    """A GeoTIFF of one band in strips; transform: (a, c, e, f) with x = c + col * a and y = f + row * e."""
    z = np.ascontiguousarray(z)
    fmt, bits = {"u": 1, "i": 2, "f": 3}[z.dtype.kind], z.dtype.itemsize * 8
    z = z.astype(z.dtype.newbyteorder("<"))
    strips = [z[r : r + strip_rows].tobytes() for r in range(0, len(z), strip_rows)]
    strips = [zlib.compress(s) for s in strips] if compress else strips
    a, c, e, f = transform
    key = () if epsg is None else (GEOGRAPHIC_KEY if epsg < 5000 else PROJECTED_KEY, 0, 1, epsg)
    tags: dict[int, tuple[str, tuple]] = {
        WIDTH: ("I", (z.shape[1],)), HEIGHT: ("I", (z.shape[0],)), BITS: ("H", (bits,)), COMPRESSION: ("H", (8 if compress else 1,)), 262: ("H", (1,)), SAMPLES: ("H", (1,)),
        STRIP_ROWS: ("I", (strip_rows,)), SAMPLE_FORMAT: ("H", (fmt,)), PIXEL_SCALE: ("d", (a, -e, 0.0)), TIE_POINTS: ("d", (0.0, 0.0, 0.0, c, f, 0.0)), GEO_KEYS: ("H", (1, 1, 0, len(key) // 4, *key)),
        STRIP_OFFSETS: ("I", tuple(range(len(strips)))), STRIP_SIZES: ("I", tuple(map(len, strips))),
    }
    if no_data is not None:
        tags[NO_DATA] = ("s", (repr(float(no_data)).encode() + b"\0",))
    kinds = {v: k for k, v in FIELD.items()}

    def packed(offset: int) -> tuple[bytes, int]:
        """The directory and the values behind it, with the strips from an offset on."""
        tags[STRIP_OFFSETS] = ("I", tuple(offset + sum(map(len, strips[:i])) for i in range(len(strips))))
        entries, extra, at = b"", b"", 8 + 2 + 12 * len(tags) + 4
        for tag in sorted(tags):
            kind, values = tags[tag]
            raw = values[0] if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
            count = len(raw) if kind == "s" else len(values)
            if len(raw) > 4:
                entries += struct.pack("<HHII", tag, kinds[kind], count, at + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
            else:
                entries += struct.pack("<HHI", tag, kinds[kind], count) + raw.ljust(4, b"\0")
        return struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra, at + len(extra)

    _, size = packed(0)
    return b"II*\0\x08\0\0\0" + packed(size)[0] + b"".join(strips)


def raster_files(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """SC-6: the raster files under a path as rows (path, content), each under 2 GB as Spark's reader has it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def profiles(files: DataFrame, epsg: int | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """SC-7: one row a file with its size, bands, kind, no-data value, code, transform and box.

    epsg stands in for a code and bounds (x_min, y_min, x_max, y_max) for a transform that a file doesn't state.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                r = Raster(content.as_py()).placed(bounds)
                out.append((path, r.width, r.height, r.bands, np.dtype(r.kind).name, r.no_data, r.epsg or epsg, *r.transform, *r.bounds()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), *[pa.int32()] * 3, pa.string(), pa.float64(), pa.int32(), *[pa.float64()] * 8])], [f.split()[0] for f in PROFILE.split(", ")])

    return files.select("path", "content").mapInArrow(run, PROFILE)


def _mask_boxes(mask: DataFrame | None) -> list[tuple[float, ...]] | None:
    if mask is None:
        return None
    boxes = measures(mask).select("x_min", "y_min", "x_max", "y_max")
    found = boxes.limit(MASK_BOXES + 1).collect()
    if len(found) > MASK_BOXES:
        found = boxes.agg(F.min("x_min"), F.min("y_min"), F.max("x_max"), F.max("y_max")).collect()
    return [tuple(r) for r in found]


def _meets(box: Sequence[float], boxes: list[tuple[float, ...]] | None) -> bool:
    return boxes is None or any(box[0] <= b[2] and b[0] <= box[2] and box[1] <= b[3] and b[1] <= box[3] for b in boxes)


def block_plan(files: DataFrame, mask: DataFrame | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """Per file (path, blocks, needed): its blocks, and those that the boxes of the mask's polygons meet, by the headers alone."""
    boxes = _mask_boxes(mask)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            rasters = [Raster(c.as_py()).placed(bounds) for c in batch.column("content")]
            met = [[_meets(r.bounds(rows, cols), boxes) for _, rows, cols, _ in r.blocks()] for r in rasters]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(map(len, met), pa.int32()), pa.array(map(sum, met), pa.int32())], ["path", "blocks", "needed"])

    return files.select("path", "content").mapInArrow(run, "path string, blocks int, needed int")


def read_cells(files: DataFrame, mask: DataFrame | None = None, no_data: float | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """SC-6: cells (path, band, row, col, x, y, z) of the blocks that the mask's boxes meet; all cells without a mask.

    x and y are centres. z is null where the file's no-data value, or else the given one, stands. A file that the mask doesn't meet gives
    nothing and none of its blocks is decompressed. Blocks are sent on one by one, so a task holds one file and one block.
    """
    boxes = _mask_boxes(mask)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raster = Raster(content.as_py()).placed(bounds)
                if not _meets(raster.bounds(), boxes):
                    continue
                a, c, e, f = raster.transform
                none = raster.no_data if raster.no_data is not None else no_data
                for index, rows, cols, first in raster.blocks():
                    if not _meets(raster.bounds(rows, cols), boxes):
                        continue
                    data = raster.read(index, rows, cols)
                    r, k = np.mgrid[rows[0] : rows[1], cols[0] : cols[1]]
                    for band in range(data.shape[2]):
                        z = data[:, :, band].astype(float).ravel()
                        gone = np.isnan(z) if none is None else np.isnan(z) | (z == none)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(z)), pa.array(np.full(len(z), first + band, np.int32)), pa.array(r.ravel().astype(np.int32)), pa.array(k.ravel().astype(np.int32)), pa.array(c + (k.ravel() + 0.5) * a), pa.array(f + (r.ravel() + 0.5) * e), pa.array(z, mask=gone)], ["path", "band", "row", "col", "x", "y", "z"])

    return files.select("path", "content").mapInArrow(run, CELLS)


def write_tiles(cells: DataFrame, transform: Sequence[float], rows: int = 256, cols: int = 256, epsg: int | None = None, no_data: float = -9999.0, strip_rows: int = 64) -> DataFrame:
    """GeoTIFF files (path, content) of cells (tile, row, col, z): one for every block of rows by cols cells, named by tile and first cell.

    transform places cell (0, 0) of every tile. Null cells and those that are missing within a block have the no-data value.
    A task holds one block.
    """
    a, c, e, f = transform

    def run(key, pdf):
        tile, r, k = key
        high, wide = int(pdf["row"].max()) - r * rows + 1, int(pdf["col"].max()) - k * cols + 1
        z = np.full((high, wide), no_data)
        z[pdf["row"] - r * rows, pdf["col"] - k * cols] = pdf["z"].fillna(no_data)
        return pd.DataFrame({"path": [f"{tile}_{r * rows}_{k * cols}.tif"], "content": [encode(z, (a, c + k * cols * a, e, f + r * rows * e), epsg, no_data, strip_rows=strip_rows)]})

    own = cells.select("tile", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("z").cast("double").alias("z"))
    at = [F.floor(F.col("row") / rows).cast("int").alias("_r"), F.floor(F.col("col") / cols).cast("int").alias("_c")]
    return own.select("*", *at).groupBy("tile", "_r", "_c").applyInPandas(run, "path string, content binary")


def import_grid(files: DataFrame, mask: DataFrame, side: float | None = None, method: str = "bilinear", epsg: int | None = None, band: float = 1.0) -> DataFrame:
    """RA-13: cells (tile, row, col, x, y, z, inside) of the first band of all files that meet a mask, each file a tile, resampled to a cell side if one is given.

    inside tells whether a cell's centre lies in a polygon of the mask. Where epsg is given, x and y become longitude and latitude.
    """
    from scarpline.functions.projections import convert_cells
    from scarpline.operators.grid import cells_in_polygons
    from scarpline.operators.kernels import resample_to
    from scarpline.operators.polygons import edges

    own = read_cells(files, mask).filter("band = 0").select(F.col("path").alias("tile"), "row", "col", "x", "y", "z")
    if side is not None:
        own = resample_to(own, side, method)
    hit = cells_in_polygons(own, edges(mask), band).select("tile", "row", "col").distinct().withColumn("inside", F.lit(True))
    out = own.join(hit, ["tile", "row", "col"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return out if epsg is None else convert_cells(out, F.lit(epsg), F.lit(4326))
