"""Raster files: written and read back, other byte orders, kinds, layouts and predictors, and masks."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import kernels
from scarpline.sources import rasters

RINGS = "poly_id int, part int, hole boolean, ring array<struct<x:double,y:double>>"


def tiled_big_endian(z, size, predictor):
    """A file with the most significant byte first, in square tiles, samples of two bands side by side."""
    high, wide, bands = z.shape
    blocks = []
    for r in range(0, high, size):
        for c in range(0, wide, size):
            block = np.zeros((size, size, bands), z.dtype)
            part = z[r : r + size, c : c + size]
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] = block[:, 1:] - block[:, :-1]
            blocks.append(zlib.compress(block.astype(z.dtype.newbyteorder(">")).tobytes()))
    tags = {256: (4, (wide,)), 257: (4, (high,)), 258: (3, (16,) * bands), 259: (3, (8,)), 277: (3, (bands,)), 317: (3, (predictor,)), 322: (3, (size,)), 323: (3, (size,)), 339: (3, (1,) * bands), 324: (4, ()), 325: (4, tuple(map(len, blocks))), 34264: (12, (2.0, 0, 0, 10.0, 0, -2.0, 0, 50.0, 0, 0, 0, 0, 0, 0, 0, 1.0))}
    start = 4096
    tags[324] = (4, tuple(start + sum(map(len, blocks[:i])) for i in range(len(blocks))))
    entries, extra, at = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        kind, values = tags[tag]
        raw = struct.pack(">" + str(len(values)) + {3: "H", 4: "I", 12: "d"}[kind], *values)
        entries += struct.pack(">HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", at + len(extra)))
        extra += raw if len(raw) > 4 else b""
    head = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0" + extra
    return head.ljust(start, b"\0") + b"".join(blocks)


@pytest.mark.parametrize("kind", ["u1", "i2", "f4", "f8"])
def test_files_on_disk(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    z = (rng.random((70, 33)) * 100).astype(kind)
    (tmp_path / "a.tif").write_bytes(rasters.encode(z, (0.5, 10.0, -0.5, 45.0), 4326, no_data=float(z[3, 4]), compress=kind != "u1", strip_rows=7))
    (tmp_path / "notes.txt").write_text("no raster")
    files = rasters.raster_files(spark, str(tmp_path))
    p = rasters.profiles(files).first()
    assert (p.width, p.height, p.bands, np.dtype(p.dtype), p.epsg) == (33, 70, 1, np.dtype(kind), 4326)
    assert (p.x_min, p.y_min, p.x_max, p.y_max) == (10.0, 10.0, 26.5, 45.0)
    got = rasters.read_cells(files).collect()
    assert len(got) == z.size and {(r.row, r.col): r.z for r in got} == {(i, j): None if v == z[3, 4] else float(v) for (i, j), v in np.ndenumerate(z)}
    assert all((r.x, r.y) == (10.25 + r.col / 2, 44.75 - r.row / 2) for r in got)


@pytest.mark.parametrize("predictor", [1, 2])
def test_tiles_bands_and_other_byte_order(spark, predictor):
    z = np.random.default_rng(2).integers(0, 60000, (21, 37, 2)).astype("u2")
    files = spark.createDataFrame([("b.tif", bytearray(tiled_big_endian(z, 16, predictor)))], "path string, content binary")
    got = {(r.band, r.row, r.col): r.z for r in rasters.read_cells(files).collect()}
    assert got == {(k, i, j): float(v) for (i, j, k), v in np.ndenumerate(z)}
    r = rasters.profiles(files).first()
    assert (r.a, r.c, r.e, r.f) == (2.0, 10.0, -2.0, 50.0)


def test_only_needed_blocks_are_decoded(spark):
    z = np.arange(100 * 100, dtype="f8").reshape(100, 100)
    content = bytearray(rasters.encode(z, (1.0, 0.0, -1.0, 100.0), strip_rows=10))
    raster = rasters.Raster(bytes(content))
    for index in (0, 1, 2, 5, 6, 7, 8, 9):  # all strips but those of y 60-70 and 70-60 are broken
        at, size = raster.places[index]
        content[at : at + size] = b"\0" * size
    away = bytearray(rasters.encode(z, (1.0, 500.0, -1.0, 100.0), strip_rows=10))
    files = spark.createDataFrame([("near.tif", content), ("away.tif", away)], "path string, content binary")
    mask = spark.createDataFrame([(1, 0, False, [(20.0, 55.0), (30.0, 55.0), (30.0, 65.0), (20.0, 65.0)])], RINGS)
    plan = {r.path: (r.blocks, r.needed) for r in rasters.block_plan(files, mask).collect()}
    assert plan == {"near.tif": (10, 2), "away.tif": (10, 0)}
    got = rasters.read_cells(files, mask).collect()
    assert {r.row for r in got} == set(range(30, 50)) and all(r.z == z[r.row, r.col] for r in got)
    grid = rasters.import_grid(files, mask, side=2.0, method="average", band=4.0).filter("inside").collect()
    assert len(grid) == 25 and all(20 <= r.x < 30 and 55 <= r.y < 65 for r in grid)


def test_no_transform_or_code(spark):
    z = np.ones((4, 4), "f4")
    plain = rasters.encode(z, (1.0, 0.0, -1.0, 0.0))
    bare = plain.replace(struct.pack("<HHI", 33550, 12, 3), struct.pack("<HHI", 33551, 12, 3))
    files = spark.createDataFrame([("c.tif", bytearray(bare))], "path string, content binary")
    r = rasters.profiles(files, epsg=32632, bounds=(0, 0, 8, 8)).first()
    assert (r.epsg, r.a, r.c, r.e, r.f) == (32632, 2.0, 0.0, -2.0, 8.0)
    with pytest.raises(ValueError):
        rasters.Raster(b"PNG" + bytes(20))


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "spline", "lanczos", "average", "rms"])
def test_constant_grids_stay_constant(spark, method):
    rows = [(0, r, c, None if (r, c) == (2, 2) else 7.0) for r in range(9) for c in range(6)]
    df = spark.createDataFrame(rows, "tile int, row int, col int, z double")
    sizes = spark.createDataFrame([(0, 9, 6, 4, 11)], "tile int, rows int, cols int, new_rows int, new_cols int")
    got = kernels.resample_cells(df, sizes, method).collect()
    assert len(got) == 44 and all(r.z == pytest.approx(7.0) for r in got if r.z is not None) and sum(r.z is None for r in got) <= 2
    same = kernels.resample_cells(df, sizes.withColumns({"new_rows": F.lit(9), "new_cols": F.lit(6)}), "cubic").filter("z IS NOT NULL").count()
    assert same == 53
