"""Bulk ingest and export of tile blobs.

Spark lists and splits the files; only the fixed binary layout of a blob is
decoded in Python, one small tile at a time, into rows of native arrays.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.grid import Grid

# Layout of a tile blob (header of 32 bytes, then cells in row
# order, each with its time steps in order, little-endian).
MAGIC = b"CLMTILE\0"
VERSION = 1
HEADER = "<8sHBBHHH14x"  # magic, version, type, reserved, steps, height, width
TYPES = {1: "<f4", 2: "<u2", 3: "<i2", 4: "<u1", 5: "<i1", 6: "<u4", 7: "<i4"}

_PATH = r"/([^/]+)/([^/]+)/z(\d+)/r(\d+)_c(\d+)\.bin(\.zst)?$"
_ROWS = "metric_id string, grid_id string, tile_r int, tile_c int, i_lat int, i_lon int, values array<double>"


def decode_tiles(files: DataFrame, grid: Grid, fill: float | None = None) -> DataFrame:
    """Series rows of (path, content) files; padding and empty cells are dropped."""
    nlat, nlon = grid.nlat, grid.nlon
    part = lambda i: F.regexp_extract("path", _PATH, i)
    named = files.select(
        part(2).alias("metric_id"), part(1).alias("grid_id"), part(3).cast("int").alias("size"),
        part(4).cast("int").alias("tile_r"), part(5).cast("int").alias("tile_c"), (part(6) != "").alias("packed"), "content",
    )

    # Everything the tasks need is local, so executors do not import this package.
    magic_, version_, layout, types = MAGIC, VERSION, HEADER, dict(TYPES)

    def values_of(blob: bytes, packed: bool) -> np.ndarray:
        """(height, width, steps) with missing as NaN."""
        if packed:
            import zstandard

            blob = zstandard.ZstdDecompressor().decompress(blob)
        magic, version, code, _, steps, height, width = struct.unpack_from(layout, blob)
        if magic != magic_ or version != version_ or code not in types:
            raise ValueError("not a tile of a known version")
        dtype, head = np.dtype(types[code]), struct.calcsize(layout)
        shape = (height, width, max(steps, 1))
        if len(blob) - head != dtype.itemsize * int(np.prod(shape)):
            raise ValueError("tile payload has the wrong size")
        values = np.frombuffer(blob, dtype, offset=head).astype("float64").reshape(shape)
        if fill is not None:
            values[values == fill] = np.nan
        return np.where(np.isfinite(values), values, np.nan)

    def rows(batches):
        import pyarrow as pa

        names = pa.schema([("metric_id", pa.string()), ("grid_id", pa.string()), ("tile_r", pa.int32()), ("tile_c", pa.int32()),
                           ("i_lat", pa.int32()), ("i_lon", pa.int32()), ("values", pa.list_(pa.float64()))])
        for batch in batches:
            for f in batch.to_pylist():
                tile = values_of(f["content"], f["packed"])
                i_lat, i_lon = np.indices(tile.shape[:2], dtype="int32")
                i_lat, i_lon = i_lat + f["tile_r"] * f["size"], i_lon + f["tile_c"] * f["size"]
                keep = np.argwhere((i_lat < nlat) & (i_lon < nlon) & np.isfinite(tile).any(axis=2))
                for at in range(0, len(keep), per_batch):
                    y, x = keep[at : at + per_batch].T
                    flat = tile[y, x].ravel()
                    lists = pa.ListArray.from_arrays(
                        np.arange(len(y) + 1, dtype="int32") * tile.shape[2], pa.array(flat, mask=np.isnan(flat)))
                    same = lambda v, t, n=len(y): pa.repeat(pa.scalar(v, t), n)
                    yield pa.RecordBatch.from_arrays([
                        same(f["metric_id"], pa.string()), same(f["grid_id"], pa.string()), same(f["tile_r"], pa.int32()),
                        same(f["tile_c"], pa.int32()), pa.array(i_lat[y, x], pa.int32()), pa.array(i_lon[y, x], pa.int32()), lists,
                    ], schema=names)

    per_batch = 256  # cells handed over at a time
    return named.mapInArrow(rows, _ROWS)


def ingest(spark: SparkSession, folder: str, grid: Grid, fill: float | None = None) -> DataFrame:
    """Series of every tile file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "r*_c*.bin*"
    ).load(folder)
    return decode_tiles(files.select("path", "content"), grid, fill)


def encode_tiles(series: DataFrame, grid: Grid, packed: bool = True) -> DataFrame:
    """(path, content) of float tiles; a group is one tile, so its size is fixed."""
    size, suffix = grid.tile_size, ".bin.zst" if packed else ".bin"
    layout, magic, version = HEADER, MAGIC, VERSION

    def encode(group):
        import pyarrow as pa
        import pyarrow.compute as pc

        first = group.slice(0, 1).drop_columns(["values"]).to_pylist()[0]
        lists = group.column("values").combine_chunks()
        flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
        cells = flat.reshape(len(lists), -1)
        tile = np.full((size, size, cells.shape[1]), np.nan, dtype="<f4")
        at = [group.column(c).to_numpy() % size for c in ("i_lat", "i_lon")]
        tile[at[0], at[1]] = cells
        blob = struct.pack(layout, magic, version, 1, 0, cells.shape[1], size, size) + tile.tobytes()
        if packed:
            import zstandard

            blob = zstandard.ZstdCompressor(level=10).compress(blob)
        path = f"/{first['grid_id']}/{first['metric_id']}/z{size}/r{first['tile_r']:03d}_c{first['tile_c']:03d}{suffix}"
        return pa.table({"path": [path], "content": pa.array([blob], pa.binary())})

    light = series.withColumn("values", F.col("values").cast("array<float>"))
    return light.groupBy("metric_id", "grid_id", "tile_r", "tile_c").applyInArrow(encode, "path string, content binary")
