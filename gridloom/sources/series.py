"""Packed series: one array row per cell, aligned with an axis table.

Daily series of a global grid run to tens of billions of long rows, so the
table at rest keeps one array per cell, partitioned by metric and tile row and
sorted inside; readers prune partitions first and explode what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.contract import CELL
from gridloom.grid import Grid, tile_of


def build_axis(metric_id: str, dates: DataFrame, label: str = "day") -> DataFrame:
    """Axis table from distinct dates ``t``; an axis has at most some 20k steps."""
    from pyspark.sql import Window

    fmt = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[label]
    return dates.select("t").distinct().select(
        F.lit(metric_id).alias("metric_id"),
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t")) - 1).cast("int").alias("pos"),
        F.date_format("t", fmt).alias("label"),
        F.year("t").alias("year"), F.month("t").alias("month"), F.dayofmonth("t").alias("day"), "t",
    )


def pack_series(long: DataFrame, axis: DataFrame, metric_id: str, grid: Grid) -> DataFrame:
    """Array per cell in axis order, missing where a step has no row.

    Only present values travel; a cell contributes at most one per axis step.  The absent steps are added as empty
    entries, and one sort of the entries puts them in order.
    """
    size = axis.agg(F.count(F.lit(1)).cast("int").alias("__n"))
    present = long.where(F.col("value").isNotNull()).join(axis.select("t", "pos"), "t")
    packed = present.groupBy(*CELL).agg(
        F.collect_list(F.struct("pos", "value")).alias("present")
    ).join(F.broadcast(size))
    steps = F.sequence(F.lit(0), F.col("__n") - 1)
    gaps = F.array_except(steps, F.transform("present", lambda e: e["pos"]))
    empty = F.transform(gaps, lambda p: F.struct(p.alias("pos"), F.lit(None).cast("double").alias("value")))
    values = F.transform(F.array_sort(F.concat("present", empty)), lambda e: e["value"])
    tiles = tile_of(grid)
    return packed.select(
        F.lit(metric_id).alias("metric_id"), F.lit(grid.grid_id).alias("grid_id"),
        tiles["tile_r"].alias("tile_r"), tiles["tile_c"].alias("tile_c"), *CELL, values.alias("values"),
    )


def unpack_series(series: DataFrame, axis: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Long rows (keys, axis columns, value); the axis table is small by contract."""
    keep = keep or ["metric_id", *CELL]
    rows = series.select(*keep, F.posexplode("values").alias("pos", "value"))
    on = ["metric_id", "pos"] if "metric_id" in keep else ["pos"]
    return rows.join(axis.drop(*([] if "metric_id" in keep else ["metric_id"])), on)


def scan_series(spark: SparkSession, path: str, metric_id: str, tile_rows: list[int] | None = None) -> DataFrame:
    """Series of one metric, in double; metric and tile row prune whole directories."""
    df = spark.read.parquet(path).where(F.col("metric_id") == metric_id)
    df = df.withColumn("values", F.col("values").cast("array<double>"))
    return df.where(F.col("tile_r").isin(*tile_rows)) if tile_rows is not None else df


def write_series(series: DataFrame, path: str, resume: bool = False) -> None:
    """Write series by (metric, tile), in single precision; ``resume`` adds only absent cells.

    A write replaces the tiles it holds and leaves the other tiles of their rows alone.
    """
    spark = series.sparkSession
    series = series.withColumn("values", F.col("values").cast("array<float>"))
    if resume and _exists(spark, path):
        done = spark.read.parquet(path).select("metric_id", "tile_r", "tile_c", *CELL)
        series = series.join(done, ["metric_id", "tile_r", "tile_c", *CELL], "left_anti")
        mode = "append"
    else:
        mode = "overwrite"
    (
        series.repartition("metric_id", "tile_r", "tile_c")
        .sortWithinPartitions("metric_id", "tile_r", "tile_c", *CELL)
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("metric_id", "tile_r", "tile_c").option("compression", "zstd").parquet(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def axis_mismatches(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Positions whose label differs between two axes; empty means appendable."""
    a = stored.select("pos", F.col("label").alias("stored"))
    b = new.select("pos", F.col("label").alias("new"))
    return a.join(b, "pos", "full_outer").where(~F.col("stored").eqNullSafe(F.col("new")))


def missing_cells(mask: DataFrame, grid: Grid, axis_size: int, tile_rows: tuple[int, int]) -> DataFrame:
    """All-missing series for the cells of a tile-row range outside the mask."""
    spark = mask.sparkSession
    n = grid.tile_size
    lo, hi = tile_rows[0] * n, min((tile_rows[1] + 1) * n, grid.nlat) - 1
    cells = spark.range(lo, hi + 1).select(
        F.col("id").cast("int").alias("i_lat"),
        F.explode(F.sequence(F.lit(0), F.lit(grid.nlon - 1))).alias("i_lon"),
    )
    empty = F.array_repeat(F.lit(None).cast("double"), axis_size)
    return cells.join(mask.select(*CELL), CELL, "left_anti").withColumn("values", empty)
