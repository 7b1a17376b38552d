"""Coverage, staleness and presence checks over stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.contract import CELL
from gridloom.grid import Grid


def coverage(series: DataFrame, grid: Grid, domain: DataFrame | None = None) -> DataFrame:
    """Per metric: tiles and present cells against what the grid should hold.

    Percentages divide by expected, not found, counts.
    """
    tiles = grid.tile_counts[0] * grid.tile_counts[1]
    present = F.exists("values", lambda v: v.isNotNull())
    cells = series.select("metric_id", "tile_r", "tile_c", *CELL, present.alias("present"))
    if domain is not None:
        cells = cells.join(domain.select(*CELL).distinct().withColumn("__d", F.lit(True)), CELL, "left")
        size = domain.select(*CELL).distinct().agg(F.count(F.lit(1)).alias("domain_cells"))
    else:
        cells = cells.withColumn("__d", F.lit(True))
        size = series.sparkSession.range(1).select(F.lit(grid.nlat * grid.nlon).cast("long").alias("domain_cells"))
    # Tiles first: distinct tiles of a metric number a few thousand at most.
    per_tile = cells.groupBy("metric_id", "tile_r", "tile_c").agg(
        F.count_if("present").alias("n"), F.count_if(F.col("present") & F.coalesce("__d", F.lit(False))).alias("d")
    )
    share = lambda a, b: F.when(b > 0, 100.0 * a / b).otherwise(0.0)
    return per_tile.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("tiles_found"), F.sum("n").alias("present_cells"), F.sum("d").alias("domain_present")
    ).join(F.broadcast(size)).select(
        "metric_id", "tiles_found", F.lit(tiles).cast("long").alias("tiles_expected"), "present_cells",
        share(F.col("present_cells"), F.lit(tiles * grid.tile_size**2)).alias("container_pct"),
        share(F.col("present_cells"), F.lit(grid.nlat * grid.nlon)).alias("real_pct"),
        share(F.col("domain_present"), F.col("domain_cells")).alias("domain_pct"),
    )


def aggregate_problems(declared: DataFrame, region_series: DataFrame, axis: DataFrame) -> DataFrame:
    """Problems of stored regional aggregates.

    ``declared`` (metric_id, aggregation) should exist; every region must have
    one value per step of its aggregate, and the aggregate must hold every
    step of the metric's axis.
    """
    key = ["metric_id", "aggregation"]
    steps = region_series.select(*key, "axis_label").distinct()
    have = steps.groupBy(*key).agg(F.count(F.lit(1)).alias("steps"))
    row = lambda df, problem: df.select(*key, F.lit(problem).alias("problem"), F.col("subject"), F.col("n"))
    missing = declared.join(have, key, "left_anti").select(*key, F.lit("").alias("subject"), F.lit(0).cast("long").alias("n"))
    lengths = region_series.groupBy(*key, "region_key").agg(F.count(F.lit(1)).alias("n")).join(have, key)
    short = lengths.where(F.col("n") != F.col("steps")).select(*key, F.col("region_key").alias("subject"), "n")
    wanted = declared.join(have.select(*key), key, "left_semi").join(axis.select("metric_id", F.col("label").alias("axis_label")), "metric_id")
    stale = wanted.join(steps, [*key, "axis_label"], "left_anti").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("axis_label").alias("subject")
    )
    extra = steps.join(declared, key, "left_semi").join(
        axis.select("metric_id", F.col("label").alias("axis_label")), ["metric_id", "axis_label"], "left_anti"
    ).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("axis_label").alias("subject"))
    return (
        row(missing, "missing").unionByName(row(short, "length")).unionByName(row(stale, "stale"))
        .unionByName(row(extra, "axis mismatch"))
    )


def absent_rankings(declared: DataFrame, rankings: DataFrame) -> DataFrame:
    """Declared (metric_id, aggregation) pairs without a stored ranking."""
    have = rankings.select("metric_id", "aggregation").distinct()
    return declared.join(have, ["metric_id", "aggregation"], "left_anti")


def missing_tiles(series: DataFrame, metric_id: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Tiles of a range that hold no stored series."""
    spark = series.sparkSession
    want = spark.range(rows[0], rows[1] + 1).select(
        F.col("id").cast("int").alias("tile_r"), F.explode(F.sequence(F.lit(cols[0]), F.lit(cols[1]))).alias("tile_c")
    )
    have = series.where(F.col("metric_id") == metric_id).select("tile_r", "tile_c").distinct()
    return want.join(have, ["tile_r", "tile_c"], "left_anti")


def orphans(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored (kind, artifact_id, version) that no kept release points at."""
    key = ["kind", "artifact_id", "version"]
    return stored.select(*key).join(referenced.select(*key).distinct(), key, "left_anti")


def fingerprints(series: DataFrame) -> DataFrame:
    """Content hash per metric from cell, then tile hashes.

    Each level orders a bounded list: the cells of a tile, the tiles of a metric.
    """
    text = F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("~"))), ",")
    cells = series.select(
        "metric_id", "tile_r", "tile_c",
        F.struct("i_lat", "i_lon", F.sha2(text, 256).alias("h")).alias("c"),
    )
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["h"]), ",")
    tiles = cells.groupBy("metric_id", "tile_r", "tile_c").agg(F.sha2(joined("c"), 256).alias("h"))
    return tiles.select("metric_id", F.struct("tile_r", "tile_c", "h").alias("c")).groupBy("metric_id").agg(
        F.sha2(joined("c"), 256).alias("sha256")
    )


LANES = 4  # of 15 hexadecimal digits each
_LANE = 1 << 60


def tile_prints(series: DataFrame) -> DataFrame:
    """(metric_id, tile_r, tile_c, n, lanes): number of cells and additive hash of each tile.

    A cell's hash, of its position and values, is cut into lanes of 60 bits, and the lanes of the cells are added up
    modulo 2**60.  Sums do not depend on the order, combine by partial aggregation, and can be taken apart again: the
    print of a metric is the sum of its tiles', so a rewritten tile is subtracted and added without a scan.
    """
    text = F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("~"))), ",")
    h = F.sha2(F.concat_ws(":", "i_lat", "i_lon", text), 256)
    lanes = [F.conv(F.substring(h, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)").alias(f"lane{k}") for k in range(LANES)]
    return _added(series.select("metric_id", "tile_r", "tile_c", F.lit(1).cast("long").alias("n"), *lanes), ["metric_id", "tile_r", "tile_c"])


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    lane = lambda k: F.pmod(F.sum(f"lane{k}"), F.lit(_LANE).cast("decimal(20,0)")).cast("decimal(20,0)").alias(f"lane{k}")
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *[lane(k) for k in range(LANES)])


def metric_prints(tiles: DataFrame) -> DataFrame:
    """(metric_id, n, lanes) of :func:`tile_prints`: sums over the tiles, no series is read."""
    return _added(tiles.drop("tile_r", "tile_c"), ["metric_id"])


def rewritten(metrics: DataFrame, old_tiles: DataFrame, new_tiles: DataFrame) -> DataFrame:
    """``metrics`` after the old prints of some tiles gave way to new ones."""
    minus = old_tiles.drop("tile_r", "tile_c").withColumns({"n": -F.col("n"), **{f"lane{k}": -F.col(f"lane{k}") for k in range(LANES)}})
    return _added(metrics.unionByName(minus).unionByName(new_tiles.drop("tile_r", "tile_c")), ["metric_id"]).where("n > 0")


def changed_tiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric_id, tile_r, tile_c, state): new, changed and removed tiles, looked for only in metrics that differ."""
    lanes = ["n", *[f"lane{k}" for k in range(LANES)]]
    name = lambda df, p: df.withColumnsRenamed({c: f"{p}_{c}" for c in lanes})
    differ = ~F.struct(*[f"a_{c}" for c in lanes]).eqNullSafe(F.struct(*[f"b_{c}" for c in lanes]))
    metrics = name(metric_prints(old), "a").join(name(metric_prints(new), "b"), "metric_id", "full_outer").where(differ).select("metric_id")
    key = ["metric_id", "tile_r", "tile_c"]
    tiles = name(old.join(metrics, "metric_id", "left_semi"), "a").join(name(new.join(metrics, "metric_id", "left_semi"), "b"), key, "full_outer")
    state = F.when(F.col("a_n").isNull(), "new").when(F.col("b_n").isNull(), "removed").otherwise("changed")
    return tiles.where(differ).select(*key, state.alias("state"))


def fingerprint_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, changed, same or removed per metric."""
    a = old.select("metric_id", F.col("sha256").alias("was"))
    b = new.select("metric_id", F.col("sha256").alias("is"))
    state = (
        F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed")
        .when(F.col("was") == F.col("is"), "same").otherwise("changed")
    )
    return a.join(b, "metric_id", "full_outer").select("metric_id", state.alias("state"))
