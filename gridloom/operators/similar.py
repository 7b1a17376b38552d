"""Nearest values on a line: the cities whose long-term mean is closest to that of a place.

Cities stand on a line in the order of their mean.  From a reference's own mean the search walks up and down, so it only
sees the cities next to it, however many cities and references there are: each city gets its position in the order, a
reference its starting position, and the positions it needs come from a few blocks of ``BLOCK`` neighbours by an
equality join.  Cities around the reference do not count; their number, from a count of places per small box, is added
to the number of positions.  Places at one spot are all counted or none, so only the best ``limit`` of a spot are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.contract import CELL
from gridloom.grid import Grid, cell_of
from gridloom.operators.points import counts_as_delta, series_means, shown, shown_unit
from gridloom.operators.scan import running_count
from gridloom.storage import stable

BLOCK = 64
DIGITS = 9  # means that agree to so many digits are equal


def nearest_on_line(points: DataFrame, asked: DataFrame, limit: int, box: float) -> DataFrame:
    """(r_lat, r_lon, rank, *point): for each distinct (lat, lon, level) of ``asked`` the ``limit`` points of nearest level.

    ``points`` has id, weight, lat, lon, level and more columns, which are carried.  Points closer than ``box`` degrees
    both ways do not count; ties go to the larger weight, then to the smaller id.
    """
    best = Window.partitionBy("lat", "lon", "level").orderBy(F.desc("weight"), "id")
    points = stable(points.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= limit).drop("__n"))
    spots = asked.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("level").alias("r_level")).distinct()
    wide = 1.01 * box  # with room for rounding, a point that does not count is in the same or a neighbouring cell
    cell = lambda lat, lon: [F.floor(F.col(lat) / wide).alias("x"), F.floor(F.col(lon) / wide).alias("y")]
    crowds = points.groupBy(*cell("lat", "lon")).agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = spots.select("*", *cell("r_lat", "r_lon"), F.explode(steps).alias("step")).select(
        "r_lat", "r_lon", "r_level", (F.col("x") + F.col("step.i")).alias("x"), (F.col("y") + F.col("step.j")).alias("y"))
    spots = stable(around.join(crowds, ["x", "y"], "left").groupBy("r_lat", "r_lon", "r_level").agg(
        (F.lit(limit) + F.coalesce(F.sum("n"), F.lit(0))).alias("want")))
    found = _walk(points, spots, 1, box).unionByName(_walk(points, spots, -1, box))
    away = F.round(F.abs(F.col("level") - F.col("r_level")), DIGITS)
    order = Window.partitionBy("r_lat", "r_lon", "r_level").orderBy(away, F.desc("weight"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _walk(points: DataFrame, spots: DataFrame, sign: int, box: float) -> DataFrame:
    """Points from a spot's level on upwards (``sign`` 1), or from below it on downwards (-1), as many as it wants."""
    line = points.withColumns({"__v": sign * F.col("level") + 0.0, "__kind": F.lit(1), "__at": F.struct(*points.columns)}).select(
        "__v", "__kind", "weight", "id", "__at")
    # A mark stands before the points of its own level on the way up, behind them on the way down.
    marks = spots.select((sign * F.col("r_level") + 0.0).alias("__v")).distinct().withColumn("__kind", F.lit(1 - sign))
    order = [F.col("__v"), F.col("__kind"), F.desc("weight"), F.col("id")]
    numbered = running_count(line.unionByName(marks, allowMissingColumns=True), order, F.col("__kind") == 1, "__pos")
    block = lambda pos: F.floor((pos - 1) / BLOCK)
    blocks = numbered.where("__kind = 1").groupBy(block(F.col("__pos")).alias("__block")).agg(
        F.collect_list(F.struct("__pos", "__at")).alias("__points"))
    starts = numbered.where("__kind != 1").select("__v", (F.col("__pos") + 1).alias("__start"))
    asked = spots.withColumn("__v", sign * F.col("r_level") + 0.0).join(starts, "__v").drop("__v")
    last = F.col("__start") + F.col("want") - 1
    asked = asked.withColumn("__block", F.explode(F.sequence(block(F.col("__start")), block(last))))
    met = asked.join(blocks, "__block").select("r_lat", "r_lon", "r_level", "__start", "want", F.inline("__points"))
    near = (F.abs(F.col("__at.lat") - F.col("r_lat")) < box) & (F.abs(F.col("__at.lon") - F.col("r_lon")) < box)
    kept = met.where(F.col("__pos").between(F.col("__start"), last) & ~near)
    return kept.select("r_lat", "r_lon", "r_level", "__at.*")


def similar_locations(places: DataFrame, references: DataFrame, series: DataFrame, grid: Grid,
                      limit: int = 5, min_population: int = 100_000, box: float = 0.13, monthly: bool = False,
                      key: str = "reference", unit: str = "C", target: str = "C",
                      aggregator: str = "mean") -> DataFrame:
    """Cities whose series mean is closest to that of each reference, ranked per reference.

    ``references`` is (key, lat, lon), any number of places; ``series`` are long rows per cell.
    """
    means = series_means(series, monthly).withColumn("level", F.round("mean", DIGITS))
    at = lambda df: df.withColumns(cell_of(F.col("lat"), F.col("lon"), grid)).join(means, CELL)
    cities = at(places.where(F.col("population") >= min_population)).select(
        F.col("geonameid").alias("id"), F.col("population").alias("weight"), "lat", "lon", "level", "mean", "label")
    ref = at(references.select(key, "lat", "lon")).select(key, "lat", "lon", "level", F.col("mean").alias("r_mean"))
    found = nearest_on_line(cities, ref, limit, box).drop("lat", "lon", "r_level")
    delta = counts_as_delta("mean", aggregator)
    rows = ref.withColumnRenamed("level", "r_level").join(found, (F.col("lat") == F.col("r_lat")) & (F.col("lon") == F.col("r_lon")))
    return rows.select(
        key, "rank", F.col("id").alias("geonameid"), "label", shown(F.col("mean"), unit, target, delta).alias("value"),
        shown(F.round(F.abs(F.col("level") - F.col("r_level")), DIGITS), unit, target, True).alias("delta"),
        shown(F.col("r_mean"), unit, target, delta).alias("reference_mean"), shown_unit(unit, target).alias("unit"),
    )
