"""Area-weighted regional aggregates and city rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.contract import CELL
from gridloom.functions.text import slug
from gridloom.functions.units import display_round
from gridloom.grid import Grid, area_weight, cell_of, center_lat, center_lon, in_bbox
from gridloom.operators.masks import integer_ratio
from gridloom.operators.percell import slope
from gridloom.operators.scan import global_row_number


def fractional_weights(mask: DataFrame, fine: Grid, coarse: Grid) -> DataFrame:
    """Share of each coarse cell covered by each mask id."""
    f = integer_ratio(fine, coarse)
    return mask.where(F.col("id") > 0).groupBy(
        F.floor(F.col("i_lat") / f).cast("int").alias("i_lat"),
        F.floor(F.col("i_lon") / f).cast("int").alias("i_lon"),
        "id",
    ).agg((F.count(F.lit(1)) / F.lit(float(f * f))).alias("frac"))


def country_key(code: Column) -> Column:
    return F.concat(F.lit("country:"), code)


def continent_key(name: Column) -> Column:
    return F.concat(F.lit("continent:"), F.replace(name, F.lit(" "), F.lit("_")))


def ocean_key(name: Column) -> Column:
    return F.concat(F.lit("ocean:"), slug(name))


def region_weights(country_frac: DataFrame | None, countries: DataFrame | None,
                   continent_country: DataFrame | None, ocean_frac: DataFrame | None,
                   oceans: DataFrame | None) -> DataFrame:
    """(region_key, type, name, cell, frac) for countries, continents and oceans.

    A continent's share is the sum of its countries', at most 1.  Ids without
    a country code are dropped; oceans without a name get a numbered one.
    """
    parts = []
    if country_frac is not None:
        c = country_frac.join(countries.where(F.col("code").isNotNull()), "id")
        parts.append(c.select(
            country_key(F.col("code")).alias("region_key"), F.lit("country").alias("region_type"),
            F.coalesce("name", "code").alias("region_name"), *CELL, "frac",
        ))
        k = c.join(continent_country, c["code"] == continent_country["country_code"])
        parts.append(
            k.groupBy("continent", *CELL).agg(F.least(F.sum("frac"), F.lit(1.0)).alias("frac")).select(
                continent_key(F.col("continent")).alias("region_key"), F.lit("continent").alias("region_type"),
                F.initcap(F.col("continent")).alias("region_name"), *CELL, "frac",
            )
        )
    if ocean_frac is not None:
        o = ocean_frac.join(oceans, "id", "left").withColumn(
            "name", F.coalesce("name", F.concat(F.lit("ocean_"), F.col("id").cast("string")))
        )
        parts.append(o.select(
            ocean_key(F.col("name")).alias("region_key"), F.lit("ocean").alias("region_type"),
            F.col("name").alias("region_name"), *CELL, "frac",
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def region_cell_counts(weights: DataFrame, grid: Grid) -> DataFrame:
    """Cells with a positive share per region, and the whole grid for the globe."""
    counts = weights.where(F.col("frac") > 0).groupBy("region_key").agg(F.count(F.lit(1)).alias("cell_count"))
    globe = weights.agg(F.lit("globe").alias("region_key"), F.lit(grid.nlat * grid.nlon).cast("long").alias("cell_count"))
    return counts.unionByName(globe)


def aggregate_columns(weight: Column, digits: int) -> list[Column]:
    """Weighted mean over present values, and plain minimum and maximum."""
    v = F.col("value")
    total = F.sum(F.when(v.isNotNull(), weight))
    mean = F.when(total > 0, F.sum(v * weight) / total)
    return [
        display_round(mean, digits).alias("mean"),
        F.round(F.min(v), digits).alias("min"),
        F.round(F.max(v), digits).alias("max"),
    ]


def globe_aggregates(cells: DataFrame, grid: Grid, step: str = "year", digits: int = 4) -> DataFrame:
    """Weighted mean, min and max over all cells; partial sums need no join."""
    return cells.groupBy(step).agg(*aggregate_columns(area_weight(F.col("i_lat"), grid), digits)).select(
        F.lit("globe").alias("region_key"), step, "mean", "min", "max"
    )


def region_aggregates(cells: DataFrame, weights: DataFrame, grid: Grid, step: str = "year",
                      digits: int = 4) -> DataFrame:
    """Per region and step: cos-weighted mean, unweighted min and max, all in one pass.

    Weights hold a row per (region, cell), so the join is on the cell; Spark
    broadcasts them only when they measure small.  Regions with many cells
    shrink to partial sums before the shuffle on (region, step).
    """
    w = weights.where(F.col("frac") > 0).select("region_key", *CELL, "frac")
    joined = cells.select(*CELL, step, "value").join(w, CELL)
    weight = area_weight(F.col("i_lat"), grid) * F.col("frac")
    regional = joined.groupBy("region_key", step).agg(*aggregate_columns(weight, digits))
    return regional.unionByName(globe_aggregates(cells, grid, step, digits))


def globe_mean_masked(cells: DataFrame, grid: Grid, step: str = "year") -> DataFrame:
    """Globe mean over the cells that have data, with how many those are."""
    cell_count = cells.groupBy(*CELL).agg(F.count("value").alias("n")).where("n > 0").agg(
        F.count(F.lit(1)).alias("cell_count")
    )
    return globe_aggregates(cells, grid, step).select("region_key", step, "mean").join(F.broadcast(cell_count))


def bbox_mean(cells: DataFrame, grid: Grid, west, south, east, north) -> DataFrame:
    """Cos-weighted mean inside a box and the place of its maximum."""
    lat, lon = center_lat(F.col("i_lat"), grid), center_lon(F.col("i_lon"), grid)
    inside = cells.where(in_bbox(lat, lon, west, south, east, north) & F.col("value").isNotNull())
    w = area_weight(F.col("i_lat"), grid)
    return inside.agg(
        (F.sum(F.col("value") * w) / F.sum(w)).alias("mean"),
        F.max("value").alias("peak"),
        F.max_by(F.struct(lat.alias("lat"), lon.alias("lon")),
                 F.struct("value", -F.col("i_lat"), -F.col("i_lon"))).alias("at"),
    ).select("mean", "peak", F.col("at.lat").alias("peak_lat"), F.col("at.lon").alias("peak_lon"))


def fraction_days(obs: DataFrame, thresholds_pct: list[float], years: tuple[int, int],
                  moderate: float = 4.0, severe: float = 8.0) -> DataFrame:
    """Days per year by the share of cells under stress, for all thresholds in one pass.

    A day is severe when the share of severe cells reaches the threshold,
    else moderate when the share of at least moderate cells does.  Years
    without any day report missing counts.
    """
    v = F.col("value")
    daily = obs.groupBy("t").agg(
        F.count("value").alias("valid"), F.count_if(v >= severe).alias("sev"), F.count_if(v >= moderate).alias("mod")
    )
    limits = F.explode(F.array(*[F.lit(float(p)) for p in thresholds_pct])).alias("threshold")
    per = daily.select("t", "valid", "sev", "mod", limits)
    share = F.col("threshold") / 100
    has = F.col("valid") > 0
    is_sev = has & (F.try_divide("sev", "valid") >= share)
    is_mod = has & ~is_sev & (F.try_divide("mod", "valid") >= share)
    counted = per.groupBy(F.year("t").alias("year"), "threshold").agg(
        F.count_if(has & ~is_sev & ~is_mod).alias("no_risk_days"),
        F.count_if(is_mod).alias("moderate_days"),
        F.count_if(is_sev).alias("severe_days"),
    )
    spine = obs.sparkSession.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year")).select("year", limits)
    return spine.join(counted, ["year", "threshold"], "left")


def global_max_days(obs: DataFrame, moderate: float = 4.0, severe: float = 8.0) -> DataFrame:
    """Days per year classified by the daily maximum over all cells."""
    m = F.col("m")
    daily = obs.groupBy("t").agg(F.max("value").alias("m")).where(m.isNotNull())
    return daily.groupBy(F.year("t").alias("year")).agg(
        F.count_if(m < moderate).alias("no_risk_days"),
        F.count_if((m >= moderate) & (m < severe)).alias("moderate_days"),
        F.count_if(m >= severe).alias("severe_days"),
    )


#: Scores of a yearly series.
SCORES = {
    "mean": lambda: F.avg("value"),
    "max": lambda: F.max("value"),
    "min": lambda: F.min("value"),
    "trend_slope": lambda: slope() * 10,
}


def candidate_cities(places: DataFrame, min_population: int = 1000) -> DataFrame:
    """The most populous city of each rounded quarter-degree key.

    The key rounds coordinates, so it is not the grid cell; the first city
    holds it even if it turns out to have no data.
    """
    key = [F.rint(F.col("lat") * 4).cast("int").alias("k_lat"), F.rint(F.col("lon") * 4).cast("int").alias("k_lon")]
    cols = [F.col(c) for c in places.columns]
    best = F.max_by(F.struct(*cols), F.struct("population", -F.col("geonameid")))
    return places.where(F.col("population") >= min_population).groupBy(*key).agg(best.alias("p")).select("p.*")


def city_scores(places: DataFrame, annual: DataFrame, grid: Grid, aggregation: str,
                min_population: int = 1000) -> DataFrame:
    """Score of the series under each candidate city."""
    if aggregation not in SCORES:
        raise ValueError(f"unknown aggregation: {aggregation}")
    cities = candidate_cities(places, min_population).withColumns(cell_of(F.col("lat"), F.col("lon"), grid))
    scores = annual.groupBy(*CELL).agg(F.round(SCORES[aggregation](), 9).alias("score")).where(F.col("score").isNotNull())
    return cities.join(scores, CELL)


def city_rankings(places: DataFrame, annual: DataFrame, grid: Grid, aggregation: str,
                  min_population: int = 1000) -> DataFrame:
    """Cities ranked by score; equal scores keep population order."""
    scored = city_scores(places, annual, grid, aggregation, min_population)
    order = [F.desc("score"), F.desc("population"), F.asc("geonameid")]
    return global_row_number(scored, [], order).select(
        "geonameid", F.col("label").alias("name"), F.col("country_code").alias("country"), "lat", "lon",
        "population", "capital", display_round(F.col("score"), 4).alias("value"), "rank",
    )
