"""Point, extreme and similarity queries as joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.contract import CELL
from gridloom.functions.calendar import in_years_months, widen_range
from gridloom.functions.text import slug  # noqa: F401  (region names share the slug rule)
from gridloom.functions.units import convert_delta, convert_unit, display_round, is_delta_metric
from gridloom.grid import Grid, cell_of, tile_of
from gridloom.operators.percell import slope
from gridloom.sources.series import unpack_series

MAX_POINTS = 120


def point_series(points: DataFrame, series: DataFrame, axis: DataFrame, grid: Grid,
                 key: str = "point_id") -> DataFrame:
    """Series of the cell under each point; all-missing cells give no rows.

    ``series`` is packed, so the join moves one row per cell and the explode
    happens only for cells that a point asked for.
    """
    p = points.select(key, *[c.alias(n) for n, c in cell_of(F.col("lat"), F.col("lon"), grid).items()])
    tiles = tile_of(grid)
    p = p.select(key, *CELL, tiles["tile_r"].alias("tile_r"))
    hit = p.join(series.where(F.exists("values", lambda v: v.isNotNull())), [*CELL, "tile_r"])
    return unpack_series(hit, axis, keep=[key, "metric_id"])


def repaired_labels(values: Column, labels: Column, fallback_year: int = 1979) -> Column:
    """Axis labels that fit the vector length.

    Yearly axes are re-derived backwards from their last label; longer ones
    keep their tail; anything else counts up from the fallback year.
    """
    n = F.size(values)
    numeric = F.forall(labels, lambda s: s.rlike(r"^\d+$")) & (F.size(labels) > 0)
    last = F.try_element_at(labels, F.lit(-1)).try_cast("int")
    years = lambda a, b: F.transform(F.sequence(a, b), lambda y: y.cast("string"))
    fallback = years(F.lit(fallback_year), F.lit(fallback_year) + n - 1)
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(F.size(labels) == n, labels)
        .when(numeric, years(last - n + 1, last))
        .when(F.size(labels) > n, F.slice(labels, F.size(labels) - n + 1, n))
        .otherwise(fallback)
    )


def metric_series(rows: DataFrame, keys: list[str], monthly: bool, start: int | None = None,
                  end: int | None = None, months: list[int] | None = None,
                  by_year: bool = False) -> DataFrame:
    """Display series of each key: filtered, rounded to three digits.

    Yearly metrics ignore the months, and a one- or two-year request grows to
    three years.  Monthly values are rounded *before* they are averaged.
    """
    year, month = F.col("year"), F.col("month")
    v = display_round(F.col("value"))
    if monthly:
        kept = rows.where(in_years_months(year, month, start, end, months))
        kept = kept.select(*keys, "year", "month", v.alias("value"))
        if not (by_year and months):
            return kept
        return kept.groupBy(*keys, "year").agg(display_round(F.avg("value")).alias("value"))
    if start is not None and end is not None:
        span = rows.groupBy(*keys).agg(F.min("year").alias("__first"), F.max("year").alias("__last"))
        a, b = widen_range(F.lit(start), F.lit(end), F.col("__first"), F.col("__last"))
        rows = rows.join(span.select(*keys, a.alias("__a"), b.alias("__b")), keys)
        rows = rows.where(year.between(F.col("__a"), F.col("__b")))
    else:
        rows = rows.where(in_years_months(year, month if "month" in rows.columns else F.lit(1), start, end))
    return rows.select(*keys, "year", v.alias("value"))


def collapse_long(rows: DataFrame, keys: list[str], limit: int = MAX_POINTS) -> DataFrame:
    """Series over ``limit`` points become yearly means plus native extremes.

    ``rows`` carry year, pos and value; shorter series pass unchanged.  The
    first of equal extremes wins.
    """
    v = F.col("value")
    info = rows.groupBy(*keys).agg(
        (F.count(F.lit(1)) > limit).alias("collapsed"),
        F.max_by("pos", F.when(v.isNotNull(), F.struct(v, -F.col("pos")))).alias("max_pos"),
        F.max("value").alias("max_value"),
        F.min_by("pos", F.when(v.isNotNull(), F.struct(v, F.col("pos")))).alias("min_pos"),
        F.min("value").alias("min_value"),
    )
    slot = F.when(F.col("collapsed"), F.col("year")).otherwise(F.col("pos"))
    mean = F.avg("value")
    out = rows.join(info, keys).groupBy(
        *keys, "collapsed", slot.alias("slot"), "max_pos", "max_value", "min_pos", "min_value"
    ).agg(
        F.min("year").alias("year"),
        F.when(F.col("collapsed"), display_round(mean)).otherwise(F.max("value")).alias("value"),
    )
    # Years without a single value do not appear in a collapsed series.
    return out.where(~F.col("collapsed") | F.col("value").isNotNull()).drop("slot")


def monthly_summary(rows: DataFrame, keys: list[str], threshold: int = 60) -> DataFrame:
    """Long monthly series as twelve climatological means, overall mean and records."""
    v = F.col("value")
    at = F.struct("year", "month")
    order = F.col("year") * 12 + F.col("month")
    whole = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        display_round(F.avg("value"), 2).alias("overall_mean"),
        display_round(F.max("value"), 2).alias("high"),
        F.max_by(at, F.when(v.isNotNull(), F.struct(v, -order))).alias("high_at"),
        display_round(F.min("value"), 2).alias("low"),
        F.min_by(at, F.when(v.isNotNull(), F.struct(v, order))).alias("low_at"),
    ).where(F.col("n_records") > threshold)
    months = rows.where(v.isNotNull()).groupBy(*keys, "month").agg(
        display_round(F.avg("value"), 2).alias("month_mean")
    )
    return whole.join(months, keys).select(
        *keys, "month", "month_mean", "n_records", "first_year", "last_year", "overall_mean",
        "high", F.col("high_at.year").alias("high_year"), F.col("high_at.month").alias("high_month"),
        "low", F.col("low_at.year").alias("low_year"), F.col("low_at.month").alias("low_month"),
    )


def eligible_cities(places: DataFrame, min_population: int = 0, capital_only: bool = False,
                    country: str | None = None, continent: str | None = None,
                    continent_country: DataFrame | None = None,
                    dependencies: list[str] | None = None) -> DataFrame:
    """Population, capital, country and (only without a country) continent filters."""
    out = places.where(F.col("population") >= max(min_population, 1000))
    if capital_only:
        out = out.where(F.col("capital") & is_sovereign(F.col("country_code"), dependencies or []))
    if country is not None:
        return out.where(F.col("country_code") == country)
    if continent is not None:
        members = continent_country.where(F.col("continent") == continent).select("country_code").distinct()
        out = out.join(members, "country_code", "left_semi")
    return out


def is_sovereign(code: Column, dependencies: list[str]) -> Column:
    """Everything but a listed dependency; unknown codes count as sovereign."""
    return F.coalesce(~code.isin(*dependencies), F.lit(True)) if dependencies else F.lit(True)


def shown(value: Column, unit: str, target: str, delta: bool) -> Column:
    """Display value of a score in another temperature unit; differences keep their zero."""
    return display_round((convert_delta if delta else convert_unit)(display_round(value), unit, target))


def shown_unit(unit: str, target: str) -> Column:
    """Only temperatures are converted."""
    return F.lit(target if {unit, target} <= {"C", "F"} else unit)


def counts_as_delta(aggregation: str, aggregator: str) -> bool:
    return aggregation == "trend_slope" or any(w in aggregator.lower() for w in ("offset", "anomaly", "delta"))


def _first_rows(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Top ``limit`` rows with their ``rank``; only those rows are numbered."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def extreme_locations(cities: DataFrame, series: DataFrame, grid: Grid, aggregation: str,
                      extremum: str = "max", limit: int = 1, monthly: bool = False,
                      start: int | None = None, end: int | None = None,
                      months: list[int] | None = None, collapse: bool = True, unit: str = "C",
                      target: str = "C", aggregator: str = "mean") -> DataFrame:
    """Top cities by a score of their series (long rows per cell), with rank, value in ``target`` and unit.

    Scores use display-rounded values, and a long monthly series is scored on
    its yearly means unless ``collapse`` is off.  Only cells under a candidate
    city reach the aggregation; the top-k is a bounded take.
    """
    if monthly and aggregation == "trend_slope":
        raise ValueError("trend_slope needs a yearly metric")
    from gridloom.operators.regions import candidate_cities

    chosen = candidate_cities(cities).withColumns(cell_of(F.col("lat"), F.col("lon"), grid))
    wanted = series.join(chosen.select(*CELL).distinct(), CELL, "left_semi")
    rows = metric_series(wanted, CELL, monthly, start, end, months)
    if monthly and collapse:
        pos = (F.col("year") * 12 + F.col("month")).alias("pos")
        rows = collapse_long(rows.select(*CELL, "year", pos, "value"), CELL)
    v, year = F.col("value"), F.col("year")
    first = year * 12 + (F.col("month") if "month" in rows.columns else F.lit(0))
    score = {
        "mean": F.avg("value"), "max": F.max("value"), "min": F.min("value"),
        "trend_slope": slope() * 10,
    }[aggregation]
    at = {
        "max": F.max_by("year", F.when(v.isNotNull(), F.struct(v, -first))),
        "min": F.min_by("year", F.when(v.isNotNull(), F.struct(v, first))),
    }.get(aggregation, F.lit(None).cast("int"))
    scored = rows.groupBy(*CELL).agg(F.round(score, 9).alias("score"), at.alias("year"))
    ordered = chosen.join(scored.where(F.col("score").isNotNull()), CELL)
    order = [F.desc("score") if extremum == "max" else F.asc("score"), F.desc("population"), F.asc("geonameid")]
    value = shown(F.col("score"), unit, target, counts_as_delta(aggregation, aggregator))
    return _first_rows(ordered, order, limit).select(
        "rank", "geonameid", "label", "alt_names", "lat", "lon", value.alias("value"),
        shown_unit(unit, target).alias("unit"), "year"
    )


def extreme_from_ranking(ranking: DataFrame, eligible: DataFrame, extremum: str = "max", limit: int = 1,
                         unit: str = "C", target: str = "C", aggregation: str = "mean",
                         aggregator: str = "mean") -> DataFrame:
    """The same question answered from a stored ranking; ``min`` reads it backwards."""
    kept = ranking.join(eligible.select("geonameid"), "geonameid", "left_semi").withColumnRenamed("rank", "stored")
    top = _first_rows(kept, [F.asc("stored") if extremum == "max" else F.desc("stored")], limit)
    return top.select(
        "rank", "geonameid", "name", "lat", "lon",
        shown(F.col("value"), unit, target, counts_as_delta(aggregation, aggregator)).alias("value"),
        shown_unit(unit, target).alias("unit"),
    )


def series_means(series: DataFrame, monthly: bool = False) -> DataFrame:
    """(cell, mean) of the series as they are shown: display-rounded, long monthly ones as yearly means."""
    rows = metric_series(series, CELL, monthly)
    if monthly:
        pos = (F.col("year") * 12 + F.col("month")).alias("pos")
        rows = collapse_long(rows.select(*CELL, "year", pos, "value"), CELL)
    return rows.groupBy(*CELL).agg(F.avg("value").alias("mean")).where(F.col("mean").isNotNull())


def extreme_regions(region_series: DataFrame, aggregation: str, extremum: str = "max", limit: int = 1,
                    region_type: str | None = None, major_oceans: list[str] | None = None,
                    countries: list[str] | None = None, start: int | None = None,
                    end: int | None = None, unit: str = "C", target: str = "C", aggregator: str = "mean") -> DataFrame:
    """Top regions by a score of their yearly mean series.

    Oceans outside the major list are left out; a country list (a continent's
    members) restricts countries only.
    """
    kind = F.col("region_type")
    keep = F.lit(True) if region_type is None else kind == region_type
    if major_oceans is not None:
        keep = keep & ((kind != "ocean") | F.col("region_key").isin(*major_oceans))
    if countries is not None:
        keep = keep & ((kind != "country") | F.substring_index("region_key", ":", -1).isin(*countries))
    rows = region_series.where(keep & F.col("value").isNotNull()).where(
        in_years_months(F.col("year"), F.lit(1), start, end)
    )
    score = {
        "mean": F.avg("value"), "max": F.max("value"), "min": F.min("value"), "trend_slope": slope() * 10
    }[aggregation]
    scored = rows.groupBy("region_key", "region_type", "region_name").agg(F.round(score, 9).alias("score"))
    order = [F.desc("score") if extremum == "max" else F.asc("score"), F.asc("region_key")]
    value = shown(F.col("score"), unit, target, counts_as_delta(aggregation, aggregator))
    return _first_rows(scored.where(F.col("score").isNotNull()), order, limit).select(
        "rank", "region_key", "region_type", "region_name", value.alias("value"), shown_unit(unit, target).alias("unit")
    )


# Other names of the whole globe.
GLOBE_NAMES = ["global", "worldwide", "world", "globe"]


def resolve_regions(names: DataFrame, regions: DataFrame, name: str = "query") -> DataFrame:
    """Region key per free-text name: exact key, globe, slugs, country code, then name."""
    norm = F.lower(F.trim(F.col(name)))
    dashed = F.replace(norm, F.lit(" "), F.lit("_"))
    option = lambda priority, key: F.struct(F.lit(priority).alias("priority"), key.alias("k"))
    keyed = F.array(
        option(0, F.col(name)),
        option(1, F.when(norm.isin(*GLOBE_NAMES), F.lit("globe"))),
        option(2, F.concat(F.lit("continent:"), dashed)),
        option(3, F.concat(F.lit("country:"), dashed)),
        option(4, F.concat(F.lit("ocean:"), dashed)),
        option(5, F.concat(F.lit("country:"), F.upper(norm))),
        option(6, F.concat(F.lit("name:"), norm)),
    )
    asked = names.select(name).distinct().select(name, F.explode(keyed).alias("o")).select(name, "o.*")
    known = regions.select("region_key", F.explode(F.array(
        F.col("region_key"), F.concat(F.lit("name:"), F.lower("region_name"))
    )).alias("k"))
    return asked.where(F.col("k").isNotNull()).join(known, "k").groupBy(name).agg(
        F.min_by("region_key", F.struct("priority", "region_key")).alias("region_key")
    )


def region_series_query(region_series: DataFrame, key: str, unit: str = "C", target: str = "C",
                        aggregator: str = "mean", start: int | None = None, end: int | None = None,
                        months: list[int] | None = None, by_year: bool = False,
                        limit: int | None = MAX_POINTS) -> DataFrame:
    """One region's series by label, optionally by month, rolled up and converted.

    A series of more than ``limit`` points becomes yearly means; None keeps every point.
    """
    label = F.col("axis_label")
    year = F.substring(label, 1, 4).cast("int")
    rows = region_series.where(F.col("region_key") == key).where(
        in_years_months(year, F.lit(1), start, end)
    ).withColumn("monthly", F.length(label) == 7)
    if months:
        month = F.substring(label, 6, 2).try_cast("int")
        rows = rows.where(~F.col("monthly") | month.isin(*months))
    rows = rows.withColumn("x", label)
    if by_year:
        rows = rows.where(~F.col("monthly") | F.col("value").isNotNull()).groupBy(
            "region_key", F.when(F.col("monthly"), F.substring(label, 1, 4)).otherwise(label).alias("x")
        ).agg(F.avg("value").alias("value"))
    v = F.col("value")
    shown = F.when(is_delta_metric(F.lit(aggregator)), convert_delta(v, unit, target)).otherwise(
        convert_unit(v, unit, target)
    )
    out = rows.select("region_key", "x", shown.alias("value"), F.substring("x", 1, 4).cast("int").alias("year"))
    long = F.lit(False) if limit is None else F.count(F.lit(1)) > limit
    n = out.agg(long.alias("collapsed"))
    slot = F.when(F.col("collapsed"), F.col("year").cast("string")).otherwise(F.col("x"))
    return out.join(F.broadcast(n)).groupBy("region_key", slot.alias("x"), "collapsed").agg(
        F.when(F.col("collapsed"), display_round(F.avg("value"))).otherwise(F.max("value")).alias("value")
    )


def rank_of_points(points: DataFrame, ranking: DataFrame, reach: float = 0.35) -> DataFrame:
    """Nearest ranked city in Chebyshev degrees under ``reach``: its rank and share beaten.

    Cities are unique per quarter-degree key, so a bucket of the reach holds a
    handful of them and the equi-join on buckets stays narrow.
    """
    bucket = lambda c: F.floor(c / F.lit(reach)).cast("int")
    total = ranking.agg(F.count(F.lit(1)).alias("total"))
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = ranking.select(
        "rank", "value", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")
    ).withColumn("by", F.explode(F.transform(around, lambda d: bucket(F.col("c_lat")) + d))).withColumn(
        "bx", F.explode(F.transform(around, lambda d: bucket(F.col("c_lon")) + d))
    )
    pts = points.withColumns({"by": bucket(F.col("lat")), "bx": bucket(F.col("lon"))})
    d = F.greatest(F.abs(F.col("c_lat") - F.col("lat")), F.abs(F.col("c_lon") - F.col("lon")))
    hits = pts.join(spread, ["by", "bx"]).withColumn("d", d).where(F.col("d") < reach)
    best = hits.groupBy("point_id").agg(
        F.min_by(F.struct("rank", "value"), F.struct("d", "rank")).alias("b")
    ).select("point_id", F.col("b.rank").alias("rank"), F.col("b.value").alias("value"))
    share = (F.col("total") - F.col("rank")) / F.col("total") * 100
    return best.join(F.broadcast(total)).withColumn("share_below", share)


def metric_catalogue(axis: DataFrame, metrics: DataFrame) -> DataFrame:
    """Visible metrics with the first and last label of their axis."""
    ends = axis.groupBy("metric_id").agg(
        F.min_by("label", "pos").alias("first_label"), F.max_by("label", "pos").alias("last_label")
    )
    return metrics.where(~F.coalesce("hidden", F.lit(False))).drop("hidden").join(ends, "metric_id", "left")
