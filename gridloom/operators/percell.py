"""Per-cell map reducers and derived metrics over yearly or monthly series.

``annual`` inputs have one row per (cell, year); ``monthly`` inputs one row per
(cell, t).  A row may be present with a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.contract import CELL
from gridloom.functions.units import display_round

def _v() -> Column:
    return F.col("value")


def latest_year(annual: DataFrame) -> DataFrame:
    """Every cell's value at the last position of the axis, even a missing one."""
    last = annual.agg(F.max("year").alias("__y"))
    return annual.join(F.broadcast(last), F.col("year") == F.col("__y")).drop("__y")


def at_year(annual: DataFrame, year: int, strict: bool = True) -> DataFrame:
    out = annual.where(F.col("year") == year)
    if strict and out.isEmpty():
        raise ValueError(f"year {year} is not on the axis")
    return out


def mean_between(annual: DataFrame, start: int, end: int, strict: bool = True) -> DataFrame:
    """Finite mean; both ends must be on the axis."""
    if strict:
        ends = annual.where(F.col("year").isin(start, end)).select("year").distinct().count()
        if ends < len({start, end}):
            raise ValueError(f"{start} or {end} is not on the axis")
    return annual.where(F.col("year").between(start, end)).groupBy(*CELL).agg(F.avg("value").alias("value"))


def anomaly_vs_mean(annual: DataFrame, target: int, start: int, end: int) -> DataFrame:
    """Value of a year minus the mean of a window; missing if either is."""
    at = F.max(F.when(F.col("year") == target, _v()))
    base = F.avg(F.when(F.col("year").between(start, end), _v()))
    return annual.groupBy(*CELL).agg((at - base).alias("value"))


def _spread(x: str, y: str) -> Column:
    """Distinct x of present y span more than a point."""
    seen = F.when(F.col(y).isNotNull(), F.col(x))
    return F.max(seen) > F.min(seen)


def slope(x: str = "year", y: str = "value") -> Column:
    """Least-squares slope over present values; missing below two distinct x."""
    return F.when(_spread(x, y), F.regr_slope(y, x))


def intercept(x: str = "year", y: str = "value") -> Column:
    return F.when(_spread(x, y), F.regr_intercept(y, x))


def trend_slope(annual: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Slope per year over an optional window."""
    rows = annual
    if start is not None:
        rows = rows.where(F.col("year") >= start)
    if end is not None:
        rows = rows.where(F.col("year") <= end)
    return rows.groupBy(*CELL).agg(slope().alias("value"))


def trend_slope_per_decade(annual: DataFrame, axis: DataFrame | None = None) -> DataFrame:
    """Slope per decade with x centred on the *whole* axis.

    Where values are missing this is not the least-squares slope: the x mean
    still comes from every axis year, the y mean from the present ones.  With
    n present points it is ``Sxy / (Sxx + n (mean_x - axis_mean)^2)``.
    """
    years = (axis or annual).select("year").distinct()
    center = years.agg(F.avg("year").alias("__x0"))
    fits = annual.groupBy(*CELL).agg(
        F.regr_sxy("value", "year").alias("sxy"),
        F.regr_sxx("value", "year").alias("sxx"),
        F.regr_avgx("value", "year").alias("mx"),
        F.regr_count("value", "year").alias("n"),
    )
    denom = F.col("sxx") + F.col("n") * F.pow(F.col("mx") - F.col("__x0"), 2)
    return fits.join(F.broadcast(center)).select(
        *CELL,
        F.when((F.col("n") >= 2) & (denom > 0), 10 * F.col("sxy") / denom).alias("value"),
    )


def monthly_climatology_anomaly(monthly: DataFrame, year: int, month: int, start: int, end: int,
                                strict: bool = True) -> DataFrame:
    """One month minus the mean of that calendar month over a window of years.

    Without the target month, or without any month of the window, it fails.
    """
    y, m = F.year("t"), F.month("t")
    rows = monthly.where(m == month)
    if strict:
        _require(rows.where(y == year), f"month {year}-{month:02d}")
        _require(rows.where(y.between(start, end)), f"month {month} of {start}-{end}")
    return rows.groupBy(*CELL).agg(
        (F.max(F.when(y == year, _v())) - F.avg(F.when(y.between(start, end), _v()))).alias("value")
    )


def _require(rows: DataFrame, what: str) -> None:
    if rows.isEmpty():
        raise ValueError(f"{what} is not on the axis")


def mean_over_positions(series: DataFrame, axis: DataFrame, keep: Column, strict: bool = True) -> DataFrame:
    """Mean over the axis positions that satisfy ``keep``; rows carry ``t``."""
    wanted = axis.where(keep).select("t").distinct()
    if strict:
        _require(wanted, "any selected position")
    return series.join(wanted, "t", "left_semi").groupBy(*CELL).agg(F.avg("value").alias("value"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cell-wise left minus right where both exist."""
    return left.select(*CELL, F.col("value").alias("a")).join(
        right.select(*CELL, F.col("value").alias("b")), CELL
    ).select(*CELL, (F.col("a") - F.col("b")).alias("value"))


def daily_window_anomaly(daily: DataFrame, monthly: DataFrame, window: Column, climatology: Column,
                         strict: bool = True) -> DataFrame:
    """Mean of a daily window minus a monthly climatology on the same grid."""
    if strict:
        _require(daily.where(window), "the daily window")
        _require(monthly.where(climatology), "the climatology")
    mean = lambda df, keep: df.where(keep).groupBy(*CELL).agg(F.avg("value").alias("value"))
    return difference(mean(daily, window), mean(monthly, climatology))


def blended_preindustrial_anomaly(annual: DataFrame, offset: DataFrame, recent, reference) -> DataFrame:
    """Recent minus reference mean, plus a modelled offset of the reference period."""
    mean_in = lambda w: F.avg(F.when(F.col("year").between(*w), _v()))
    change = annual.groupBy(*CELL).agg((mean_in(recent) - mean_in(reference)).alias("a"))
    return change.join(
        offset.groupBy(*CELL).agg(F.max_by("value", "year").alias("b")), CELL
    ).select(*CELL, (F.col("a") + F.col("b")).alias("value"))


#: Reductions of a yearly series to one map value, by the name a map definition uses.
MAP_REDUCERS = {
    "latest_year": latest_year,
    "year": at_year,
    "mean": mean_between,
    "anomaly_vs_mean": anomaly_vs_mean,
    "trend_slope": trend_slope,
}

#: Functions of derived metrics, by the name a metric definition uses.
DERIVATIONS = {
    "trend_slope_per_decade": trend_slope_per_decade,
    "monthly_climatology_anomaly": monthly_climatology_anomaly,
    "daily_window_anomaly": daily_window_anomaly,
    "blended_preindustrial_anomaly": blended_preindustrial_anomaly,
}


def reduce_map(annual: DataFrame, op: str = "latest_year", **params) -> DataFrame:
    if op not in MAP_REDUCERS:
        raise ValueError(f"unknown map reducer: {op}")
    return MAP_REDUCERS[op](annual, **params)


def derive_metrics(base: dict[str, DataFrame], definitions: dict) -> tuple[DataFrame, dict[str, str]]:
    """Run derived metrics once their inputs exist.

    ``definitions`` maps a metric id to ``(inputs, fn)``.  Metrics may depend
    on each other; those whose inputs never appear are reported with a reason.
    Returns one table of (metric_id, cell, value) and the skipped metrics.
    """
    ready = dict(base)
    waiting = dict(definitions)
    made: dict[str, DataFrame] = {}
    while True:
        runnable = [m for m, (inputs, _) in waiting.items() if all(i in ready for i in inputs)]
        if not runnable:
            break
        for m in runnable:
            inputs, fn = waiting.pop(m)
            made[m] = ready[m] = fn(*[ready[i] for i in inputs])
    skipped = {
        m: "missing input: " + ", ".join(i for i in inputs if i not in ready)
        for m, (inputs, _) in waiting.items()
    }
    out = None
    for m, df in made.items():
        part = df.select(F.lit(m).alias("metric_id"), *CELL, "value")
        out = part if out is None else out.unionByName(part)
    return out, skipped


# --- series along an axis: one row per (keys, pos), at most the axis length per key ----

def _frame(keys, order, before, after):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(before, after)


def rolling_mean_centered(series: DataFrame, keys, window: int, order: str = "pos") -> DataFrame:
    """Centred mean with a full window; even windows use one point more."""
    half = window // 2
    w = _frame(keys, order, -half, half)
    return series.withColumn(
        "rolling", F.when(F.count(F.lit(1)).over(w) == 2 * half + 1, F.avg("value").over(w))
    )


def rolling_mean_min_periods(series: DataFrame, keys, window: int, unit: str = "points",
                             order: str = "pos", given: str = "mean") -> DataFrame:
    """Centred mean truncated at the edges, only where no mean was given."""
    need = {"days": window, "years": 2}.get(unit, max(2, -(-window // 2)))
    half = window // 2
    w = _frame(keys, order, -half, half)
    rolled = F.when(F.count("value").over(w) >= need, F.avg("value").over(w))
    return series.withColumn("rolling", F.coalesce(F.col(given), rolled))


def linear_trend_line(series: DataFrame, keys, x: str = "x", extend_to=None) -> DataFrame:
    """Fitted value at every x, and at one later x when asked."""
    fit = series.groupBy(*keys).agg(
        slope(x).alias("__b"), intercept(x).alias("__a"), F.max(x).alias("__last")
    )
    rows = series.select(*keys, x)
    if extend_to is not None:
        rows = rows.unionByName(
            fit.where(F.col("__last") < extend_to).select(
                *keys, F.lit(extend_to).cast(series.schema[x].dataType).alias(x)
            )
        )
    return rows.join(fit, keys).select(
        *keys, x, (F.col("__a") + F.col("__b") * F.col(x)).alias("trend")
    )


def label_to_x(label: Column) -> Column:
    """Axis labels as numbers: years stay years, dates become epoch seconds.

    ``YYYY`` on a date axis means 31 December; ``YYYY-MM`` the first of the month.
    """
    date = (
        F.when(F.length(label) == 4, F.concat(label, F.lit("-12-31")))
        .when(F.length(label) == 7, F.concat(label, F.lit("-01")))
        .otherwise(label)
    )
    return F.datediff(date.cast("date"), F.lit("1970-01-01").cast("date")).cast("double") * 86400


def series_extrema(series: DataFrame, keys, x: str = "year") -> DataFrame:
    """Lowest and highest present value with the first x that has it."""
    here = series.where(_v().isNotNull())
    return here.groupBy(*keys).agg(
        F.min("value").alias("min_value"),
        F.min_by(x, F.struct(_v(), F.col(x))).alias("min_x"),
        F.max("value").alias("max_value"),
        F.max_by(x, F.struct(_v(), -F.col(x))).alias("max_x"),
    )


def chart_trend(series: DataFrame, keys, x: str = "year") -> DataFrame:
    """Display series plus its fitted line, rounded to three digits."""
    fit = series.groupBy(*keys).agg(slope(x).alias("__b"), intercept(x).alias("__a"))
    line = series.join(fit, keys).where(F.col("__b").isNotNull()).select(
        *keys, x, F.lit("trend").alias("role"),
        display_round(F.col("__a") + F.col("__b") * F.col(x)).alias("value"),
    )
    return series.select(*keys, x, F.lit("series").alias("role"), "value").unionByName(line)


def trend_rate_label(trend: DataFrame, keys, x_seconds: str = "x", value: str = "trend") -> DataFrame:
    """Change per decade between the first and last trend value."""
    year_seconds = 365.2425 * 86400
    here = trend.where(F.col(value).isNotNull())
    ends = here.groupBy(*keys).agg(
        F.min(x_seconds).alias("x0"), F.max(x_seconds).alias("x1"),
        F.min_by(value, x_seconds).alias("y0"), F.max_by(value, x_seconds).alias("y1"),
    )
    years = (F.col("x1") - F.col("x0")) / year_seconds
    return ends.select(
        *keys, F.when(years > 0, (F.col("y1") - F.col("y0")) / years * 10).alias("per_decade")
    )
