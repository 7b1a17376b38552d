"""Reducers that work inside packed series rows.

One row holds a cell's whole series, so a reducer that scans days in order
needs no shuffle and no window: it folds over the slice of each year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.contract import CELL
from gridloom.grid import Grid, area_weight
from gridloom.operators.regions import aggregate_columns


def year_spans(axis: DataFrame) -> DataFrame:
    """One row: the (year, start, length) of every year along the axis."""
    per_year = axis.groupBy("year").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("length"))
    return per_year.agg(F.array_sort(F.collect_list(F.struct("year", "start", "length"))).alias("spans"))


def yearly_fold(series: DataFrame, axis: DataFrame, fold) -> DataFrame:
    """``fold(values of a year) -> Column`` for every cell and year."""
    with_spans = series.join(F.broadcast(year_spans(axis)))
    yearly = F.transform("spans", lambda s: F.struct(
        s["year"].alias("year"), fold(F.slice("values", s["start"] + 1, s["length"])).alias("value")
    ))
    return with_spans.select(*CELL, F.inline(yearly))


def dry_run_fold(threshold: float = 1.0):
    """Longest run below the threshold; a missing day ends a run."""

    def fold(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(False).alias("seen"))

        def step(acc, v):
            run = F.when(F.coalesce(v < threshold, F.lit(False)), acc["run"] + 1).otherwise(0)
            return F.struct(
                run.alias("run"), F.greatest(acc["best"], run).alias("best"), (acc["seen"] | v.isNotNull()).alias("seen")
            )

        return F.aggregate(values, start, step, lambda acc: F.when(acc["seen"], acc["best"]).cast("long"))

    return fold


def longest_dry_run(series: DataFrame, axis: DataFrame, threshold: float = 1.0) -> DataFrame:
    return yearly_fold(series, axis, dry_run_fold(threshold))


def region_aggregates(series: DataFrame, axis: DataFrame, weights: DataFrame, grid: Grid, digits: int = 4) -> DataFrame:
    """Regional mean, min and max per axis step straight from packed rows.

    The join moves one array per (region, cell) and the steps unfold after it,
    so a daily series is never shuffled row by row: partial sums per
    (region, step) are all that leaves a task.
    """
    area = area_weight(F.col("i_lat"), grid)
    rows = series.select(*CELL, "values")
    w = weights.where(F.col("frac") > 0).select("region_key", *CELL, "frac")
    regional = rows.join(w, CELL).select("region_key", (area * F.col("frac")).alias("w"), F.posexplode("values").alias("pos", "value"))
    globe = rows.select(F.lit("globe").alias("region_key"), area.alias("w"), F.posexplode("values").alias("pos", "value"))
    out = regional.unionByName(globe).groupBy("region_key", "pos").agg(*aggregate_columns(F.col("w"), digits))
    return out.join(axis.select("pos", F.col("label").alias("axis_label")), "pos").drop("pos")


def _total(values: Column) -> Column:
    """(sum, count) of the present values."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(values, start, lambda acc, v: F.when(v.isNull(), acc).otherwise(
        F.struct((acc["sum"] + v).alias("sum"), (acc["n"] + 1).alias("n"))
    ))


def _mean(values: Column) -> Column:
    total = _total(values)
    return F.try_divide(total["sum"], total["n"])


def annual_sum(series: DataFrame, axis: DataFrame) -> DataFrame:
    def fold(values: Column) -> Column:
        total = _total(values)
        return F.when(total["n"] > 0, total["sum"])

    return yearly_fold(series, axis, fold)


def month_spans(axis: DataFrame) -> DataFrame:
    """One row: the (year, month, start, length) of every month along the axis."""
    per = axis.groupBy("year", "month").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("length"))
    return per.agg(F.array_sort(F.collect_list(F.struct("year", "month", "start", "length"))).alias("months"))


def monthly_totals(series: DataFrame, axis: DataFrame) -> DataFrame:
    """``series`` plus ``totals``: array of (year, month, sum, n) per month."""
    spans = series.join(F.broadcast(month_spans(axis)))

    def of_month(m: Column) -> Column:
        total = _total(F.slice("values", m["start"] + 1, m["length"]))
        return F.struct(m["year"].alias("year"), m["month"].alias("month"), total["sum"].alias("sum"), total["n"].alias("n"))

    return spans.withColumn("totals", F.transform("months", of_month)).drop("months")


def annual_mean_from_daily(series: DataFrame, axis: DataFrame) -> DataFrame:
    """Mean of the monthly means of each year."""
    months = monthly_totals(series, axis).select(*CELL, "totals", F.explode(F.array_distinct(
        F.transform("totals", lambda t: t["year"]))).alias("year"))
    mine = F.filter("totals", lambda t: t["year"] == F.col("year"))
    return months.select(*CELL, "year", _mean(F.transform(mine, lambda t: F.try_divide(t["sum"], t["n"]))).alias("value"))


def daily_to_monthly_yearly(series: DataFrame, axis: DataFrame) -> DataFrame:
    """Monthly and day-weighted yearly means, as (cell, period, start, value)."""
    totals = monthly_totals(series, axis)
    months = totals.select(*CELL, F.inline("totals")).select(
        *CELL, F.lit("monthly").alias("period"), F.make_date("year", "month", F.lit(1)).alias("start"),
        F.try_divide("sum", "n").alias("value"))
    years = totals.select(*CELL, "totals", F.explode(F.array_distinct(
        F.transform("totals", lambda t: t["year"]))).alias("year"))
    mine = F.filter("totals", lambda t: t["year"] == F.col("year"))
    add = lambda f: F.aggregate(mine, F.lit(0.0), lambda acc, t: acc + t[f])
    return months.union(years.select(
        *CELL, F.lit("yearly"), F.make_date("year", F.lit(1), F.lit(1)), F.try_divide(add("sum"), add("n"))))


def heat_stress_years(series: DataFrame, axis: DataFrame, moderate: float = 4.0, severe: float = 8.0) -> DataFrame:
    """No-risk, moderate and severe days, their score and the yearly maximum."""
    def fold(values: Column) -> Column:
        count = lambda test: F.size(F.filter(values, test)).cast("long")
        mod = count(lambda v: (v >= moderate) & (v < severe))
        sev = count(lambda v: v >= severe)
        top = F.array_max(values)
        seen = lambda c: F.when(top.isNotNull(), c)
        return F.struct(
            seen(count(lambda v: v < moderate)).alias("no_risk_days"), seen(mod).alias("moderate_days"),
            seen(sev).alias("severe_days"), seen(mod + 2 * sev).alias("risk_score"), top.alias("max_value"))

    return yearly_fold(series, axis, fold).select(*CELL, "year", "value.*")


def hot_days(series: DataFrame, axis: DataFrame, baseline_years: int = 10, percentile: float = 90) -> DataFrame:
    """Days above the cell's own day-of-year percentile in the first years, as the long form counts them.

    The calendar is one row: per day of the year its positions in the baseline and in all years.  Days unfold inside
    their task and are counted there; one row per (cell, year) and task is all that is shuffled.
    """
    days = axis.where(~((F.col("month") == 2) & (F.col("day") == 29))).withColumn(
        "doy", F.dayofyear(F.make_date("year", "month", "day")))
    last = axis.agg((F.min("year") + baseline_years - 1).alias("last_base"))
    calendar = days.join(F.broadcast(last)).groupBy("doy").agg(
        F.collect_list(F.when(F.col("year") <= F.col("last_base"), F.col("pos"))).alias("base"),
        F.collect_list(F.struct("year", "pos")).alias("every"),
    ).agg(F.collect_list(F.struct("base", "every")).alias("calendar"))
    at = lambda pos: F.get("values", pos)

    def limit(base: Column) -> Column:
        known = F.array_sort(F.filter(F.transform(base, at), lambda v: v.isNotNull()))
        rank = (F.size(known) - 1) * F.lit(percentile / 100)
        low = F.get(known, F.floor(rank).cast("int"))
        high = F.get(known, F.least(F.floor(rank).cast("int") + 1, F.size(known) - 1))
        return F.when(F.size(known) > 0, F.round(low + (high - low) * (rank - F.floor(rank)), 9))

    def of_day(d: Column) -> Column:
        return F.struct(limit(d["base"]).alias("p"), d["every"].alias("every"))

    with_limits = series.join(F.broadcast(calendar)).withColumn("limits", F.transform("calendar", of_day))
    flags = F.flatten(F.transform("limits", lambda x: F.transform(x["every"], lambda e: F.struct(
        e["year"].alias("year"), at(e["pos"]).isNotNull().alias("seen"), (at(e["pos"]) > x["p"]).alias("hot")))))
    counted = with_limits.select(*CELL, F.inline(flags)).groupBy(*CELL, "year").agg(
        F.count_if("seen").alias("n"), F.count_if("hot").alias("hot"))
    return counted.select(*CELL, "year", F.when(F.col("n") > 0, F.col("hot")).alias("value"))
