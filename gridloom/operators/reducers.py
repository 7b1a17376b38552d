"""Temporal reducers: daily or monthly observations to months, years, climatologies.

Input rows are unique per (cell, t), so a (cell, year) group never exceeds 366
rows and the few windows used here stay small whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.contract import CELL
from gridloom.functions.calendar import is_feb29


def _year() -> Column:
    return F.year("t").alias("year")


def _month() -> Column:
    return F.trunc("t", "MM").alias("t")


def _observed(result: Column) -> Column:
    """A group without a single observation stays missing."""
    return F.when(F.count("value") > 0, result)


def identity(obs: DataFrame) -> DataFrame:
    return obs.select(*CELL, "t", "value")


def _monthly(obs: DataFrame, agg: Column, fill_gaps: bool) -> DataFrame:
    months = obs.groupBy(*CELL, _month()).agg(agg.alias("value"))
    if not fill_gaps:
        return months
    # Months with no rows inside a cell's own span appear as missing.
    spine = months.groupBy(*CELL).agg(F.min("t").alias("a"), F.max("t").alias("b")).select(
        *CELL, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("t")
    )
    return spine.join(months, [*CELL, "t"], "left")


def monthly_mean(obs: DataFrame, fill_gaps: bool = False) -> DataFrame:
    return _monthly(obs, F.avg("value"), fill_gaps)


def monthly_max(obs: DataFrame, fill_gaps: bool = False) -> DataFrame:
    return _monthly(obs, F.max("value"), fill_gaps)


def monthly_min(obs: DataFrame, fill_gaps: bool = False) -> DataFrame:
    return _monthly(obs, F.min("value"), fill_gaps)


def annual_mean_of_months(monthly: DataFrame) -> DataFrame:
    """Unweighted mean of the months of a year."""
    return monthly.groupBy(*CELL, _year()).agg(F.avg("value").alias("value"))


def annual_mean_from_daily(obs: DataFrame) -> DataFrame:
    """Mean of monthly means, so long months weigh no more than short ones."""
    return annual_mean_of_months(monthly_mean(obs))


def annual_sum(obs: DataFrame) -> DataFrame:
    return obs.groupBy(*CELL, _year()).agg(F.sum("value").alias("value"))


_HOW = {"mean": F.avg, "sum": F.sum, "max": F.max}


def annual_group(obs: DataFrame, how: str, keys=CELL) -> DataFrame:
    if how not in _HOW:
        raise ValueError(f"unknown annual aggregate: {how}")
    return obs.groupBy(*keys, _year()).agg(_HOW[how]("value").alias("value"))


def daily_to_monthly_yearly(daily: DataFrame) -> DataFrame:
    """Monthly and day-weighted yearly means of daily mean/min/max in one scan.

    Yearly means are combined from the monthly sums and counts, so the daily
    rows are shuffled once.
    """
    cols = ["v_mean", "v_min", "v_max"]
    parts = daily.groupBy(*CELL, _month()).agg(
        *[F.sum(c).alias(f"s_{c}") for c in cols], *[F.count(c).alias(f"n_{c}") for c in cols]
    )
    tagged = parts.select(
        "*",
        F.explode(F.array(
            F.struct(F.lit("monthly").alias("period"), F.col("t").alias("start")),
            F.struct(F.lit("yearly").alias("period"), F.trunc("t", "YEAR").alias("start")),
        )).alias("p"),
    )
    return tagged.groupBy(*CELL, "p.period", "p.start").agg(
        *[F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}")).alias(c) for c in cols]
    )


def longest_dry_run(obs: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Longest run of consecutive rows below ``threshold`` within each year.

    Runs follow row order; a missing value or the year edge ends a run.
    """
    year_rows = Window.partitionBy(*CELL, "year").orderBy("t")
    dry_rows = Window.partitionBy(*CELL, "year", "dry").orderBy("t")
    marked = obs.select(
        *CELL, _year(), "t", "value",
        F.coalesce(F.col("value") < threshold, F.lit(False)).alias("dry"),
    )
    islands = marked.withColumn(
        "island", F.row_number().over(year_rows) - F.row_number().over(dry_rows)
    )
    runs = islands.groupBy(*CELL, "year", "dry", "island").agg(
        F.count(F.lit(1)).alias("len"), F.count("value").alias("n")
    )
    longest = F.coalesce(F.max(F.when(F.col("dry"), F.col("len"))), F.lit(0))
    return runs.groupBy(*CELL, "year").agg(
        F.when(F.sum("n") > 0, longest).cast("long").alias("value")
    )


def climatology_mean(annual: DataFrame, start: int, end: int, label_year: int | None = None,
                     strict: bool = True) -> DataFrame:
    """Mean over a window of years, labelled with one year (the end by default)."""
    window = annual.where(F.col("year").between(start, end))
    if strict and window.isEmpty():
        raise ValueError(f"no data in climatology window {start}-{end}")
    return window.groupBy(*CELL).agg(F.avg("value").alias("value")).select(
        *CELL, F.lit(label_year or end).alias("year"), "value"
    )


def hot_days(obs: DataFrame, baseline_years: int = 10, percentile: float = 90) -> DataFrame:
    """Days above the cell's own day-of-year percentile in the first years.

    29 February is dropped but days keep their calendar number, so after
    February a leap year is compared with the neighbouring day of a common
    year, and day 366 has a threshold only if the baseline has a leap year.
    """
    days = obs.where(~is_feb29(F.col("t"))).select(
        *CELL, _year(), F.dayofyear("t").alias("doy"), "value"
    )
    first = obs.agg((F.min(F.year("t")) + baseline_years - 1).alias("last_base"))
    # One shuffle by cell serves both groupings: a (cell, day) group holds one
    # value per year, so its years travel as a short array and nothing is joined back.
    by_day = days.join(F.broadcast(first)).repartition(*CELL).groupBy(*CELL, "doy").agg(
        # Interpolation noise must not make a day hotter than an equal limit.
        F.round(F.percentile(
            F.when(F.col("year") <= F.col("last_base"), F.col("value")), F.lit(percentile / 100)
        ), 9).alias("p"),
        F.collect_list(F.struct("year", "value")).alias("years"),
    )
    return by_day.select(*CELL, "p", F.inline("years")).groupBy(*CELL, "year").agg(
        _observed(F.count_if(F.col("value") > F.col("p"))).alias("value")
    )


def day_limits(baseline: DataFrame, percentile: float = 90) -> DataFrame:
    """(cell, limits): each cell's percentile per day of the year, as one array of 366; the table to store for C12.

    ``baseline`` holds the days of the baseline years only.  A day without an observation has no limit.
    """
    per_day = baseline.where(~is_feb29(F.col("t"))).groupBy(*CELL, F.dayofyear("t").alias("doy")).agg(
        F.round(F.percentile("value", F.lit(percentile / 100)), 9).alias("p"))
    known = F.map_from_entries(F.collect_list(F.struct("doy", "p")))
    return per_day.groupBy(*CELL).agg(known.alias("known")).select(
        *CELL, F.transform(F.sequence(F.lit(1), F.lit(366)), lambda d: F.try_element_at("known", d)).alias("limits"))


def hot_days_against(obs: DataFrame, limits: DataFrame) -> DataFrame:
    """:func:`hot_days` of any years against stored :func:`day_limits`: the baseline is not read again.

    One row per cell is joined, and the days are shuffled at most once, by cell.  Cells without limits have no hot day.
    """
    days = obs.where(~is_feb29(F.col("t"))).select(*CELL, _year(), F.dayofyear("t").alias("doy"), "value")
    hot = F.col("value") > F.get("limits", F.col("doy") - 1)
    return days.join(limits.select(*CELL, "limits"), CELL, "left").groupBy(*CELL, "year").agg(
        _observed(F.count_if(hot)).alias("value"))


def multi_model_offset(models: DataFrame, base=(1850, 1900), ref=(1979, 2000),
                       label_year: int | None = None) -> DataFrame:
    """Ensemble mean first, then reference climatology minus the earlier one."""
    ensemble = models.groupBy(*CELL, "year").agg(F.avg("value").alias("value"))
    mean_in = lambda w: F.avg(F.when(F.col("year").between(*w), F.col("value")))
    return ensemble.groupBy(*CELL).agg(
        F.lit(label_year or ref[1]).alias("year"), (mean_in(ref) - mean_in(base)).alias("value")
    )


def heat_stress_years(obs: DataFrame, moderate: float = 4.0, severe: float = 8.0) -> DataFrame:
    """No-risk, moderate and severe days, their score and the yearly maximum in one pass."""
    v = F.col("value")
    mod = F.count_if((v >= moderate) & (v < severe))
    sev = F.count_if(v >= severe)
    return obs.groupBy(*CELL, _year()).agg(
        _observed(F.count_if(v < moderate)).alias("no_risk_days"),
        _observed(mod).alias("moderate_days"),
        _observed(sev).alias("severe_days"),
        _observed(mod + 2 * sev).alias("risk_score"),
        F.max("value").alias("max_value"),
    )


def period_completeness(obs: DataFrame, period: str = "year") -> DataFrame:
    """Distinct days present against calendar days of each period of the whole input."""
    unit = {"year": "YEAR", "month": "MM"}[period]
    step = {"year": F.expr("interval 1 year"), "month": F.expr("interval 1 month")}[period]
    days = obs.select("t").distinct()
    start = F.trunc("t", unit)
    return days.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("days_present")).select(
        "start",
        "days_present",
        F.datediff((F.col("start") + step).cast("date"), "start").cast("long").alias("days_expected"),
    ).withColumn("complete", F.col("days_present") == F.col("days_expected"))


def require_complete_end(obs: DataFrame, period: str = "year") -> DataFrame:
    """Fail when the last period of the input is incomplete."""
    last = period_completeness(obs, period).orderBy(F.desc("start")).first()
    if last is None or not last["complete"]:
        raise ValueError(f"incomplete final {period}: {last and last['start']}")
    return obs


def concat_blocks(blocks: list[DataFrame], start: int, end: int, strict: bool = True) -> DataFrame:
    """Union of per-block results restricted to the analysis years."""
    if not blocks:
        raise ValueError("no blocks to combine")
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block, allowMissingColumns=True)
    out = out.where(F.col("year").between(start, end))
    if strict and out.isEmpty():
        raise ValueError(f"no rows in {start}-{end}")
    return out


def select_years(df: DataFrame, years: list[int]) -> DataFrame:
    """Rows of the wanted years, or everything when none of them occurs."""
    if not years:
        return df
    hit = df.agg(F.coalesce(F.bool_or(F.col("year").isin(*years)), F.lit(False)).alias("__any"))
    return df.join(F.broadcast(hit)).where(F.col("year").isin(*years) | ~F.col("__any")).drop("__any")


#: Reducers by name, as a metric definition refers to them.
REDUCERS = {
    "identity": identity,
    "monthly_mean_from_daily": monthly_mean,
    "monthly_max_from_daily": monthly_max,
    "monthly_min_from_daily": monthly_min,
    "annual_mean_from_monthly": annual_mean_of_months,
    "annual_mean_from_daily": annual_mean_from_daily,
    "annual_sum_from_daily": annual_sum,
    "max_cdd_per_year": longest_dry_run,
    "climatology_mean": climatology_mean,
    "hot_days_per_year": hot_days,
    "multi_model_offset": multi_model_offset,
    "dhw_no_risk_days": lambda o: heat_stress_years(o).select(*CELL, "year", F.col("no_risk_days").alias("value")),
    "dhw_moderate_days": lambda o: heat_stress_years(o).select(*CELL, "year", F.col("moderate_days").alias("value")),
    "dhw_severe_days": lambda o: heat_stress_years(o).select(*CELL, "year", F.col("severe_days").alias("value")),
    "dhw_risk_score": lambda o: heat_stress_years(o).select(*CELL, "year", F.col("risk_score").alias("value")),
    "dhw_max_per_year": lambda o: heat_stress_years(o).select(*CELL, "year", F.col("max_value").alias("value")),
}
