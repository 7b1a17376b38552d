"""Headline numbers and fact rows, one row per key, in grouped aggregates.

``rows`` hold (keys, year, value) with at most one row per year and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.text import MONTH_NAMES, both_units
from gridloom.functions.units import display_round
from gridloom.operators.percell import intercept, slope

RECENT_YEARS = 5


def _v() -> Column:
    return F.col("value")


def _with_latest(rows: DataFrame, keys: list[str], finite: bool = True) -> DataFrame:
    """Adds the latest (present) year of each key; a key is one axis long."""
    seen = F.when(_v().isNotNull(), F.col("year")) if finite else F.col("year")
    return rows.withColumn("latest", F.max(seen).over(Window.partitionBy(*keys)))


def _recent() -> Column:
    return F.col("year") > F.col("latest") - RECENT_YEARS


def recent_vs_window(rows: DataFrame, keys: list[str], start: int = 1979, end: int = 2000,
                     need_recent: int = 4, need_base: int = 10) -> DataFrame:
    """Mean of the latest five years minus the mean of a window, if both are well covered."""
    base = F.col("year").between(start, end)
    recent, ref = F.when(_recent(), _v()), F.when(base, _v())
    enough = (F.count(recent) >= need_recent) & (F.count(ref) >= need_base)
    return _with_latest(rows, keys).groupBy(*keys).agg(
        F.max("latest").alias("latest_year"),
        F.when(enough, F.avg(recent) - F.avg(ref)).alias("value"),
    )


def recent_vs_preindustrial(rows: DataFrame, offset: DataFrame, keys: list[str], **gates) -> DataFrame:
    """The same plus the last present model offset; no offset means no value."""
    last = offset.where(_v().isNotNull()).groupBy(*keys).agg(F.max_by("value", "year").alias("__offset"))
    return recent_vs_window(rows, keys, **gates).join(last, keys, "left").withColumn(
        "value", F.col("value") + F.col("__offset")
    ).drop("__offset")


def recent_vs_year(rows: DataFrame, keys: list[str], baseline_year: int, need_recent: int = 4) -> DataFrame:
    """Latest five-year mean minus the value of one year."""
    recent = F.when(_recent(), _v())
    at = F.max(F.when(F.col("year") == baseline_year, _v()))
    return _with_latest(rows, keys).groupBy(*keys).agg(
        F.max("latest").alias("latest_year"),
        F.when(F.count(recent) >= need_recent, F.avg(recent) - at).alias("value"),
    )


def trend_at_last(rows: DataFrame, keys: list[str], baseline_year: int) -> DataFrame:
    """Fitted value at the last year and at a baseline year on the axis."""
    fit = lambda x: intercept() + slope() * x
    on_axis = F.bool_or(F.col("year") == baseline_year)
    return rows.groupBy(*keys).agg(
        F.max("year").alias("last_year"),
        display_round(fit(F.max("year")), 1).alias("value"),
        F.when(on_axis, display_round(fit(F.lit(baseline_year)), 1)).alias("baseline_value"),
    ).withColumn("baseline_value", F.when(F.col("value").isNotNull(), F.col("baseline_value")))


def worst_stress_year(severe: DataFrame, moderate: DataFrame, keys: list[str]) -> DataFrame:
    """Year with most severe plus moderate days (first on ties), and how many.

    Keys without any present severe value have no data.
    """
    a = severe.select(*keys, "year", F.col("value").alias("s"))
    b = moderate.select(*keys, "year", F.col("value").alias("m"))
    zero = F.lit(0)
    total = F.coalesce("s", zero) + F.coalesce("m", zero)
    present = F.col("s").isNotNull() | F.col("m").isNotNull()
    rank = F.when(present, F.struct(total, -F.col("year")))
    joined = a.join(b, [*keys, "year"], "left")
    return joined.groupBy(*keys).agg(
        (F.count("s") > 0).alias("has_data"),
        F.max_by("year", rank).alias("worst_year"),
        F.rint(F.max(F.when(present, total)).cast("double")).alias("worst_days"),
    ).select(
        *keys, "has_data",
        F.when(F.col("has_data"), F.col("worst_year")).alias("worst_year"),
        F.when(F.col("has_data"), F.col("worst_days")).alias("worst_days"),
    )


def global_recent_delta(globe: DataFrame, baseline_year: int) -> DataFrame:
    """On the globe series: latest year is the last label; any recent value suffices."""
    at = F.max(F.when(F.col("year") == baseline_year, _v()))
    return _with_latest(globe, ["region_key"], finite=False).groupBy("region_key").agg(
        F.max("latest").alias("latest_year"),
        display_round(F.avg(F.when(_recent(), _v())) - at, 2).alias("value"),
    )


def global_last_value(globe: DataFrame) -> DataFrame:
    """Value at the last label, missing if that one is missing."""
    return globe.groupBy("region_key").agg(
        F.max("year").alias("period"),
        display_round(F.max_by(F.struct(_v().alias("v")), "year")["v"], 2).alias("value"),
    )


def first_last_mean(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Finite means of the first and last ``n`` positions."""
    p = Window.partitionBy(*keys)
    pos = F.row_number().over(p.orderBy("year"))
    back = F.row_number().over(p.orderBy(F.desc("year")))
    return rows.withColumns({"__p": pos, "__b": back}).groupBy(*keys).agg(
        F.avg(F.when(F.col("__p") <= n, _v())).alias("first_mean"),
        F.avg(F.when(F.col("__b") <= n, _v())).alias("last_mean"),
    )


def typical_extreme_month(rows: DataFrame, keys: list[str], extreme: str = "max", recent_years: int = 10) -> DataFrame:
    """Calendar month with the highest (lowest) mean over the last years of the axis."""
    latest = rows.withColumn("latest", F.max("year").over(Window.partitionBy(*keys)))
    months = latest.where((F.col("year") > F.col("latest") - recent_years) & _v().isNotNull()).groupBy(
        *keys, "month"
    ).agg(F.avg("value").alias("m"))
    # The first month wins a tie.
    pick = (
        F.max_by("month", F.struct("m", -F.col("month")))
        if extreme == "max" else F.min_by("month", F.struct("m", F.col("month")))
    )
    return months.groupBy(*keys).agg(
        pick.alias("month"), (F.max("m") if extreme == "max" else F.min("m")).alias("value")
    )


def seasonal_yearly_means(rows: DataFrame, keys: list[str], lat: str = "lat") -> DataFrame:
    """Winter means by calendar year: December counts with January of the same year."""
    north = F.col(lat) >= 0
    winter = (north & F.col("month").isin(12, 1, 2)) | (~north & F.col("month").isin(6, 7, 8))
    return rows.where(winter & _v().isNotNull()).groupBy(*keys, "year").agg(F.avg("value").alias("value"))


def trend_per_decade(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg((slope() * 10).alias("per_decade"))


def local_vs_global(local: DataFrame, globe_rate: DataFrame) -> DataFrame:
    """Ratio of trends and its verdict; ``globe_rate`` is one row."""
    g = F.col("global_rate")
    ratio = F.when(g != 0, F.round(F.col("per_decade") / g, 9))
    verdict = (
        F.when(ratio >= 1.15, "faster").when(ratio <= 0.85, "slower").otherwise("in step")
    )
    return local.join(F.broadcast(globe_rate.select(F.col("per_decade").alias("global_rate")))).where(
        F.col("per_decade").isNotNull() & g.isNotNull()
    ).withColumns({"ratio": ratio, "verdict": verdict})


def rainfall_change(rows: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Relative change between the first and last positions, in bands of five percent."""
    f, l = F.col("first_mean"), F.col("last_mean")
    pct = F.when(f != 0, F.round((l - f) / f * 100, 9)).otherwise(F.when(l.isNotNull(), F.lit(0.0)))
    ends = first_last_mean(rows, keys, n).where(f.isNotNull() & l.isNotNull())
    return ends.withColumn("change_pct", pct).withColumn(
        "verdict",
        F.when(F.col("change_pct") >= 5, "increased").when(F.col("change_pct") <= -5, "decreased").otherwise("stable"),
    )


def record_value(rows: DataFrame, keys: list[str], extreme: str = "max", label: str = "label") -> DataFrame:
    """Highest or lowest value ever with its label; the first wins ties."""
    here = rows.where(_v().isNotNull())
    if extreme == "max":
        first = F.struct(_v(), -F.col("pos"))
        return here.groupBy(*keys).agg(F.max("value").alias("value"), F.max_by(label, first).alias(label))
    return here.groupBy(*keys).agg(
        F.min("value").alias("value"), F.min_by(label, F.struct(_v(), F.col("pos"))).alias(label)
    )


def temperature_fact(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """A sentence on the trend with both units in ``[[C|F]]`` pairs."""
    ends = first_last_mean(rows, keys, 5)
    rate = trend_per_decade(rows, keys)
    span = rows.groupBy(*keys).agg(F.min("year").alias("since"))
    j = ends.join(rate, keys).join(span, keys).where(
        F.col("per_decade").isNotNull() & F.col("first_mean").isNotNull() & F.col("last_mean").isNotNull()
    )
    text = F.concat(
        F.lit("**"), F.col(label), F.lit("** has changed at "), both_units(F.col("per_decade"), 2, delta=True),
        F.lit(" per decade since "), F.col("since").cast("string"), F.lit(", from "),
        both_units(F.col("first_mean")), F.lit(" to "), both_units(F.col("last_mean")), F.lit("."),
    )
    return j.select(*keys, text.alias("fact"))


def _month_name(month: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), month - 1)


def _whole(value: Column) -> Column:
    return display_round(value, 0).cast("long").cast("string")


def extreme_month_fact(rows: DataFrame, keys: list[str], name: str, extreme: str = "max", recent_years: int = 10) -> DataFrame:
    """The usual extreme month of late, and the record with its month.  ``rows`` are monthly, ``label`` is YYYY-MM."""
    usual = typical_extreme_month(rows, keys, extreme, recent_years).withColumnsRenamed({"value": "usual"})
    record = record_value(rows, keys, extreme).withColumnRenamed("value", "record")
    at = _month_name(F.substring("label", 6, 2).cast("int"))
    text = F.concat(
        F.lit("In **"), F.col(name), F.lit("** " + ("hot" if extreme == "max" else "cold") + " months reach "),
        both_units(F.col("usual")), F.lit(", mostly in "), _month_name(F.col("month")), F.lit("; the record is "),
        both_units(F.col("record")), F.lit(" in "), at, F.lit(" "), F.substring("label", 1, 4), F.lit("."),
    )
    return usual.join(record, keys).select(*keys, text.alias("fact"))


def winter_fact(rows: DataFrame, keys: list[str], name: str, lat: str = "lat", n: int = 10) -> DataFrame:
    """How winters changed: stable below 0.05 degrees per decade, else warmer or colder."""
    years = seasonal_yearly_means(rows, keys, lat)
    season = rows.groupBy(*keys).agg(F.when(F.max(lat) >= 0, "December–February").otherwise("June–August").alias("season"))
    span = years.groupBy(*keys).agg(F.min("year").alias("since"), F.count(F.lit(1)).alias("n"))
    j = trend_per_decade(years, keys).join(first_last_mean(years, keys, n), keys).join(span, keys).join(season, keys)
    rate = F.col("per_decade")
    change = F.when(F.round(F.abs(rate), 9) < 0.05, F.lit("hardly changed")).otherwise(F.concat(
        F.when(rate > 0, F.lit("warmed by ")).otherwise(F.lit("cooled by ")), both_units(F.abs(rate), 2, delta=True), F.lit(" per decade")))
    text = F.concat(
        F.lit("Winters ("), F.col("season"), F.lit(") of **"), F.col(name), F.lit("** have "), change, F.lit(" since "),
        F.col("since").cast("string"), F.lit(": "), both_units(F.col("first_mean")), F.lit(" then, "), both_units(F.col("last_mean")), F.lit(" now."),
    )
    known = rate.isNotNull() & F.col("first_mean").isNotNull() & F.col("last_mean").isNotNull()
    return j.where((F.col("n") >= 2) & known).select(*keys, text.alias("fact"))


def ratio_fact(local: DataFrame, globe_rate: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A place's trend against the globe's."""
    verdict = F.when(F.col("verdict") == "faster", F.concat(
        display_round(F.col("ratio"), 1).cast("string"), F.lit(" times"))).when(
        F.col("verdict") == "slower", F.lit("less than")).otherwise(F.lit("about"))
    text = F.concat(
        F.lit("**"), F.col(name), F.lit("** changes by "), both_units(F.col("per_decade"), 2, delta=True), F.lit(" per decade, "), verdict,
        F.lit(" the global "), both_units(F.col("global_rate"), 2, delta=True), F.lit("."),
    )
    return local_vs_global(local, globe_rate).select(*keys, text.alias("fact"))


def rainfall_fact(rows: DataFrame, keys: list[str], name: str, n: int = 10) -> DataFrame:
    """Mean yearly total, its change in bands, and the totals at both ends."""
    mean = rows.groupBy(*keys).agg(F.avg(_v()).alias("mean"))
    size = F.abs(F.col("change_pct"))
    change = F.when(F.col("verdict") == "increased", F.concat(F.lit("grew by "), _whole(size), F.lit(" %"))).when(
        F.col("verdict") == "decreased", F.concat(F.lit("shrank by "), _whole(size), F.lit(" %"))).otherwise(F.lit("stayed about the same"))
    text = F.concat(
        F.lit("**"), F.col(name), F.lit("** gets "), _whole(F.col("mean")), F.lit(" mm a year; totals "), change, F.lit(", from "),
        _whole(F.col("first_mean")), F.lit(" to "), _whole(F.col("last_mean")), F.lit(" mm."),
    )
    return rainfall_change(rows, keys, n).join(mean, keys).select(*keys, text.alias("fact"))


def rank_fact(ranks: DataFrame, key: str) -> DataFrame:
    """Position of a point's nearest ranked city; ``ranks`` as :func:`gridloom.operators.points.rank_of_points` gives them."""
    text = F.concat(
        F.lit("Number "), F.col("rank").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" cities by warmth at "),
        both_units(F.col("value")), F.lit(", above "), _whole(F.col("share_below")), F.lit(" % of them."),
    )
    return ranks.select(key, text.alias("fact"))
