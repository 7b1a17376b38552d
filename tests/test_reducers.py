import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.contract import CELL, missing_to_null
from gridloom.functions import calendar as cal
from gridloom.operators import percell as D, reducers as R

OBS = "i_lat int, i_lon int, t date, value double"


def daily(values, start, cell=(0, 0)):
    d0 = dt.date.fromisoformat(start)
    return [(*cell, d0 + dt.timedelta(days=i), v) for i, v in enumerate(values)]


def by_year(df, col="value"):
    return {r["year"]: r[col] for r in df.collect()}


def test_nan_and_infinity_become_missing(frame):
    df = missing_to_null(frame("value double", [(float("nan"),), (float("inf"),), (-999.0,), (1.5,)]), fill=-999)
    assert [r.value for r in df.collect()] == [None, None, None, 1.5]


@pytest.mark.parametrize("how,want", [("mean", [2, 6]), ("sum", [4, 12]), ("max", [3, 7])])
def test_annual_group(frame, how, want):
    rows = [(0, 0, dt.date(y, m, 1), float(v)) for y, m, v in [(2020, 1, 1), (2020, 7, 3), (2021, 1, 5), (2021, 7, 7)]]
    got = by_year(R.annual_group(frame(OBS, rows), how))
    assert [got[2020], got[2021]] == want
    with pytest.raises(ValueError):
        R.annual_group(frame(OBS, rows), "median")


def test_mean_of_monthly_means_differs_from_mean_of_days(frame):
    rows = daily([0.0] * 31, "2021-01-01") + daily([10.0], "2021-02-01")
    obs = frame(OBS, rows)
    assert by_year(R.annual_mean_from_daily(obs))[2021] == 5.0
    assert by_year(R.annual_group(obs, "mean"))[2021] == pytest.approx(10 / 32)


def test_dry_runs(frame):
    y = [2.0] * 365
    y[0:3], y[3], y[4:8] = [0.0] * 3, 5.0, [0.0] * 4
    assert by_year(R.longest_dry_run(frame(OBS, daily(y, "2021-01-01")))) == {2021: 4}
    assert by_year(R.longest_dry_run(frame(OBS, daily([5.0] * 365, "2021-01-01")))) == {2021: 0}
    assert by_year(R.longest_dry_run(frame(OBS, daily([0.0] * 365, "2021-01-01")))) == {2021: 365}
    assert by_year(R.longest_dry_run(frame(OBS, daily([None] * 365, "2021-01-01")))) == {2021: None}


def test_dry_run_stops_at_year_edge_and_gap(frame):
    two = [2.0] * 731
    two[361:366], two[366:369] = [0.0] * 5, [0.0] * 3
    assert by_year(R.longest_dry_run(frame(OBS, daily(two, "2000-01-01")))) == {2000: 5, 2001: 3}
    gap = [0.0, 0.0, None, 0.0, 9.0]
    assert by_year(R.longest_dry_run(frame(OBS, daily(gap, "2001-01-01")))) == {2001: 2}


def test_heat_stress(frame):
    series = {(0, 0): [0, 5, 9, 3], (0, 1): [None, 6, None, 8], (1, 0): [None] * 4, (1, 1): [2, 2, 2, 2]}
    days = [dt.date(1985, 1, 1), dt.date(1985, 1, 2), dt.date(1986, 1, 1), dt.date(1986, 1, 2)]
    rows = [(*c, d, None if v is None else float(v)) for c, vs in series.items() for d, v in zip(days, vs)]
    out = {(r.i_lat, r.i_lon, r.year): r for r in R.heat_stress_years(frame(OBS, rows)).collect()}
    pick = lambda r: (r.no_risk_days, r.moderate_days, r.severe_days, r.risk_score)
    assert pick(out[0, 0, 1985]) == (1, 1, 0, 1) and pick(out[0, 0, 1986]) == (1, 0, 1, 2)
    assert pick(out[0, 1, 1985]) == (0, 1, 0, 1) and pick(out[0, 1, 1986]) == (0, 0, 1, 2)
    assert pick(out[1, 0, 1985]) == (None,) * 4 and out[1, 0, 1985].max_value is None
    assert [out[0, 0, y].max_value for y in (1985, 1986)] == [5, 9]


def test_hot_days_keep_leap_year_numbering(frame):
    # 1 March is day 60 in the base year but 61 in the leap year, so it meets the limit of 2 March.
    rows = [(0, 0, dt.date(2019, 3, 1), 10.0), (0, 0, dt.date(2019, 3, 2), 20.0), (0, 0, dt.date(2020, 2, 29), 99.0),
            (0, 0, dt.date(2020, 3, 1), 15.0), (0, 0, dt.date(2020, 12, 31), 50.0)]
    got = by_year(R.hot_days(frame(OBS, rows), baseline_years=1, percentile=90))
    assert got == {2019: 0, 2020: 0}  # below day 61's limit; day 366 has none


def test_hot_days_percentile_is_exact(frame):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 40, (6, 30)).astype(float)
    rows = [(0, 0, dt.date(2001 + y, 1, 1 + d), float(vals[y, d])) for y in range(6) for d in range(30)]
    limit = np.quantile(vals[:4], 0.9, axis=0)
    want = {2001 + y: int((vals[y] > limit).sum()) for y in range(6)}
    assert by_year(R.hot_days(frame(OBS, rows), baseline_years=4)) == want


def test_hot_days_against_stored_limits(spark, frame, tmp_path):
    """Years counted on their own, against stored limits, are the years of the whole count; the baseline stays unread."""
    rng = np.random.default_rng(8)
    day = lambda y, d: dt.date(y, 1, 1) + dt.timedelta(days=int(d))
    rows = [(c, 0, day(y, d), None if rng.random() < 0.1 else float(rng.integers(0, 30)))
            for c in range(3) for y in range(2001, 2009) for d in rng.choice(366 if y in (2004, 2008) else 365, 120, replace=False)]
    rows += [(9, 0, day(2007, 5), 3.0), (10, 0, day(2007, 6), None)]  # cells that the baseline does not have
    base, new = [r for r in rows if r[2].year <= 2004], [r for r in rows if r[2].year > 2004]
    R.day_limits(frame(OBS, base), 75).write.parquet(f"{tmp_path}/limits")
    got = R.hot_days_against(frame(OBS, new), spark.read.parquet(f"{tmp_path}/limits")).collect()
    want = R.hot_days(frame(OBS, rows), baseline_years=4, percentile=75).where("year > 2004").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(got) == 14


def test_window_and_climatology_months(frame):
    june = frame("t date", [(dt.date(2026, 6, d),) for d in range(1, 31)])
    assert june.where(cal.in_window(F.col("t"), "2026-06-23", "2026-06-25")).count() == 3
    assert june.where(cal.in_window(F.col("t"), "2027-06-23", "2027-06-25")).count() == 0
    months = frame("y int, m int", [(y, m) for y in range(1989, 2023) for m in range(1, 13)])
    assert months.where(cal.in_climatology(F.col("y"), F.col("m"), 6, 1991, 2020)).count() == 30


@pytest.mark.parametrize("s,e,lo,hi,want", [
    (2000, 2000, 1990, 2010, (1999, 2001)), (2000, 2001, 1990, 2010, (2000, 2002)), (2010, 2010, 1990, 2010, (2008, 2010)),
    (1990, 1990, 1990, 2010, (1990, 1992)), (2009, 2010, 1990, 2010, (2008, 2010)), (2000, 2000, 2000, 2000, (2000, 2000)),
    (1995, 1999, 1990, 2010, (1995, 1999)),
])
def test_widen_range(frame, s, e, lo, hi, want):
    row = frame("s int, e int, lo int, hi int", [(s, e, lo, hi)])
    a, b = cal.widen_range(*[F.col(c) for c in ("s", "e", "lo", "hi")])
    assert tuple(row.select(a, b).first()) == want


def test_widen_range_can_start_before(frame):
    row = frame("s int, e int, lo int, hi int", [(2000, 2001, 1990, 2010), (1990, 1991, 1990, 2010), (2000, 2000, 1990, 2010)])
    a, b = cal.widen_range(*[F.col(c) for c in ("s", "e", "lo", "hi")], side="before")
    assert [tuple(r) for r in row.select(a, b).collect()] == [(1999, 2001), (1990, 1992), (1999, 2001)]


def monthly(frame, other=20.0):
    rows = []
    for y in range(1991, 2027):
        for m in range(1, 13):
            if (y, m) > (2026, 6):
                continue
            v = 24.0 if (y, m) == (2026, 6) else (other if 2021 <= y <= 2025 and m == 6 else 20.0)
            rows += [(0, 0, dt.date(y, m, 1), v), (1, 1, dt.date(y, m, 1), None)]
    return frame(OBS, rows)


@pytest.mark.parametrize("other", [20.0, 100.0])
def test_monthly_climatology_anomaly(frame, other):
    out = D.monthly_climatology_anomaly(monthly(frame, other), 2026, 6, 1991, 2020)
    assert {(r.i_lat, r.i_lon): r.value for r in out.collect()} == {(0, 0): 4.0, (1, 1): None}


def test_trend_estimators_agree_only_without_gaps(frame):
    rng = np.random.default_rng(7)
    years = np.arange(2000, 2021)
    full, gappy = rng.normal(size=21).cumsum(), rng.normal(size=21).cumsum()
    gappy[[0, 1, 5, 6, 7, 19]] = np.nan
    rows = [(0, 0, int(y), float(v)) for y, v in zip(years, full)]
    rows += [(0, 1, int(y), None if np.isnan(v) else float(v)) for y, v in zip(years, gappy)]
    rows += [(0, 2, int(y), None) for y in years]
    a = frame("i_lat int, i_lon int, year int, value double", rows)
    ols = {r.i_lon: r.value for r in D.trend_slope(a).collect()}
    cent = {r.i_lon: r.value for r in D.trend_slope_per_decade(a).collect()}
    ok = ~np.isnan(gappy)
    x = years - years.mean()
    want = 10 * (x[ok] * (gappy[ok] - gappy[ok].mean())).sum() / (x[ok] ** 2).sum()
    assert ols[0] == pytest.approx(np.polyfit(years, full, 1)[0])
    assert cent[0] == pytest.approx(10 * ols[0])
    assert ols[1] == pytest.approx(np.polyfit(years[ok], gappy[ok], 1)[0])
    assert cent[1] == pytest.approx(want) and abs(cent[1] - 10 * ols[1]) > 1e-6
    assert ols[2] is None and cent[2] is None


def test_rolling_means(frame):
    s = frame("k int, pos int, value double, mean double", [(0, i, None if i == 3 else float(i), None) for i in range(7)])
    even = {r.pos: r.rolling for r in D.rolling_mean_centered(s, ["k"], 4).collect()}
    assert even == {0: None, 1: None, 2: pytest.approx(7 / 4), 3: pytest.approx(3.0), 4: pytest.approx(17 / 4), 5: None, 6: None}
    edge = {r.pos: r.rolling for r in D.rolling_mean_min_periods(s, ["k"], 5).collect()}
    assert edge[0] == pytest.approx(1.0) and edge[6] == pytest.approx(5.0)
    strict = {r.pos: r.rolling for r in D.rolling_mean_min_periods(s, ["k"], 3, unit="days").collect()}
    assert strict[0] is None and strict[1] == pytest.approx(1.0) and strict[3] is None


def test_derived_metrics_wait_for_inputs(frame):
    base = frame("i_lat int, i_lon int, value double", [(0, 0, 3.0)])
    plus = lambda d: d.withColumn("value", F.col("value") + 1)
    out, skipped = D.derive_metrics({"a": base}, {"c": (["b"], plus), "b": (["a"], plus), "x": (["gone"], plus)})
    assert {r.metric_id: r.value for r in out.collect()} == {"b": 4.0, "c": 5.0}
    assert skipped == {"x": "missing input: gone"}


def test_guards(frame):
    year = frame(OBS, daily([1.0] * 365, "2021-01-01"))
    assert R.require_complete_end(year) is year
    with pytest.raises(ValueError):
        R.require_complete_end(frame(OBS, daily([1.0] * 300, "2021-01-01")))
    annual = R.annual_sum(year)
    for bad in (lambda: R.climatology_mean(annual, 1990, 1995), lambda: R.concat_blocks([annual], 1990, 1995),
                lambda: D.at_year(annual, 1990), lambda: D.mean_between(annual, 2021, 2022),
                lambda: D.monthly_climatology_anomaly(year, 2022, 6, 2021, 2021),
                lambda: D.mean_over_positions(year, year, F.year("t") == 1990), lambda: D.reduce_map(annual, "median")):
        with pytest.raises(ValueError):
            bad()
    assert R.select_years(annual, [1850]).count() == 1
    assert D.reduce_map(annual).first().value == 365.0 and D.reduce_map(annual, "year", year=2021).count() == 1
