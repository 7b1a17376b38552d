import random

import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import headlines as I, points as H
from gridloom.operators.similar import nearest_on_line, similar_locations

YEARLY = "k int, year int, value double"
MONTHLY = "k int, year int, month int, pos int, value double"


def months(frame, fn, y0, y1):
    rows = [(0, y, m, (y - y0) * 12 + m - 1, fn(y, m)) for y in range(y0, y1 + 1) for m in range(1, 13)]
    return frame(MONTHLY, rows)


def test_typical_extreme_month(frame):
    df = months(frame, lambda y, m: 25.0 if m == 7 else 20.0, 2016, 2025)
    r = I.typical_extreme_month(df, ["k"]).first()
    assert (r.value, r.month) == (25.0, 7)


def test_seasonal_means_group_by_calendar_year(frame):
    df = months(frame, lambda y, m: 10.0 if m in (6, 7, 8) else 0.0, 2020, 2021).withColumn("lat", F.lit(-5.0))
    assert [r.value for r in I.seasonal_yearly_means(df, ["k"]).collect()] == [10.0, 10.0]


def test_trend_at_last(frame):
    rows = [(0, y, 5 + 5 * (y - 1979) / 44) for y in range(1979, 2024)] + [(1, 2000, 1.0), (1, 2001, None)]
    got = {r.k: r for r in I.trend_at_last(frame(YEARLY, rows), ["k"], 1979).collect()}
    assert got[0].value == 10.0 and got[0].baseline_value == 5.0
    assert got[1].value is None and got[1].baseline_value is None


def test_worst_stress_year(frame):
    ys = range(1985, 2024)
    sev = frame(YEARLY, [(0, y, 10.0 if y == 1990 else 0.0) for y in ys] + [(1, y, None) for y in ys])
    mod = frame(YEARLY, [(0, y, 15.0 if y == 1990 else 0.0) for y in ys] + [(1, y, 3.0) for y in ys])
    got = {r.k: (r.has_data, r.worst_year, r.worst_days) for r in I.worst_stress_year(sev, mod, ["k"]).collect()}
    assert got == {0: (True, 1990, 25.0), 1: (False, None, None)}


def test_recent_gates(frame):
    rows = [(0, y, float(y)) for y in range(1979, 2024)] + [(1, y, float(y)) for y in range(1995, 2024)] + [(2, y, None) for y in (1, 2)]
    got = {r.k: r.value for r in I.recent_vs_window(frame(YEARLY, rows), ["k"]).collect()}
    assert got == {0: pytest.approx(2021 - 1989.5), 1: None, 2: None}


@pytest.mark.parametrize("n,collapsed", [(120, False), (121, True)])
def test_collapse_at_the_limit(frame, n, collapsed):
    rows = [(0, 2000 + i // 12, i % 12 + 1, i, float((i * 7) % 50)) for i in range(n)]
    out = H.collapse_long(frame(MONTHLY, rows), ["k"]).collect()
    assert len(out) == (11 if collapsed else n) and all(r.collapsed == collapsed for r in out)
    vals = [r[4] for r in rows]
    assert out[0].max_value == max(vals) and out[0].max_pos == vals.index(max(vals)) and out[0].min_pos == vals.index(min(vals))


def test_axis_repair(frame):
    df = frame("v array<double>, a array<string>", [
        ([1.0, 2.0], ["2000", "2001"]), ([1.0, 2.0, 3.0], ["2001"]), ([1.0], ["2000-01", "2000-02"]), ([1.0, 2.0], ["2000-01"]), ([1.0], [])])
    got = [r[0] for r in df.select(H.repaired_labels(F.col("v"), F.col("a"))).collect()]
    assert got == [["2000", "2001"], ["1999", "2000", "2001"], ["2000-02"], ["1979", "1980"], ["1979"]]


def test_extremes_score_collapsed_means(frame):
    from gridloom.grid import Grid

    g = Grid("g", 90.0, 2, 4)
    cities = frame("geonameid long, label string, alt_names string, lat double, lon double, population long",
                   [(1, "spiky", "", 10.0, 10.0, 5000), (2, "steady", "", -10.0, 10.0, 6000)])
    rows = []
    for y in range(2000, 2011):
        for m in range(1, 13):
            rows.append((0, 2, y, m, 100.0 if (y, m) == (2005, 5) else 0.0))
            rows.append((1, 2, y, m, 20.0))
    s = frame("i_lat int, i_lon int, year int, month int, value double", rows)
    top = lambda **k: H.extreme_locations(cities, s, g, "max", "max", 1, monthly=True, **k).first()
    assert top().label == "steady"
    native = top(collapse=False)
    assert (native.label, native.value, native.year) == ("spiky", 100.0, 2005)
    with pytest.raises(ValueError):
        H.extreme_locations(cities, s, g, "trend_slope", monthly=True)


def test_sources_of_derived_metrics():
    from gridloom.operators.panels import dataset_sources

    metrics = {
        "obs": {"dataset": "d1", "provider": "era"}, "mean": {"inputs": ["obs"]}, "trend": {"inputs": ["mean", "other"]},
        "bare": {}, "lost": {"inputs": ["bare", "obs"]}, "far": {"inputs": ["nowhere"]}, "self": {"inputs": ["self", "obs"]},
        "ring1": {"inputs": ["ring2"]}, "ring2": {"inputs": ["ring1", "obs"]}, "loop": {"inputs": ["loop"]},
    }
    got = dataset_sources(metrics)
    assert {k for k, v in got.items() if v == ("d1", "ERA")} == {"obs", "mean", "trend", "self", "ring1", "ring2"}
    assert {k for k, v in got.items() if v == (None, None)} == {"bare", "lost", "far", "loop"}


def test_several_references_are_all_answered(frame):
    places = frame("geonameid long, label string, lat double, lon double, population long",
                   [(i, f"p{i}", 10.5 + i, 20.5, 200_000 + i) for i in range(6)])
    s = frame("i_lat int, i_lon int, year int, value double",
              [(79 - i, 200, y, float(i * i) + 0.0004) for i in range(6) for y in (2000, 2001)])
    refs = frame("reference string, lat double, lon double", [("x", 10.5, 20.5), ("y", 14.5, 20.5), ("none", -80.0, 0.0)])
    grid = Grid("g", 1.0, 180, 360, tile_size=16)
    got = similar_locations(places, refs, s, grid, limit=2, target="F").orderBy("reference", "rank").collect()
    assert [(r.reference, r["rank"], r.geonameid) for r in got] == [("x", 1, 1), ("x", 2, 2), ("y", 1, 3), ("y", 2, 5)]
    assert [(r.value, r.delta, r.reference_mean, r.unit) for r in got][:1] == [(33.8, 1.8, 32.0, "F")]


def test_chart_rows_read_their_input_once(spark, tmp_path):
    """Three series of one metric and one of another come from a single scan."""
    from gridloom.operators import panels as P

    path = str(tmp_path / "rows")
    spark.range(40).selectExpr("id % 2 AS point_id", "if(id % 4 < 2, 'a', 'b') AS metric_id", "cast(id AS int) AS x", "cast(id * 2 AS double) AS value").write.parquet(path)
    specs = [("g", {"metric": "a"}), ("g", {"metric": "a", "transform": {"fn": "rolling_mean", "params": {"window": 3}}}),
             ("g", {"metric": "a", "key": "line", "transform": {"fn": "linear_trend_line", "params": {"extend_to": 99}}}), ("h", {"metric": "b"})]
    out = P._chart_rows(spark.read.parquet(path), ["point_id"], specs, "mm", "graph_id")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = {(r.point_id, r.series_key, r.x): r.y for r in out.collect()}
    assert rows[0, "a", 4] == 8.0 and rows[0, "a_rolling_mean", 4] == 8.0 and rows[0, "a_rolling_mean", 0] is None
    assert abs(rows[0, "line", 99] - 198.0) < 1e-9 and rows[1, "b", 3] == 6.0
    assert {k[1] for k in rows} == {"a", "a_rolling_mean", "line", "b"}


def brute_nearest(points, asked, limit, box):
    out = set()
    for lat, lon, level in set(asked):
        away = [(round(abs(p[4] - level), 9), -p[1], p[0]) for p in points if not (abs(p[2] - lat) < box and abs(p[3] - lon) < box)]
        out |= {(lat, lon, n, i) for n, (_, _, i) in enumerate(sorted(away)[:limit], 1)}
    return out


@pytest.mark.parametrize("levels", [3, 40, 10**6])
def test_nearest_on_a_line_matches_brute_force(spark, frame, levels):
    """Crowded spots, hot and equal levels, places around the reference that do not count."""
    rng = random.Random(levels)
    spot = lambda: rng.choice([(10.0, 10.0), (10.05, 10.05), (round(rng.uniform(0, 2), 2), round(rng.uniform(0, 2), 2)), (-0.06, 0.13)])
    points = []
    for i in range(700):
        lat, lon = spot()
        points.append((i, rng.randrange(5), lat, lon, round(rng.randrange(levels) / 7, 9)))
    asked = [(p[2], p[3], p[4]) for p in points[::2]] + [(50.0, 50.0, -3.5), (50.0, 50.0, 1e9), (1.0, 1.0, 0.123456789)]
    df = frame("id long, weight long, lat double, lon double, level double", points)
    got = nearest_on_line(df, frame("lat double, lon double, level double", asked), 4, 0.13)
    rows = [(r.r_lat, r.r_lon, r.r_level, r["rank"], r.id) for r in got.collect()]
    want = set()
    for lat, lon, level in set(asked):
        want |= {(lat, lon, level, n, i) for _, _, n, i in brute_nearest(points, [(lat, lon, level)], 4, 0.13)}
    assert set(rows) == want and len(rows) == len(want)


def test_nearest_on_a_line_has_no_join_without_a_key(spark, frame):
    df = frame("id long, weight long, lat double, lon double, level double", [(i, 1, i / 7, 0.0, i / 3) for i in range(50)])
    plan = nearest_on_line(df, df.select("lat", "lon", "level"), 3, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert nearest_on_line(df.limit(0), df.select("lat", "lon", "level"), 3, 0.1).count() == 0
    assert nearest_on_line(df, df.select("lat", "lon", "level").limit(0), 3, 0.1).count() == 0
