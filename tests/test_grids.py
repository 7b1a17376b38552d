import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import COARSE, Grid, cell_of, global_grid, snap_round, wrap_lon
from gridloom.operators import masks as M, raster as E, regions as RG, regrid as RGD

CELLS = "i_lat int, i_lon int, value double"


def table(df):
    return {(r.i_lat, r.i_lon): r.value for r in df.collect()}


def test_cells_at_the_edges(frame):
    p = frame("lat double, lon double", [(90.0, 0.0), (-90.0, 180.0), (89.9, -180.0), (None, 1.0)])
    out = p.select(*[c.alias(n) for n, c in cell_of(F.col("lat"), F.col("lon"), COARSE).items()]).collect()
    assert [tuple(r) for r in out] == [(0, 720), (719, 0), (0, 0), (None, 724)]
    assert COARSE.tile_counts == (12, 23) and global_grid(0.05).tile_counts == (57, 113)


def test_longitude_and_rounding(frame):
    lon = frame("x double", [(180.0,), (-181.0,), (540.5,), (-540.0,)]).select(wrap_lon(F.col("x")).alias("w"))
    assert [r.w for r in lon.collect()] == [-180.0, 179.0, -179.5, -180.0]
    s = frame("x double", [(2.5,), (3.5,), (-2.5,)]).select(snap_round(F.col("x"), 1.0).alias("s"))
    assert [r.s for r in s.collect()] == [2.0, 4.0, -2.0]


def test_stitch_dateline(frame):
    rows = lambda grid: frame(CELLS, [(r, c, v) for r, vs in enumerate(grid) for c, v in enumerate(vs)])
    out = table(E.stitch_dateline(rows([[0.0, 10.0, 20.0], [2.0, 12.0, 6.0]]), 3))
    assert out == {(0, 0): 10, (0, 1): 10, (0, 2): 10, (1, 0): 4, (1, 1): 12, (1, 2): 4}
    out = table(E.stitch_dateline(rows([[None, 1.0, 5.0], [3.0, 1.0, None], [None, 1.0, None]]), 3))
    assert [out[r, c] for r in range(3) for c in (0, 2)] == [5, 5, 3, 3, None, None]


def test_downsample_keeps_the_opaque_pixel(frame):
    px = frame("i_lat int, i_lon int, r int, g int, b int, a int",
               [(0, 0, 1, 1, 1, 0), (0, 1, 2, 2, 2, 0), (1, 0, 9, 8, 7, 255), (1, 1, 3, 3, 3, 0)])
    assert [tuple(r) for r in E.downsample_max_alpha(px).collect()] == [(0, 0, 9, 8, 7, 255)]


def test_scale_fallbacks(frame):
    scale = lambda vals, **k: tuple(E.resolve_scale(frame("value double", [(v,) for v in vals]), **k).first())
    vals = [float(v) for v in range(101)]
    assert scale(vals) == (pytest.approx(2.0), pytest.approx(98.0))
    assert scale(vals, vmin=5, vmax=5) == (0.0, 100.0)
    assert scale([7.0, 7.0]) == (6.0, 8.0)
    assert scale([None, None]) == (0.0, 1.0)


def test_palette(frame):
    df = frame("value double", [(None,), (0.0,), (0.5,), (2.0,)])
    rgba = E.palette(F.col("value"), F.lit(0.0), F.lit(1.0), ["#000000", "#ff0000", "#ffffff"], "#0a0b0c", 0.5)
    assert [tuple(r) for r in df.select(*rgba.values()).collect()] == [
        (10, 11, 12, 128), (0, 0, 0, 255), (255, 0, 0, 255), (255, 255, 255, 255)]


SRC = [(lat, lon, float(i + j)) for i, lat in enumerate((-1.0, 0.0, 1.0)) for j, lon in enumerate((-1.0, 0.0, 1.0))]


def small_grid(n):
    return Grid("toy", 1.0, n, n, lat_max=n / 2, lon_min=-n / 2)


def test_regrid_fills_only_outside(frame):
    out = table(RGD.regrid(frame("lat double, lon double, value double", SRC), small_grid(5)))
    assert len(out) == 25 and None not in out.values()
    assert out[0, 0] == 2.0 and out[4, 4] == 2.0


def test_regrid_of_two_source_grids(frame):
    """Each source grid keeps axes of its own, also when steps of time tell its rows apart."""
    fine = [(lat, lon, v) for lat, lon, v in SRC]
    coarse = [(lat + 0.37, lon + 0.21, v * 2) for lat, lon, v in SRC]
    rows = [(m, t, *r) for m, src in (("a", fine), ("b", coarse)) for t in (1, 2) for r in src]
    both = frame("m string, t int, lat double, lon double, value double", rows)
    for method in ("bilinear", "nearest"):
        alone = {m: table(RGD.regrid(frame("lat double, lon double, value double", src), small_grid(5), method))
                 for m, src in (("a", fine), ("b", coarse))}
        for grid_keys in (None, ["m"]):
            got = {}
            for r in RGD.regrid(both, small_grid(5), method, keys=["m", "t"], grid_keys=grid_keys).collect():
                got.setdefault((r.m, r.t), {})[r.i_lat, r.i_lon] = r.value
            assert got == {(m, t): alone[m] for m in "ab" for t in (1, 2)}


def test_regrid_with_stored_axes_reads_its_source_once(spark, frame, tmp_path):
    path = str(tmp_path / "src")
    frame("lat double, lon double, value double", SRC).write.parquet(path)
    src = spark.read.parquet(path)
    axes = spark.createDataFrame(RGD.source_axes(src).collect(), "axis string, x double")
    out = RGD.regrid(src, small_grid(5), axes=axes)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert table(out) == table(RGD.regrid(src, small_grid(5)))


def test_regrid_keeps_interior_gaps(frame):
    src = [(a, b, None if (a, b) == (0.0, 0.0) else v) for a, b, v in SRC]
    out = table(RGD.regrid(frame("lat double, lon double, value double", src), small_grid(3)))
    assert out[1, 1] is None


def test_regrid_matches_numpy(frame):
    rng = np.random.default_rng(5)
    lats, lons = np.sort(rng.uniform(-3, 3, 6)), np.sort(rng.uniform(-3, 3, 7))
    vals = rng.normal(size=(6, 7))
    src = frame("lat double, lon double, value double",
                [(float(a), float(b), float(vals[i, j])) for i, a in enumerate(lats) for j, b in enumerate(lons)])
    out = table(RGD.regrid(src, small_grid(6)))
    for (i, j), got in out.items():
        y, x = 3 - (i + 0.5), -3 + (j + 0.5)
        if lats[0] <= y <= lats[-1] and lons[0] <= x <= lons[-1]:
            by_lat = [np.interp(y, lats, vals[:, k]) for k in range(7)]
            assert got == pytest.approx(np.interp(x, lons, by_lat))
        else:
            assert got == vals[np.abs(lats - y).argmin(), np.abs(lons - x).argmin()]


def test_mercator_never_bridges_gaps(frame):
    g = Grid("m", 10.0, 18, 36)
    col = [(r, 0, float(r)) for r in range(18) if r not in (8, 9)] + [(5, 1, 3.0)]
    out = RGD.mercator_rows(frame(CELLS, col), g)
    got = {(r.row, r.i_lon): r.value for r in out.collect()}
    assert all(c == 0 for _, c in got) and got[0, 0] == pytest.approx(0.0)
    y = lambda lat: np.log(np.tan(np.pi / 4 + np.deg2rad(lat) / 2))
    lats = np.array([90 - (i + 0.5) * 10 for i in range(18)])
    kept = lats[np.abs(lats) <= 85.05112878]
    targets = np.linspace(y(kept[0]), y(kept[-1]), kept.size)
    gap = (targets < y(lats[7])) & (targets > y(lats[10]))
    assert {k for k in np.flatnonzero(gap)} & {r for r, _ in got} == set()


def test_masks(frame):
    fine, coarse = Grid("f", 0.05, 10, 10), Grid("c", 0.25, 2, 2)
    mask = frame("i_lat int, i_lon int, id int", [(0, 0, 1), (7, 7, 2)])
    assert {tuple(r) for r in M.coarsen_any(mask, fine, coarse).collect()} == {(0, 0), (1, 1)}
    with pytest.raises(ValueError):
        M.coarsen_any(mask, fine, Grid("c", 0.12, 2, 2))
    grown = {tuple(r) for r in M.dilate(frame("i_lat int, i_lon int", [(0, 0), (0, 9)]), fine, 1).collect()}
    assert grown == {(0, 0), (0, 1), (1, 0), (1, 1), (0, 8), (0, 9), (1, 8), (1, 9)}
    bad = M.coarse_check(frame("i_lat int, i_lon int", [(0, 0), (0, 1)]), mask, fine, coarse)
    assert {tuple(r) for r in bad.collect()} == {(0, 1, "extra"), (1, 1, "missing")}


def test_polygon_runs_match_point_in_polygon(frame):
    g = Grid("p", 1.0, 20, 40, lat_max=10, lon_min=-20)
    ring = [(-9.3, -4.2), (8.1, -6.7), (2.2, 1.1), (9.7, 7.3), (-7.9, 6.2), (-1.4, 0.3), (-9.3, -4.2)]
    hole = [(-1.2, 3.4), (2.7, 3.1), (2.9, 5.2), (-1.2, 3.4)]
    v = [(1, 1, k, i, x, y) for k, r in enumerate((ring, hole)) for i, (x, y) in enumerate(r)]
    out = RGD.polygon_to_cells(frame("feature_id int, feature_order int, ring int, seq int, lon double, lat double", v),
                               frame("feature_id int, id int", [(1, 7)]), g)
    got = {(r.i_lat, r.i_lon) for r in out.collect()}

    def inside(x, y):
        n = 0
        for r in (ring, hole):
            for (x1, y1), (x2, y2) in itertools.pairwise(r):
                if min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x:
                    n += 1
        return n % 2 == 1

    want = {(i, j) for i in range(20) for j in range(40) if inside(-20 + j + 0.5, 10 - i - 0.5)}
    assert got == want and len(want) > 50


def test_region_aggregates_by_hand(frame):
    g = Grid("r", 20.0, 9, 18)
    w = frame("region_key string, i_lat int, i_lon int, frac double", [("a", 4, 0, 1.0), ("a", 3, 0, 0.5), ("b", 4, 1, 0.25)])
    cells = frame("i_lat int, i_lon int, year int, value double",
                  [(4, 0, 2000, 10.0), (3, 0, 2000, 4.0), (4, 1, 2000, None), (4, 0, 2001, None), (3, 0, 2001, None), (4, 1, 2001, 8.0)])
    out = {(r.region_key, r.year): (r.mean, r.min, r.max) for r in RG.region_aggregates(cells, w, g).collect()}
    c = np.cos(np.deg2rad(20))
    assert out["a", 2000] == (pytest.approx((10 + 4 * 0.5 * c) / (1 + 0.5 * c), abs=1e-4), 4.0, 10.0)
    assert out["a", 2001] == (None, None, None) and out["b", 2001] == (8.0, 8.0, 8.0) and out["b", 2000][0] is None
    assert out["globe", 2000][0] == pytest.approx((10 + 4 * c) / (1 + c), abs=1e-4)


def test_fraction_days_at_the_threshold(frame):
    import datetime as dt

    day = lambda d, vals: [(0, i, dt.date(2001, 1, d), v) for i, v in enumerate(vals)]
    obs = frame("i_lat int, i_lon int, t date, value double",
                day(1, [9.0, 5.0, 1.0, None]) + day(2, [5.0, 1.0, 1.0, 1.0]) + day(3, [None] * 4))
    out = {(r.year, r.threshold): (r.no_risk_days, r.moderate_days, r.severe_days)
           for r in RG.fraction_days(obs, [25, 50], (2000, 2001)).collect()}
    assert out[2001, 25.0] == (0, 1, 1) and out[2001, 50.0] == (1, 1, 0)
    assert out[2000, 25.0] == (None, None, None)


def test_ranking_blocks_keys_and_breaks_ties(frame):
    g = Grid("k", 1.0, 180, 360)
    P = "geonameid long, label string, country_code string, lat double, lon double, population long, capital boolean"
    places = frame(P, [(1, "big", "A", 10.6, 10.6, 9000, True), (2, "same key", "A", 10.61, 10.61, 8000, False),
                       (3, "c", "B", 20.5, 20.5, 7000, False), (4, "d", "B", 30.5, 30.5, 7500, False), (5, "tiny", "B", 40.5, 40.5, 10, False)])
    cell = lambda lat, lon: (int(90 - lat), int(lon + 180))
    annual = frame("i_lat int, i_lon int, year int, value double",
                   [(*cell(20.5, 20.5), y, 5.0) for y in (2000, 2001)] + [(*cell(30.5, 30.5), y, 5.0) for y in (2000, 2001)]
                   + [(*cell(10.6, 10.6), y, None) for y in (2000, 2001)])
    out = [(r.geonameid, r.rank) for r in RG.city_rankings(places, annual, g, "mean").orderBy("rank").collect()]
    assert out == [(4, 1), (3, 2)]


def test_rasters_of_several_keys_stay_apart(frame):
    """One run over two rasters gives what two runs give."""
    grid = Grid("g", 10.0, 18, 36, tile_size=16)
    one = [(i, j, None if (i + j) % 7 == 0 else float(i * j % 11)) for i in range(18) for j in range(36)]
    two = [(i, j, float((i + 3 * j) % 5) * 10) for i in range(18) for j in range(36)]
    both = frame("m string, " + CELLS, [("a", *r) for r in one] + [("b", *r) for r in two])
    runs = {
        "scale": lambda df, **k: E.resolve_scale(df, **k), "stitch": lambda df, **k: E.stitch_dateline(df, 36, **k),
        "rows": lambda df, **k: RGD.mercator_rows(df, grid, **k), "stats": lambda df, **k: E.map_stats(df, 648, **k),
        "half": lambda df, **k: E.downsample_max_alpha(df.selectExpr("*", *[f"coalesce(int(value), 0) AS {c}" for c in "rgba"]), **k),
    }
    for run in runs.values():
        alone = {(m, *r) for m, rows in (("a", one), ("b", two)) for r in map(tuple, run(frame(CELLS, rows)).collect())}
        assert {tuple(r) for r in run(both, keys=["m"]).collect()} == alone
