import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import quality as Q
from gridloom.sources import readers, series as S, tile_archive as TA


def blob(values, code=1, dtype="<f4", steps=None):
    values = np.asarray(values)
    h, w = values.shape[:2]
    n = 0 if values.ndim == 2 else values.shape[2]
    return struct.pack(TA.HEADER, TA.MAGIC, TA.VERSION, code, 0, n if steps is None else steps, h, w) + values.astype(dtype).tobytes()


def test_tile_files(spark, tmp_path):
    import zstandard

    grid = Grid("g", 1.0, 3, 3, tile_size=2)
    root = tmp_path / "g" / "heat" / "z2"
    root.mkdir(parents=True)
    nan = np.nan
    (root / "r000_c000.bin").write_bytes(blob([[[1, nan], [nan, nan]], [[2, 3], [4, 5]]]))
    (root / "r001_c001.bin.zst").write_bytes(zstandard.ZstdCompressor().compress(blob([[[9, 8], [7, 7]], [[6, 6], [5, 5]]])))
    scalar = tmp_path / "g" / "mask" / "z2"
    scalar.mkdir(parents=True)
    (scalar / "r000_c001.bin").write_bytes(blob([[3, 4], [0, 1]], code=2, dtype="<u2"))
    out = {(r.metric_id, r.i_lat, r.i_lon): r.values_ for r in TA.ingest(spark, str(tmp_path), grid).withColumnRenamed("values", "values_").collect()}
    assert out == {("heat", 0, 0): [1, None], ("heat", 1, 0): [2, 3], ("heat", 1, 1): [4, 5], ("heat", 2, 2): [9, 8],
                   ("mask", 0, 2): [3], ("mask", 1, 2): [0]}


def test_bad_tile_fails(spark, tmp_path):
    root = tmp_path / "g" / "m" / "z2"
    root.mkdir(parents=True)
    (root / "r000_c000.bin").write_bytes(blob([[[1.0]]])[:-1])
    with pytest.raises(Exception, match="wrong size"):
        TA.ingest(spark, str(tmp_path), Grid("g", 1.0, 2, 2, tile_size=2)).collect()


def test_series_resume_and_pruning(spark, frame, tmp_path):
    cols = "metric_id string, grid_id string, tile_r int, tile_c int, i_lat int, i_lon int, values array<double>"
    a = frame(cols, [("m", "g", 0, 0, 0, 0, [1.0]), ("m", "g", 1, 0, 2, 0, [2.0])])
    b = frame(cols, [("m", "g", 0, 0, 0, 0, [9.0]), ("m", "g", 0, 0, 0, 1, [3.0]), ("n", "g", 0, 0, 0, 0, [4.0])])
    path = str(tmp_path / "series")
    S.write_series(a, path)
    S.write_series(b, path, resume=True)
    got = {(r.metric_id, r.i_lat, r.i_lon): r["values"][0] for r in spark.read.parquet(path).collect()}
    assert got == {("m", 0, 0): 1.0, ("m", 2, 0): 2.0, ("m", 0, 1): 3.0, ("n", 0, 0): 4.0}
    plan = S.scan_series(spark, path, "m", [1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_places_keep_the_code_na(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("geonameid,label,city_name,country_name,country_code,lat,lon,population,capital,feature_code,alt_names\n"
                 '7,"Windhoek, Namibia",Windhoek,Namibia,NA,-22.5,17.0,325858.0,TRUE,PPLC,"a,b"\n,x,,,,,,,,,\n')
    r = {x.label: x for x in readers.read_places(spark, str(f)).collect()}
    assert (r["Windhoek, Namibia"].country_code, r["Windhoek, Namibia"].population, r["Windhoek, Namibia"].capital) == ("NA", 325858, True)
    assert (r["x"].geonameid, r["x"].lat, r["x"].country_code, r["x"].capital) == (0, 0.0, "", False)


def test_units_row_in_every_file(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text(f"time,sst\nUTC,degree_C\n2020-01-0{i + 1}T12:00:00Z,{i}.5\n")
    out = readers.read_with_units_row(spark, str(tmp_path), {"time": "timestamp", "sst": "double"})
    assert sorted(r.sst for r in out.collect()) == [0.5, 1.5]


def test_a_corrupt_time_is_no_units_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,sst\nUTC,degree_C\n2020-01-01T12:00:00Z,1.5\n2020-13-01,2.5\n2020-01-03T12:00:00Z,3.5\n")
    out = readers.read_with_units_row(spark, str(tmp_path), {"time": "timestamp", "sst": "double"}).collect()
    assert sorted(r.sst for r in out) == [1.5, 2.5, 3.5] and sum(r.time is None for r in out) == 1


def test_one_tile_written_again_leaves_its_siblings(spark, frame, tmp_path):
    cols = "metric_id string, grid_id string, tile_r int, tile_c int, i_lat int, i_lon int, values array<double>"
    path = str(tmp_path / "series")
    S.write_series(frame(cols, [("m", "g", 0, 0, 0, 0, [1.0]), ("m", "g", 0, 1, 0, 9, [2.0])]), path)
    S.write_series(frame(cols, [("m", "g", 0, 1, 0, 9, [0.1])]), path)
    got = {r.i_lon: r["values"][0] for r in S.scan_series(spark, path, "m").collect()}
    assert got[0] == 1.0 and abs(got[9] - 0.1) < 1e-7
    assert dict(spark.read.parquet(path).dtypes)["values"] == "array<float>"


def test_long_series_pack_in_linear_time(spark):
    import time

    from gridloom.grid import Grid

    axis = spark.range(17_000).select(F.col("id").cast("int").alias("pos"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("t"))
    cells = spark.range(40).select((F.col("id") % 2).cast("int").alias("i_lat"), F.col("id").cast("int").alias("i_lon"))
    long = cells.crossJoin(axis.where("pos % 3 <> 0")).select("i_lat", "i_lon", "t", F.col("pos").cast("double").alias("value"))
    packed = S.pack_series(long, axis, "m", Grid("g", 1.0, 180, 360, tile_size=16))
    t0 = time.time()
    row = packed.orderBy("i_lon").first()
    assert row["values"][:4] == [None, 1.0, 2.0, None] and len(row["values"]) == 17_000
    assert time.time() - t0 < 40 * 0.5


def test_variable_choice():
    assert readers.data_variable(["lat", "lon", "time", "a", "b"], "a") == "a"
    assert readers.data_variable(["lat", "lon", "time", "tas", "time_bnds"]) == "tas"
    assert readers.data_variable(["lat", "lon", "x1", "y1"], "none", ["y1"]) == "y1"
    with pytest.raises(ValueError):
        readers.data_variable(["lat", "lon", "a", "b"])


def test_prints_of_tiles_add_up(spark, frame):
    """Order, partitions and rewritten tiles: sums follow, and only differing tiles are named."""
    rng = np.random.default_rng(2)
    schema = "metric_id string, tile_r int, tile_c int, i_lat int, i_lon int, values array<double>"
    rows = [(m, i // 4, j // 4, i, j, [float(x) if x > 2 else None for x in rng.integers(0, 9, 5)]) for m in "ab" for i in range(12) for j in range(8)]
    old = Q.tile_prints(frame(schema, rows))
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, Q.tile_prints(frame(schema, rows[::-1]).repartition(7)).collect()))
    new_rows = [(*r[:5], [9.0] * 5) if r[:3] == ("a", 1, 1) else r for r in rows if r[:3] != ("b", 2, 0)] + [("c", 0, 0, 0, 0, [1.0])]
    new = Q.tile_prints(frame(schema, new_rows))
    assert {tuple(r) for r in Q.changed_tiles(old, new).collect()} == {("a", 1, 1, "changed"), ("b", 2, 0, "removed"), ("c", 0, 0, "new")}
    key = "(metric_id = 'a' AND tile_r = 1 AND tile_c = 1) OR (metric_id = 'b' AND tile_r = 2 AND tile_c = 0) OR metric_id = 'c'"
    after = Q.rewritten(Q.metric_prints(old), old.where(key), new.where(key))
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, Q.metric_prints(new).collect()))
    swapped = [(*r[:3], r[4], r[3], r[5]) for r in rows]  # the same values elsewhere are another content
    assert Q.changed_tiles(old, Q.tile_prints(frame(schema, swapped))).count() > 0
