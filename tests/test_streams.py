import pytest
from pyspark.sql import functions as F

from gridloom.operators import analytics as K
from gridloom.storage import work_folder
from gridloom.streaming import usage as U

CLICK = "id long, ts long, click_lat double, click_lon double, ip string"


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of click files and a stream over it."""
    folder = tmp_path / "clicks"

    def add(rows):
        spark.createDataFrame(rows, CLICK).coalesce(1).write.mode("append").parquet(str(folder))

    return add, lambda: spark.readStream.schema(CLICK).parquet(str(folder))


PLACE = ["lat", "lon"]


def heat(spark, path):
    return {(r.lat, r.lon): r["count"] for r in U.latest_state(spark, path, PLACE).collect()}


def test_state_is_merged_and_stays_small(spark, feed, monkeypatch):
    """Many restarts: the state is right after each, and only the last bases and their deltas are kept."""
    monkeypatch.setattr(U, "EVERY", 3)
    add, stream = feed
    folder, want = work_folder(spark, "stream"), {}
    for n in range(11):
        rows = [(n, n, 10.0 * (n % 4), 0.0, "a"), (n, n, 0.0, 10.0, "a")]
        add(rows)
        for _, _, lat, lon, _ in rows:
            want[lat, lon] = want.get((lat, lon), 0) + 1
        path = U.run_available(K.click_heatmap(stream()), folder, keys=PLACE)
        assert heat(spark, path) == want
        assert len(U.complete(spark, f"{path}/base")) <= 2 and len(U.complete(spark, f"{path}/delta")) <= 6
    assert U.complete(spark, f"{path}/base") == [5, 8]


def test_replayed_and_broken_batches_leave_the_same_state(spark, frame, tmp_path, monkeypatch):
    """Batches written again, before and after a base was made of them; bases and deltas without an end do not count."""
    monkeypatch.setattr(U, "EVERY", 2)
    path = str(tmp_path / "table")
    write = U.batch_writer(path, ["k"])
    batch = lambda *rows: frame("k int, n int", list(rows))
    batches = [batch((1, 1), (2, 1)), batch((1, 2)), batch((3, 1)), batch((2, 5), (1, 9)), batch((3, 4))]
    state = lambda: {r.k: r.n for r in U.latest_state(spark, path, ["k"]).collect()}
    after = [{1: 1, 2: 1}, {1: 2, 2: 1}, {1: 2, 2: 1, 3: 1}, {1: 9, 2: 5, 3: 1}, {1: 9, 2: 5, 3: 4}]
    for n, (df, want) in enumerate(zip(batches, after, strict=True)):
        write(df, n)
        assert state() == want
        write(df, n)
        assert state() == want
    for unfinished in (f"{path}/base/version=9", f"{path}/delta/batch_id=9"):
        batch((1, -1)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(unfinished)
    assert state() == after[-1]


def test_state_grows_over_restarts(spark, frame, feed):
    add, stream = feed
    folder = work_folder(spark, "stream")
    lines = frame("value string", [("9.9.9.9",), ("# note",)])
    add([(1, 1, 0.1, 0.1, "1.1.1.1"), (2, 2, 0.05, 0.1, "1.1.1.1"), (3, 3, 0.1, 0.1, "9.9.9.9")])
    path = U.run_available(U.click_heatmap(stream(), lines), folder, keys=PLACE)
    assert heat(spark, path) == {(0.0, 0.0): 2}
    add([(4, 4, 0.0, 0.0, "1.1.1.1"), (5, 5, 10.0, 10.0, "1.1.1.1")])
    assert U.run_available(U.click_heatmap(stream(), lines), folder, keys=PLACE) == path
    assert heat(spark, path) == {(0.0, 0.0): 3, (10.0, 10.0): 1}


@pytest.mark.parametrize("files", [0, 1, 3])
def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path, files):
    """One file named as the table, or a folder of that name with one or more files; other tables stay out."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(n, n, 10.0 * (n % 2), 0.0, "a") for n in range(6)]
    tables = str(tmp_path)
    if files:
        spark.createDataFrame(rows, CLICK).repartition(files).write.parquet(f"{tables}/clicks.parquet")
    else:
        names = ["id", "ts", "click_lat", "click_lon", "ip"]
        pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows)), strict=True))), f"{tables}/clicks.parquet")
    spark.createDataFrame(rows, CLICK).write.parquet(f"{tables}/others.parquet")
    path = U.run_available(K.click_heatmap(U.read_stream(spark, tables, "clicks")), work_folder(spark, "stream"), keys=PLACE)
    assert heat(spark, path) == {(0.0, 0.0): 3, (10.0, 0.0): 3}


def test_daily_windows_close_after_the_lateness(spark, feed):
    add, stream = feed
    folder = work_folder(spark, "stream")
    day = 86400
    add([(1, 10, 0.0, 0.0, "a"), (2, 20, 0.0, 0.0, "a"), (3, 5 * day, 1.0, 1.0, "a")])
    path = U.run_available(U.daily_click_heatmap(stream()), folder, mode="append")
    add([(4, 30, 0.0, 0.0, "a"), (5, 9 * day, 1.0, 1.0, "a")])
    U.run_available(U.daily_click_heatmap(stream()), folder, mode="append")
    out = {(r.window.start.day, r["count"]) for r in spark.read.parquet(path).collect()}
    assert (1, 2) in out and (1, 3) not in out  # the late click came after its window closed


def test_upserts_ignore_retries_and_keep_late_events(spark, tmp_path):
    schema = "message_id string, kind string, seq long, ts long, session_id string, question string, answer string, error string, feedback string"
    m = lambda seq, kind, answer=None, error=None, feedback=None, ts=None: ("m1", kind, seq, seq if ts is None else ts, "s", "q", answer, error, feedback)
    batches = [
        [m(1, "message", "old"), m(2, "feedback", feedback="bad"), m(2, "feedback", feedback="bad")],
        [m(3, "message", "new", "boom", ts=10 ** 6), m(2, "feedback", feedback="bad")],
        [m(4, "review", ts=5)],  # days late
    ]
    src, folder = str(tmp_path / "log"), work_folder(spark, "stream")
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        path = U.message_upserts(spark.readStream.schema(schema).parquet(src), folder)
    log = U.logged_messages(spark, path)
    assert sorted(r.seq for r in log.collect()) == [1, 2, 3, 4]
    r = K.current_messages(log).first()
    assert (r.answer, r.error, r.feedback, r.feedback_status) == ("new", "boom", None, "reviewed")


def test_packed_matches_windows(spark):
    from conftest import SF
    from gridloom.operators import packed as P, reducers as R
    from gridloom.plans.packed import daily_series
    from gridloom.sources import series as S

    series, axis = daily_series(spark, SF)
    dense = S.unpack_series(series, axis, keep=["i_lat", "i_lon"]).select("i_lat", "i_lon", "t", "value")
    key = lambda df: {(r.i_lat, r.i_lon, r.year): r.value for r in df.collect()}
    assert key(P.longest_dry_run(series, axis, 25.0)) == key(R.longest_dry_run(dense, 25.0))
    plan = P.longest_dry_run(spark.createDataFrame(series.limit(3).collect(), series.schema), axis)._jdf.queryExecution().toString()
    assert "Window" not in plan.split("Physical Plan")[1].split("BroadcastNestedLoopJoin")[0]


def test_packed_daily_reducers_match_the_long_ones(spark):
    """Same numbers as the long forms, and only (cell, year) rows are ever shuffled."""
    from conftest import SF
    from gridloom.operators import packed as P, reducers as R
    from gridloom.plans.packed import daily_series
    from gridloom.sources import series as S

    series, axis = daily_series(spark, SF)
    series = spark.createDataFrame(series.collect(), series.schema)
    dense = S.unpack_series(series, axis, keep=["i_lat", "i_lon"]).select("i_lat", "i_lon", "t", "value")
    rows = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    assert rows(P.annual_sum(series, axis)) == rows(R.annual_sum(dense))
    assert rows(P.annual_mean_from_daily(series, axis)) == rows(R.annual_mean_from_daily(dense))
    assert rows(P.heat_stress_years(series, axis, 20.0, 35.0)) == rows(R.heat_stress_years(dense, 20.0, 35.0))
    hot = P.hot_days(series, axis, 5, 60)
    assert rows(hot) == rows(R.hot_days(dense, 5, 60))
    for df in (P.annual_sum(series, axis), P.annual_mean_from_daily(series, axis), P.heat_stress_years(series, axis)):
        left = df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        assert "Exchange" not in left and "Window" not in left
    assert "partial_count_if" in hot._jdf.queryExecution().toString() or "partial_count" in hot._jdf.queryExecution().toString()
