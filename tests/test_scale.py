"""Operators whose keys may hold most of the rows, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import analytics as K, scan as S


@pytest.fixture(scope="module")
def hot(spark):
    """One session holds two thirds of the rows."""
    rng = np.random.default_rng(1)
    n = 6000
    key = np.where(rng.random(n) < 0.66, "hot", rng.integers(0, 40, n).astype(str))
    ts = rng.integers(0, 900, n)
    chip = [f"q{v}" if v < 4 else None for v in rng.integers(0, 12, n)]
    rows = [(str(k), int(t), f"m{i:05d}", c) for i, (k, t, c) in enumerate(zip(key, ts, chip))]
    return rows, spark.createDataFrame(rows, "session_id string, ts long, message_id string, question_id string").repartition(7)


def test_row_numbers_span_partitions(hot):
    rows, df = hot
    out = S.global_row_number(df, ["session_id"], [F.asc("ts"), F.asc("message_id")], "n", with_count="total")
    got = {r.message_id: (r.n, r.total) for r in out.collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(r[0], []).append(r[2])
    assert got == {m: (i + 1, len(ms)) for ms in by.values() for i, m in enumerate(ms)}


def test_hot_key_is_spread_over_chunks(hot):
    _, df = hot
    chunked = S.ordered_chunks(df, [F.col("session_id"), F.col("ts"), F.col("message_id")], partitions=8)
    sizes = [r["count"] for r in chunked.groupBy(S.CHUNK).count().collect()]
    assert max(sizes) < 0.3 * sum(sizes)


def test_last_before_carries_over_chunks(hot):
    rows, df = hot
    out = S.last_before(df, ["session_id"], ["ts", "message_id"], "question_id", "prev")
    got = {r.message_id: r.prev for r in out.collect()}
    last, want = {}, {}
    for s, t, m, c in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[m] = last.get(s)
        last[s] = c or last.get(s)
    assert got == want


@pytest.mark.parametrize("shape", ["uniform", "heavy", "outlier", "tiny"])
def test_exact_order_statistics(spark, shape):
    rng = np.random.default_rng(2)
    v = {
        "uniform": rng.normal(size=5000), "heavy": np.where(rng.random(5000) < 0.6, 7.0, rng.normal(size=5000)),
        "outlier": np.concatenate([rng.normal(size=4000), [1e12, -1e12]]), "tiny": np.array([3.0, 1.0]),
    }[shape]
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 5.0), ("b", None)], "k string, v double").repartition(5)
    qs = {"lo": 0.02, "mid": 0.5, "hi": 0.98, "top": 1.0}
    got = {r.k: r for r in S.exact_quantiles(df, ["k"], "v", qs).collect()}
    for name, q in qs.items():
        assert got["a"][name] == pytest.approx(np.quantile(v, q), rel=1e-12)
        assert got["b"][name] == 5.0


MSG = ("message_id string, session_id string, ts long, question string, tier string, step_count int, total_ms long, feedback string, "
       "feedback_status string, opt_out boolean, question_id string, question_tree_version string")


def message(i, session="s", ts=None, question="q", tier=None, steps=None, ms=None, chip=None, version="v1", opt_out=False):
    return (f"m{i:03d}", session, i if ts is None else ts, question, tier, steps, ms, None, None, opt_out, chip, version)


def test_latency_percentile(frame):
    df = frame(MSG, [message(i, ms=100 * (i + 1)) for i in range(20)])
    assert K.chat_stats(df).first().p95_resp_ms == 1900


def test_stats_separate_model_answers(frame):
    df = frame(MSG, [message(1, tier="canned", ms=1500, steps=0), message(2, tier="templated", ms=1500, steps=0),
                     message(3, tier="large", ms=6000, steps=3), message(4, tier=None, ms=10000, steps=5), message(5, ms=1, opt_out=True)])
    r = K.chat_stats(df).first()
    assert (r.avg_resp_ms, r.avg_resp_ms_llm, r.p95_resp_ms, r.p95_resp_ms_llm) == (4750, 8000, 6000, 6000)
    assert (r.avg_step_count, r.avg_step_count_llm, r.total_messages) == (2.0, 4.0, 4)


def test_typed_entry_points(frame):
    df = frame(MSG, [message(1, "s1", chip="hot_days_global"), message(2, "s1", question="What about hail?"), message(3, "s2", question="Typed")])
    got = {(r.after_question_id, r.typed, tuple(r.examples)) for r in K.typed_entry_points(df).collect()}
    assert got == {("hot_days_global", 1, ("What about hail?",)), (None, 1, ("Typed",))}
    assert K.typed_entry_points(df, limit=2).count() == 1


def test_blocklist_ignores_comments(frame):
    ev = frame("id int, ip string", [(1, "1.1.1.1"), (2, "2.2.2.2"), (3, "# 3")])
    lines = frame("value string", [(" 1.1.1.1 ",), ("# 3",), ("",)])
    assert {r.id for r in K.without_blocked(ev, lines).collect()} == {2, 3}


def test_json_columns_of_a_page(frame):
    df = frame("message_id string, ts long, feedback string, answer string, tools_called string, tool_calls_detail string, steps_timing string, "
               "rejected_tiers string", [("a", 1, None, None, '["x"]', '[{"t": {"k": 1}}]', None, None), ("b", 2, None, "hi", None, None, '[{"step": 1}]', '["big"]')])
    b, a = K.messages_page(df).collect()
    assert (a.answer, a.tools_called, a.tool_calls_detail, a.steps_timing, a.rejected_tiers) == ("", ["x"], ['{"t":{"k":1}}'], [], [])
    assert (b.message_id, b.steps_timing[0].step, b.rejected_tiers) == ("b", 1, ["big"])
