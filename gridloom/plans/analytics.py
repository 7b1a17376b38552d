"""Usage analytics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as TX
from gridloom.operators import analytics as K
from gridloom.plans import views as V
from gridloom.plans.registry import query

V.SQL_VIEWS["blocked_lines"] = """SELECT '10.0.' || (n_nationkey % 7) || '.' || (n_nationkey % 4) || ' ' AS value FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT '# 10.0.1.1' UNION ALL SELECT ''"""


def blocked_lines(spark, sf):
    n = F.col("n_nationkey")
    ips = V.table(spark, sf, "nation").where(n % 3 == 0).select(
        F.concat(F.lit("10.0."), (n % 7).cast("string"), F.lit("."), (n % 4).cast("string"), F.lit(" ")).alias("value")
    )
    return ips.union(spark.range(1).select(F.lit("# 10.0.1.1"))).union(spark.range(1).select(F.lit("")))


_SNAP = "round_even({c} / {r}::DOUBLE, 0) * {r}::DOUBLE + 0.0::DOUBLE"
HEAT_SQL = f"""SELECT {_SNAP.format(c='click_lat', r=0.25)} AS lat, {_SNAP.format(c='click_lon', r=0.25)} AS lon, count(*) AS count FROM {{src}} GROUP BY 1, 2"""
ORIGIN_SQL = f"""SELECT user_country AS country, {_SNAP.format(c='user_lat', r=1.0)} AS lat, {_SNAP.format(c='user_lon', r=1.0)} AS lon, count(*) AS count FROM sessions GROUP BY 1, 2, 3"""
UNBLOCKED_SQL = "clicks WHERE ip NOT IN (SELECT trim(value) FROM blocked_lines WHERE trim(value) <> '' AND NOT starts_with(value, '#'))"


@query("click_heatmap", HEAT_SQL.format(src="clicks"))
def _(spark, sf):
    return K.click_heatmap(V.clicks(spark, sf))


@query("ip_block", f"SELECT id, ip FROM {UNBLOCKED_SQL}")
def _(spark, sf):
    return K.without_blocked(V.clicks(spark, sf), blocked_lines(spark, sf)).select("id", "ip")


@query("session_origins", ORIGIN_SQL)
def _(spark, sf):
    return K.session_origins(V.sessions(spark, sf))


@query("last_event_ts", "SELECT max(ts) AS last_ts FROM (SELECT ts FROM clicks UNION ALL SELECT ts FROM sessions)")
def _(spark, sf):
    return K.last_event_ts(V.clicks(spark, sf), V.sessions(spark, sf))


_PAGE_COLS = ["message_id", "session_id", "ts", "answer", "feedback", "opt_out"]
_PAGE_SQL = """message_id, session_id, ts, coalesce(answer, '') AS answer, feedback, opt_out,
  array_to_string(from_json(tools_called, '["VARCHAR"]'), '|') AS tools, CAST(json_array_length(steps_timing) AS INTEGER) AS steps"""


def _page(df):
    return df.select(*_PAGE_COLS, F.array_join("tools_called", "|").alias("tools"), F.size("steps_timing").alias("steps"))


@query("messages_page", f"SELECT {_PAGE_SQL} FROM messages WHERE feedback = 'bad' ORDER BY ts DESC, message_id LIMIT 50 OFFSET 2")
def _(spark, sf):
    return _page(K.messages_page(V.messages(spark, sf), limit=50, offset=2, feedback="bad"))


@query("review_queue", f"SELECT {_PAGE_SQL} FROM messages WHERE feedback_status = 'new' AND NOT opt_out ORDER BY ts DESC, message_id LIMIT 40")
def _(spark, sf):
    return _page(K.review_queue(V.messages(spark, sf), limit=40))


@query("chat_stats", """WITH m AS (SELECT *, tier IS NULL OR tier NOT IN ('canned', 'templated') AS model FROM messages WHERE NOT opt_out),
  p AS (SELECT list_sort(list(total_ms)) AS a, list_sort(list(total_ms) FILTER (WHERE model)) AS b FROM m)
  SELECT count(*) AS total_messages, count(DISTINCT session_id) AS total_sessions, count(*) FILTER (WHERE feedback = 'good') AS feedback_good,
   count(*) FILTER (WHERE feedback = 'bad') AS feedback_bad, count(*) FILTER (WHERE feedback_status = 'new') AS bad_answers_unreviewed,
   disp(avg(step_count), 2) AS avg_step_count, disp(avg(step_count) FILTER (WHERE model), 2) AS avg_step_count_llm,
   CAST(round_even(avg(total_ms), 0) AS BIGINT) AS avg_resp_ms, CAST(round_even(avg(total_ms) FILTER (WHERE model), 0) AS BIGINT) AS avg_resp_ms_llm,
   disp(count(*) / count(DISTINCT session_id), 1) AS avg_messages_per_session,
   (SELECT a[greatest(0, CAST(floor(len(a) * 0.95::DOUBLE) AS BIGINT) - 1) + 1] FROM p) AS p95_resp_ms,
   (SELECT b[greatest(0, CAST(floor(len(b) * 0.95::DOUBLE) AS BIGINT) - 1) + 1] FROM p) AS p95_resp_ms_llm FROM m""")
def _(spark, sf):
    return K.chat_stats(V.messages(spark, sf))


STATS_SQL = """SELECT question_tree_version, question_id, parent_question_id, count(*) AS clicks, count(*) FILTER (WHERE feedback = 'good') AS feedback_good,
  count(*) FILTER (WHERE feedback = 'bad') AS feedback_bad, max(ts) AS last_ts FROM messages WHERE question_id IS NOT NULL AND NOT opt_out GROUP BY 1, 2, 3"""
V.SQL_VIEWS["qstats"] = STATS_SQL


@query("question_stats", STATS_SQL)
def _(spark, sf):
    return K.question_stats(V.messages(spark, sf))


@query("typed_counts", "SELECT question_tree_version, count(*) AS typed FROM messages WHERE question_id IS NULL AND NOT opt_out GROUP BY 1")
def _(spark, sf):
    return K.typed_counts(V.messages(spark, sf))


@query("typed_entry_points", """WITH p AS (SELECT *, last_value(question_id IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_question_id
    FROM messages WHERE NOT opt_out), t AS (SELECT * FROM p WHERE question_id IS NULL),
  e AS (SELECT question_tree_version, after_question_id, message_id, session_id, ts, question, row_number() OVER (PARTITION BY question_tree_version, after_question_id ORDER BY session_id, ts, message_id) AS k FROM t WHERE length(question) > 0)
  SELECT t.question_tree_version, t.after_question_id, count(*) AS typed, (SELECT string_agg(md5(question), ',' ORDER BY k) FROM e WHERE k <= 3
    AND e.question_tree_version IS NOT DISTINCT FROM t.question_tree_version AND e.after_question_id IS NOT DISTINCT FROM t.after_question_id) AS examples FROM t GROUP BY 1, 2""")
def _(spark, sf):
    out = K.typed_entry_points(V.messages(spark, sf))
    return out.withColumn("examples", F.array_join(F.transform("examples", F.md5), ","))


@query("question_edge_counts", """SELECT 'question' AS kind, question_id AS key, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(feedback_good) AS BIGINT) AS feedback_good, CAST(sum(feedback_bad) AS BIGINT) AS feedback_bad
    FROM qstats WHERE question_tree_version = 'v1' GROUP BY 2
  UNION ALL SELECT 'edge', coalesce(parent_question_id, '') || '>' || question_id, CAST(sum(clicks) AS BIGINT), CAST(sum(feedback_good) AS BIGINT), CAST(sum(feedback_bad) AS BIGINT)
    FROM qstats WHERE question_tree_version = 'v1' GROUP BY 2""")
def _(spark, sf):
    return K.question_edges(K.question_stats(V.messages(spark, sf)), "v1")


@query("question_versions", "SELECT DISTINCT question_tree_version FROM (SELECT question_tree_version FROM messages WHERE NOT opt_out UNION ALL SELECT 'v9')")
def _(spark, sf):
    m = V.messages(spark, sf)
    return K.version_list(K.question_stats(m), K.typed_counts(m), "v9")


@query("session_transcripts", """SELECT session_id, message_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, message_id) AS position,
  max(ts) OVER (PARTITION BY session_id) AS latest_ts FROM messages""")
def _(spark, sf):
    return K.session_transcripts(V.messages(spark, sf)).select("session_id", "message_id", "ts", "position", "latest_ts")


@query("token_totals", "SELECT 'm' || conv_id || '_' || turn AS message_id, CAST(length(text) + 5 AS BIGINT) AS prompt_tokens, CAST(turn * 3 AS BIGINT) AS completion_tokens FROM conversations")
def _(spark, sf):
    return K.token_totals(V.messages(spark, sf), ["message_id"])


# Inserts (some repeated), feedback and reviews of every message.
V.SQL_VIEWS["message_log"] = """SELECT message_id, 'message' AS kind, CAST(1 AS BIGINT) AS seq, ts, session_id, question, answer, CASE WHEN step_count = 3 THEN 'failed' END AS error, CAST(NULL AS VARCHAR) AS feedback FROM messages
  UNION ALL SELECT message_id, 'feedback', 2, ts + 1, NULL, NULL, NULL, NULL, feedback FROM messages WHERE step_count <> 1
  UNION ALL SELECT message_id, 'message', 3, ts + 2, session_id, question, 'again', NULL, NULL FROM messages WHERE total_ms % 3 = 0
  UNION ALL SELECT message_id, 'feedback', 4, ts + 3, NULL, NULL, NULL, NULL, CASE WHEN total_ms % 4 = 0 THEN 'bad' END FROM messages WHERE total_ms % 20 < 10
  UNION ALL SELECT message_id, 'review', 5, ts + 4, NULL, NULL, NULL, NULL, NULL FROM messages WHERE tier = 'canned'
  UNION ALL SELECT 'ghost' || message_id, 'feedback', 6, ts, NULL, NULL, NULL, NULL, 'good' FROM messages WHERE tier = 'large'"""


def message_log(messages):
    null = F.lit(None).cast("string")
    ms = F.col("total_ms")

    def rows(where, kind, seq, session=null, question=null, answer=null, error=null, feedback=null, prefix=""):
        return messages.where(where).select(
            F.concat(F.lit(prefix), "message_id").alias("message_id"), F.lit(kind).alias("kind"), F.lit(seq).cast("long").alias("seq"),
            (F.col("ts") + (seq - 1 if seq < 6 else 0)).alias("ts"), session.alias("session_id"), question.alias("question"),
            answer.alias("answer"), error.alias("error"), feedback.alias("feedback"),
        )

    s, q = F.col("session_id"), F.col("question")
    parts = [
        rows(F.lit(True), "message", 1, s, q, F.col("answer"), F.when(F.col("step_count") == 3, "failed")),
        rows(F.col("step_count") != 1, "feedback", 2, feedback=F.col("feedback")),
        rows(ms % 3 == 0, "message", 3, s, q, F.lit("again")),
        rows(ms % 20 < 10, "feedback", 4, feedback=F.when(ms % 4 == 0, "bad")),
        rows(F.col("tier") == "canned", "review", 5),
        rows(F.col("tier") == "large", "feedback", 6, feedback=F.lit("good"), prefix="ghost"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


UPSERT_SQL = """WITH i AS (SELECT message_id, max(seq) AS ins FROM message_log WHERE kind = 'message' GROUP BY 1),
  m AS (SELECT l.* FROM message_log l JOIN i ON i.message_id = l.message_id AND i.ins = l.seq),
  f AS (SELECT message_id, seq, feedback FROM message_log WHERE kind = 'feedback' QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY seq DESC) = 1),
  s AS (SELECT message_id, CASE kind WHEN 'message' THEN CASE WHEN error IS NOT NULL THEN 'new' END WHEN 'feedback' THEN CASE WHEN feedback = 'bad' THEN 'new' END ELSE 'reviewed' END AS st
    FROM message_log QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY seq DESC) = 1)
  SELECT m.message_id, m.session_id, md5(m.question) AS question, m.answer, m.error, CASE WHEN f.seq > m.seq THEN f.feedback END AS feedback, s.st AS feedback_status
  FROM m LEFT JOIN f USING (message_id) LEFT JOIN s USING (message_id)"""


@query("upsert_messages", UPSERT_SQL)
def _(spark, sf):
    return K.current_messages(message_log(V.messages(spark, sf))).withColumn("question", F.md5("question"))


# The stored questions are what users asked, with doubled spaces; every turn is looked up.
@query("canned_match", """WITH k AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM conversations),
  c AS (SELECT DISTINCT k FROM k WHERE role = 'user' AND k <> '')
  SELECT conv_id, turn, md5(k) AS answer_id FROM k JOIN c USING (k)""")
def _(spark, sf):
    turns = V.table(spark, sf, "conversations")
    k = TX.collapse_spaces(F.col("text"))
    canned = turns.where("role = 'user'").select(k.alias("k")).where("k <> ''").distinct().select(
        F.replace("k", F.lit(" "), F.lit("  ")).alias("question"), F.md5("k").alias("answer_id")
    )
    return K.canned_match(turns.select("conv_id", "turn", F.col("text").alias("question")), canned).select(
        "conv_id", "turn", "answer_id"
    )
