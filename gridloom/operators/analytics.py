"""Usage analytics over click, session and message events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.text import collapse_spaces
from gridloom.functions.units import display_round
from gridloom.grid import snap_round
from gridloom.operators.scan import global_row_number, last_before, order_statistics

# Answer tiers that do not run a model.
FIXED_TIERS = ["canned", "templated"]

STEPS = "array<struct<step:int,prompt_tokens:long,completion_tokens:long>>"


def _real(messages: DataFrame) -> DataFrame:
    """Opted-out messages stay out of every aggregate."""
    return messages.where(~F.coalesce("opt_out", F.lit(False)))


def without_blocked(events: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Drop events of listed addresses; ``blocklist`` has one raw line per row."""
    line = F.trim("value")
    listed = blocklist.where((line != "") & ~F.col("value").startswith("#")).select(line.alias("ip")).distinct()
    return events.join(listed, "ip", "left_anti")


def click_heatmap(clicks: DataFrame, res: float = 0.25) -> DataFrame:
    return clicks.groupBy(
        (snap_round(F.col("click_lat"), res) + 0.0).alias("lat"), (snap_round(F.col("click_lon"), res) + 0.0).alias("lon")
    ).agg(F.count(F.lit(1)).alias("count"))


def session_origins(sessions: DataFrame, res: float = 1.0) -> DataFrame:
    """Sessions per country and rounded place; unknown origins are a group of their own."""
    return sessions.groupBy(
        F.col("user_country").alias("country"),
        (snap_round(F.col("user_lat"), res) + 0.0).alias("lat"), (snap_round(F.col("user_lon"), res) + 0.0).alias("lon"),
    ).agg(F.count(F.lit(1)).alias("count"))


def last_event_ts(clicks: DataFrame, sessions: DataFrame) -> DataFrame:
    return clicks.select("ts").unionByName(sessions.select("ts")).agg(F.max("ts").alias("last_ts"))


def _parsed(messages: DataFrame) -> DataFrame:
    empty = lambda schema: F.array().cast(schema)
    # Call details are objects of any shape; each stays a JSON text of its own.
    schemas = {"tools_called": "array<string>", "tool_calls_detail": "array<string>", "steps_timing": STEPS,
               "rejected_tiers": "array<string>"}
    parsed = {
        c: F.coalesce(F.from_json(c, schema), empty(schema)) for c, schema in schemas.items() if c in messages.columns
    }
    return messages.withColumns({"answer": F.coalesce("answer", F.lit("")), **parsed})


def messages_page(messages: DataFrame, limit: int = 50, offset: int = 0, feedback: str | None = None) -> DataFrame:
    """A page of recent messages, opted-out ones included."""
    rows = messages if feedback is None else messages.where(F.col("feedback") == feedback)
    # Only the page is parsed.
    return _parsed(rows.orderBy(F.desc("ts"), "message_id").offset(offset).limit(limit))


def review_queue(messages: DataFrame, limit: int = 50) -> DataFrame:
    """Newest unreviewed failures of real users."""
    rows = _real(messages).where(F.col("feedback_status") == "new")
    return _parsed(rows.orderBy(F.desc("ts"), "message_id").limit(limit))


def chat_stats(messages: DataFrame) -> DataFrame:
    """Totals, steps and latency, overall and for model answers only.

    An unknown tier counts as a model.  The 95th percentile is the element at
    ``max(0, int(0.95 n) - 1)`` of the sorted durations.
    """
    real = _real(messages)
    model = ~F.coalesce(F.col("tier").isin(*FIXED_TIERS), F.lit(False))
    totals = real.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_distinct("session_id").alias("total_sessions"),
        F.count_if(F.col("feedback") == "good").alias("feedback_good"),
        F.count_if(F.col("feedback") == "bad").alias("feedback_bad"),
        F.count_if(F.col("feedback_status") == "new").alias("bad_answers_unreviewed"),
        display_round(F.avg("step_count"), 2).alias("avg_step_count"),
        display_round(F.avg(F.when(model, F.col("step_count"))), 2).alias("avg_step_count_llm"),
        F.rint(F.avg("total_ms")).cast("long").alias("avg_resp_ms"),
        F.rint(F.avg(F.when(model, F.col("total_ms")))).cast("long").alias("avg_resp_ms_llm"),
    ).withColumn(
        "avg_messages_per_session",
        F.when(F.col("total_sessions") > 0, display_round(F.col("total_messages") / F.col("total_sessions"), 1)),
    )
    both = real.select("total_ms", F.explode(
        F.when(model, F.array(F.lit("all"), F.lit("llm"))).otherwise(F.array(F.lit("all")))
    ).alias("scope"))
    p95 = order_statistics(both, ["scope"], "total_ms", {"p95": lambda n: F.floor(n * F.lit(0.95)) - 1})
    at = lambda s: F.max(F.when(F.col("scope") == s, F.col("value"))).cast("long")
    spread = p95.agg(at("all").alias("p95_resp_ms"), at("llm").alias("p95_resp_ms_llm"))
    return totals.join(F.broadcast(spread))


def question_stats(messages: DataFrame) -> DataFrame:
    """Clicks and feedback per question and parent, never pooled across versions."""
    return _real(messages).where(F.col("question_id").isNotNull()).groupBy(
        "question_tree_version", "question_id", "parent_question_id"
    ).agg(
        F.count(F.lit(1)).alias("clicks"), F.count_if(F.col("feedback") == "good").alias("feedback_good"),
        F.count_if(F.col("feedback") == "bad").alias("feedback_bad"), F.max("ts").alias("last_ts"),
    )


def typed_counts(messages: DataFrame) -> DataFrame:
    return _real(messages).where(F.col("question_id").isNull()).groupBy("question_tree_version").agg(
        F.count(F.lit(1)).alias("typed")
    )


def typed_entry_points(messages: DataFrame, limit: int | None = None, examples: int = 3) -> DataFrame:
    """Last chip of the session before each typed question, with first examples.

    ``limit`` bounds the input rows in session order, as a report would.  The
    running last chip survives sessions of any size (see ``last_before``).
    """
    order = ["ts", "message_id"]
    rows = _real(messages).select("session_id", "ts", "message_id", "question_id", "question_tree_version", "question")
    if limit is not None:
        rows = rows.orderBy("session_id", *order).limit(limit)
    placed = last_before(rows, ["session_id"], order, "question_id", "after_question_id")
    typed = placed.where(F.col("question_id").isNull())
    keys = ["question_tree_version", "after_question_id"]
    counts = typed.groupBy(*keys).agg(F.count(F.lit(1)).alias("typed"))
    first = Window.partitionBy(*keys).orderBy("session_id", *order)
    shown = typed.where(F.length("question") > 0).withColumn("k", F.row_number().over(first)).where(
        F.col("k") <= examples
    ).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "question"))).alias("e"))
    same = None
    s = shown.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.transform("e", lambda x: x["question"]).alias("examples"))
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"s_{k}"))
        same = c if same is None else same & c
    return counts.join(s, same, "left").select(
        *keys, "typed", F.coalesce("examples", F.array().cast("array<string>")).alias("examples")
    )


def question_edges(stats: DataFrame, version: str | None) -> DataFrame:
    """Clicks per question and per parent-child edge of one version."""
    rows = stats.where(F.col("question_tree_version").eqNullSafe(F.lit(version)))
    sums = [F.sum(c).alias(c) for c in ("clicks", "feedback_good", "feedback_bad")]
    edge = F.concat(F.coalesce("parent_question_id", F.lit("")), F.lit(">"), "question_id")
    keyed = rows.select("clicks", "feedback_good", "feedback_bad", F.inline(F.array(
        F.struct(F.lit("question").alias("kind"), F.col("question_id").alias("key")),
        F.struct(F.lit("edge").alias("kind"), edge.alias("key")),
    )))
    return keyed.groupBy("kind", "key").agg(*sums)


def version_list(stats: DataFrame, typed: DataFrame, current: str) -> DataFrame:
    """Known versions, newest first, untracked rows last."""
    v = stats.select("question_tree_version").unionByName(typed.select("question_tree_version"))
    cur = stats.sparkSession.range(1).select(F.lit(current).alias("question_tree_version"))
    return v.unionByName(cur).distinct().orderBy(F.desc_nulls_last("question_tree_version"))


def session_transcripts(messages: DataFrame) -> DataFrame:
    """Messages with their place in the session and the session's latest time.

    Flat rows instead of one array per session, so a huge session never has to
    fit into one record; sort by ``latest_ts`` descending, then position.
    """
    rows = messages.select("session_id", "message_id", "ts", "question", "answer")
    latest = rows.groupBy("session_id").agg(F.max("ts").alias("latest_ts"))
    numbered = global_row_number(rows, ["session_id"], [F.asc("ts"), F.asc("message_id")], "position")
    return numbered.join(latest, "session_id")


def token_totals(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Prompt and completion tokens summed over the steps of each message."""
    steps = F.from_json("steps_timing", STEPS)
    total = lambda field: F.aggregate(steps, F.lit(0).cast("long"), lambda acc, s: acc + F.coalesce(s[field], F.lit(0)))
    return messages.select(
        *keys, F.coalesce(total("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(total("completion_tokens"), F.lit(0)).alias("completion_tokens"),
    )


def current_messages(log: DataFrame) -> DataFrame:
    """State of each message after its inserts, feedback and reviews.

    ``log`` rows carry seq (a total order per message), kind, message_id and
    the fields of their kind.  A re-insert wipes earlier feedback; an error or
    bad feedback opens a review, any other feedback closes it.
    """
    kind, seq = F.col("kind"), F.col("seq")
    is_insert, is_feedback = kind == "message", kind == "feedback"
    status = (
        F.when(is_insert, F.when(F.col("error").isNotNull(), "new"))
        .when(is_feedback, F.when(F.col("feedback") == "bad", "new"))
        .otherwise("reviewed")
    )
    last = lambda cond, *cols: F.max_by(F.struct(*cols), F.when(cond, seq))
    state = log.groupBy("message_id").agg(
        F.max(F.when(is_insert, seq)).alias("inserted"),
        last(is_insert, "session_id", "question", "answer", "error").alias("m"),
        F.max(F.when(is_feedback, seq)).alias("rated"),
        last(is_feedback, "feedback").alias("f"),
        last(F.lit(True), status.alias("status")).alias("s"),
    ).where(F.col("inserted").isNotNull())
    return state.select(
        "message_id", "m.*",
        F.when(F.col("rated") > F.col("inserted"), F.col("f.feedback")).alias("feedback"),
        F.col("s.status").alias("feedback_status"),
    )


def canned_match(questions: DataFrame, canned: DataFrame, question: str = "question") -> DataFrame:
    """Stored answer of a question, matched on lower case and single spaces."""
    known = canned.select(collapse_spaces(F.col("question")).alias("__k"), "answer_id")
    return questions.withColumn("__k", collapse_spaces(F.col(question))).join(known, "__k").drop("__k")
