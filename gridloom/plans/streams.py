"""The usage aggregates as streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import analytics as K
from gridloom.plans import views as V
from gridloom.plans.analytics import HEAT_SQL, ORIGIN_SQL, STATS_SQL, UNBLOCKED_SQL, UPSERT_SQL, blocked_lines, message_log
from gridloom.plans.registry import query
from gridloom.storage import work_folder
from gridloom.streaming import usage as U


class _Streamed:
    """Makes the batch views read a table as a stream."""

    def __init__(self, spark):
        self.read = self
        self._spark = spark

    def parquet(self, path):
        folder, name = path.rsplit("/", 1)
        return U.read_stream(self._spark, folder, name.removesuffix(".parquet"))


def _state(spark, stream, keys):
    path = U.run_available(stream, work_folder(spark, 'stream'), keys=keys)
    return U.latest_state(spark, path, keys)


@query("stream_click_heatmap", HEAT_SQL.format(src=UNBLOCKED_SQL))
def _(spark, sf):
    heat = U.click_heatmap(V.clicks(_Streamed(spark), sf), blocked_lines(spark, sf))
    return _state(spark, heat, ["lat", "lon"])


@query("stream_session_origins", ORIGIN_SQL)
def _(spark, sf):
    return _state(spark, U.session_origins(V.sessions(_Streamed(spark), sf)), ["country", "lat", "lon"])


@query("stream_question_stats", STATS_SQL)
def _(spark, sf):
    stats = U.question_stats(V.messages(_Streamed(spark), sf))
    return _state(spark, stats, ["question_tree_version", "question_id", "parent_question_id"])


@query("stream_message_upsert", UPSERT_SQL)
def _(spark, sf):
    log = message_log(V.messages(_Streamed(spark), sf))
    # Every event arrives twice, as a client retry would send it.
    path = U.message_upserts(log.unionByName(log), work_folder(spark, 'stream'))
    return K.current_messages(U.logged_messages(spark, path)).withColumn("question", F.md5("question"))
