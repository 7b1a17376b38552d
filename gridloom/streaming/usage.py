"""The usage aggregates as Structured Streaming jobs over a file source.

Aggregations run in update mode: a micro-batch emits the new rows of the keys it touched.  Each batch is written as a
delta of its own, and every ``EVERY`` batches the deltas are merged into a new base that holds one row per key.  Reading
the state takes the last complete base and the deltas after it, so it costs as much as there are keys and a few batches,
however long the stream has run.

A folder only counts once it is complete.  A replayed batch overwrites its own delta and its own base, always from the
same older base, so it leaves the same state.  What a base made superfluous is deleted when the *next* base is complete;
until then a replay and readers of the old state find it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import analytics as K

EVERY = 16


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Stream the files of one table, a file or a folder of files; the schema is declared from the stored one."""
    stored = f"{folder}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(stored).schema)
    fs, path = _files(spark, stored)
    if fs.getFileStatus(path).isDirectory():
        return stream.parquet(stored)
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def _files(spark: SparkSession, folder: str):
    """(file system, path) of a folder, wherever Spark stores it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the subfolders ``name=<number>`` whose writing has ended."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and "=" in s.getPath().getName()]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _merged(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """The last row of every key after batch ``upto`` (the last one without it)."""
    last = float("inf") if upto is None else upto
    # A base of batch ``upto`` itself may be there already, from the run that is replayed.
    bases = [n for n in complete(spark, f"{path}/base") if n < last]
    base = max(bases, default=-1)
    parts = [f"{path}/base/version={base}"] if bases else []
    parts += [f"{path}/delta/batch_id={n}" for n in complete(spark, f"{path}/delta") if base < n <= last]
    rows = functools.reduce(DataFrame.unionByName, [
        spark.read.parquet(p).withColumn("__at", F.lit(int(p.rsplit("=", 1)[1]))) for p in parts])
    rest = [c for c in rows.columns if c not in keys and c != "__at"]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__at").alias("r")).select(*keys, "r.*")


def compact(spark: SparkSession, path: str, keys: list[str], batch_id: int) -> None:
    """Write the state after ``batch_id`` as a base, then drop what the base before it had replaced."""
    older = [n for n in complete(spark, f"{path}/base") if n < batch_id]
    _merged(spark, path, keys, batch_id).write.mode("overwrite").parquet(f"{path}/base/version={batch_id}")
    if older:
        fs, _ = _files(spark, path)
        gone = [f"{path}/base/version={n}" for n in older[:-1]]
        gone += [f"{path}/delta/batch_id={n}" for n in complete(spark, f"{path}/delta") if n <= older[-1]]
        for p in gone:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p), True)


def batch_writer(path: str, keys: list[str] | None = None):
    """What a stream does with a micro-batch: keep it as a delta of the state of ``keys``, or as a part of a log."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if not keys:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            return
        batch.write.mode("overwrite").parquet(f"{path}/delta/batch_id={batch_id}")
        if (batch_id + 1) % EVERY == 0:
            compact(batch.sparkSession, path, keys, batch_id)

    return write


def run_available(stream: DataFrame, folder: str, mode: str = "update", keys: list[str] | None = None) -> str:
    """Process what is available and stop; returns the path of the state (of a log without ``keys``)."""
    path = f"{folder}/table"
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(batch_writer(path, keys))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return path


def latest_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current row of every key."""
    return _merged(spark, path, keys)


def click_heatmap(clicks: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Counts per quarter-degree place, listed addresses left out."""
    return K.click_heatmap(K.without_blocked(clicks, blocklist))


def session_origins(sessions: DataFrame) -> DataFrame:
    return K.session_origins(sessions)


def question_stats(messages: DataFrame) -> DataFrame:
    return K.question_stats(messages)


def daily_click_heatmap(clicks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Windowed variant whose state is dropped once a day is ``lateness`` old."""
    from gridloom.grid import snap_round

    return clicks.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", lateness).groupBy(
        F.window("at", "1 day"),
        (snap_round(F.col("click_lat"), 0.25) + 0.0).alias("lat"),
        (snap_round(F.col("click_lon"), 0.25) + 0.0).alias("lon"),
    ).agg(F.count(F.lit(1)).alias("count"))


EVENT = ["message_id", "seq"]


def message_upserts(log: DataFrame, folder: str) -> str:
    """Keep a message log; read it with :func:`logged_messages`.

    The table keeps every event, however late it comes.  Retries repeat (message_id, seq): merging leaves one of them, so
    no state has to remember them.
    """
    return run_available(log, folder, mode="append", keys=EVENT)


def logged_messages(spark: SparkSession, path: str) -> DataFrame:
    """Every event once, whatever was retried or replayed."""
    return latest_state(spark, path, EVENT)
