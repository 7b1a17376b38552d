"""Partitioned sinks of regional aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _write(df: DataFrame, path: str, fmt: str) -> None:
    (
        # Rebalancing splits a partition that one metric fills.
        df.hint("rebalance", F.col("metric_id"), F.col("aggregation")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("metric_id", "aggregation").format(fmt).save(path)
    )


def write_region_series(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Only the (metric, aggregation) partitions present in ``df`` are replaced."""
    _write(df, path, fmt)


def write_ranking(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df, path, fmt)
