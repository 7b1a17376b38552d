"""Folders for checkpoints and intermediate tables."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}  # one temporary root per application


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one temporary folder per application, only in local mode.

    What jobs leave there belongs to the caller, who clears it when no table made from it is in use any more.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.applicationId not in _local:
        _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="gridloom-")
    return _local[spark.sparkContext.applicationId]


def work_folder(spark: SparkSession, prefix: str = "work") -> str:
    """A fresh folder under the shared root."""
    return f"{shared_root(spark)}/{prefix}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages all see these rows, even after losing executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once per application, hand this package's code to the executors (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = pathlib.Path(__file__).resolve().parents[1]
        to = pathlib.Path(tempfile.mkdtemp(prefix="gridloom-code-"))
        sc.addPyFile(shutil.make_archive(str(to / "gridloom_code"), "zip", root, "gridloom"))
        _shipped.add(sc.applicationId)
