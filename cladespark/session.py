"""Sessions with the settings that the operators are tuned for."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package: on one machine from where the driver has it, on a cluster from a copy that Spark ships."""
    if not spark.sparkContext.master.startswith("local"):
        ship(spark)
        return
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once."""
    context = spark.sparkContext
    if not any(f.startswith("cladespark-") for f in context._python_includes):
        folder = tempfile.mkdtemp(prefix="cladespark-")
        context.addPyFile(shutil.make_archive(f"{folder}/cladespark-package", "zip", ROOT, "cladespark"))


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the folder in ``spark.checkpoint.dir`` and go on from there. In local mode, and only there, an unset one becomes a temporary folder."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return frame.checkpoint()


def session(name: str = "cladespark", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew splitting, UTC times, Arrow; on a cluster leave ``master`` and partitions to it."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
