"""Session helpers shared by the library."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Used only where the cluster names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_homes: set[str] = set()


def local_session(cores: str | int = "*", app: str = "passage_engine", **conf: str) -> SparkSession:
    """A session for one machine: tests, the bench and notebooks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    On a cluster without a shared code folder, submit with ``--py-files`` instead; both can be used together.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset; on a cluster that is an error, as executors would not see each
    other's files.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = LOCAL_CHECKPOINTS
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The file system that holds a path, and the maker of its paths."""
    maker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return maker(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), maker


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that a job writes and reads again.

    All of an application's scratch tables are in one folder, which goes when the driver's JVM ends; ``remove`` frees one
    earlier.
    """
    home = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if home not in _homes:
        fs, path = file_system(spark, home)
        fs.mkdirs(path(home))
        fs.deleteOnExit(path(home))
        _homes.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through the file system that holds it."""
    fs, maker = file_system(spark, path)
    fs.delete(maker(path), True)
