"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, keep instants in UTC and batches for Python small."""
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # rows with whole texts or contexts pass to Python: fewer at a time keep a batch small where texts are long
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a temporary one only where none is named and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_kept: dict[tuple, tuple[object, DataFrame]] = {}


def files_state(spark: SparkSession, folder: str) -> tuple:
    """What changes when a table in a folder is rewritten: names, sizes and times of the files up to a level below it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen = [*system.globStatus(jvm.org.apache.hadoop.fs.Path(path, "*.parquet")), *system.globStatus(jvm.org.apache.hadoop.fs.Path(path, "*.parquet/*"))]
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in seen))


def kept(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A small frame that a study reads many times, kept by Spark while the files of its folder ``key[1]`` stay as they are.

    Spark drops it to disk when short of memory and rebuilds parts that are lost with an executor.
    """
    full = (spark.sparkContext.applicationId, *key)
    state = files_state(spark, key[1])
    if full in _kept and _kept[full][0] != state:
        _kept.pop(full)[1].unpersist()
    if full not in _kept:
        _kept[full] = (state, build().persist())
    return _kept[full][1]


def local(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.driver.memory": memory,
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
    }
    spark = prepared(builder.config(map=conf).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
