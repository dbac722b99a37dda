"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "pressmill", cores: str = "*", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster use the session it provides."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PRESSMILL_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="pressmill-")


def frozen(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from it.

    Lost executors cost nothing of what was computed so far, and the planner
    knows the size of what follows. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/frozen-{uuid.uuid4().hex}"
    removed_at_end(spark, path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._frozen_at = path
    return found


def released(*tables: DataFrame) -> None:
    """Remove tables that ``frozen`` wrote, once all that reads them has been written itself."""
    for df in tables:
        path = getattr(df, "_frozen_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Shuffle files go when what shuffles is written, not when the driver collects its garbage; texts are a third smaller under zstd.
SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile, and the shuffles for them, take up little disk.

    No data frame that shuffles may be used for two actions here, but by way of ``frozen``.
    """
    before = {name: spark.conf.get(name, None) for name in SPARING}
    for name, value in SPARING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove ``path`` when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
