"""Session set-up shared by the bench, the tests and command-line use."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: The folder of the innermost ``scratch`` block, if any, and the names of tables registered in it.
_SCRATCH: ContextVar[tuple[str, list[str]] | None] = ContextVar("scratch", default=None)


def get_session(app: str = "siftmill", cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster the caller passes its own session to every operator instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        .config("spark.driver.memory", os.environ.get("SIFTMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's checkpoint folder, or one in the warehouse where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work").rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """Where tables of the running ``scratch`` block go, or ``work_dir`` outside of one."""
    block = _SCRATCH.get()
    return block[0] if block else work_dir(spark)


def scratch_table(name: str) -> None:
    """Have the running ``scratch`` block, if any, drop a catalog table at its end."""
    block = _SCRATCH.get()
    if block:
        block[1].append(name)


def materialize(df: DataFrame, label: str, order_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: one computation for many readers, with column pruning.

    A written table survives lost executors and cuts lineage; it is used for the syntax facts, which feed
    several branches of a scan. With ``order_by`` each task sorts its own rows, so that readers that filter on that column
    skip row groups and pages by their statistics; one file a task, unlike a folder per value.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(order_by) if order_by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of whatever store the path names; one that isn't there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Whether the shuffle files of a query are removed as soon as it has ended.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside this block take their shuffle files with them; else these stay until the driver's JVM happens to
    collect what refers to them, and tables that are written one after the other pile up theirs."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside this block are removed at its end, also after a failure."""
    folder = f"{work_dir(spark)}/scratch-{uuid.uuid4().hex}"
    tables: list[str] = []
    mark = _SCRATCH.set((folder, tables))
    try:
        yield
    finally:
        _SCRATCH.reset(mark)
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(spark, folder)
