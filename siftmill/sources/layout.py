"""A corpus laid out by file key, so that what is found in files meets their texts without moving a text.

Texts are exchanged once, when a corpus is laid out, into a Parquet table that is bucketed and sorted by project and path.
Every later join on (project, path) then brings its few rows to the bucket that holds the file. A key is one file, so
no bucket is hot but by the size of its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftmill.session import scratch_dir, scratch_table

KEY = ("project_id", "path")


def lay_out(files: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """``files`` written once to ``path`` (default: a scratch folder) and read back as a bucketed table.

    As many buckets as shuffle partitions, unless given: rows that are exchanged by the same key then land beside them.
    """
    spark = files.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"laid_out_{uuid.uuid4().hex}"
    writer = files.repartition(n, *KEY).write.format("parquet").bucketBy(n, *KEY).sortBy(*KEY)
    writer.option("path", path or f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    scratch_table(name)
    return spark.table(name)


def open_layout(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A corpus that an earlier session laid out with that many buckets."""
    name = f"laid_out_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    keys = ", ".join(KEY)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)
