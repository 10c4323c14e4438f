"""What several operators need: the shared folder, written tables, and prefix sums that never pass one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code points that separate words in every contract here: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of one (chunk, key) window at most; see ``gapless``.
CHUNK_ROWS = 32_768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or a folder of the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work").rstrip("/")


#: Per application the folders of scratch tables that stages of a pipeline have written, the running one's last.
_STAGES: dict[str, list[str]] = {}


def next_stage(docs: DataFrame | None, spark: SparkSession) -> None:
    """Have ``written`` and ``laid_out`` use a new folder from now on, and remove those before of which ``docs``, what the next
    stage reads, holds no file: their stages' outputs are written.

    For pipelines whose stages follow each other in one session. None ends the pipeline: tables go to the shared folder again.
    """
    application = spark.sparkContext.applicationId
    read = docs.inputFiles() if docs is not None and _STAGES.get(application) else []
    kept = []
    for folder in _STAGES.pop(application, []):
        if any(f"/{folder.rpartition('/')[2]}/" in f for f in read):
            kept.append(folder)
        else:
            remove(spark, folder)
    if docs is not None:
        _STAGES[application] = [*kept, f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"]


def remove(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{_STAGES.get(spark.sparkContext.applicationId, [shared_dir(spark)])[-1]}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    The table cuts the lineage and outlives lost executors. Values that depend on how tasks were dealt (row numbers)
    are fixed from then on.
    """
    path = _fresh(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files that a task of ``laid_out`` writes side by side, and bytes of a row group: what they buffer is bounded by the product.
OPEN_FILES, ROW_GROUP = 4, 16 << 20
#: Rows that come to Python at a time while ``laid_out`` writes: whole texts wait on both sides, and what an executor took for them it keeps.
TEXTS_AT_ONCE = 500


def laid_out(df: DataFrame, key: str, label: str) -> DataFrame:
    """As ``written``, bucketed by ``key``, which is to name runs of rows that lie together (``_chunk``, a task): nothing is
    exchanged to write it, and a join on ``key`` alone then exchanges the other side only, whatever its size.

    A task has few keys, so their files are open side by side and nothing is sorted; a task with more sorts by bucket.
    """
    spark = df.sparkSession
    path = _fresh(spark, label)
    name = f"laid_out_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = {"spark.sql.maxConcurrentOutputFileWriters": OPEN_FILES, "spark.sql.execution.arrow.maxRecordsPerBatch": TEXTS_AT_ONCE}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, str(v))
    try:
        df.write.format("parquet").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("path", path).bucketBy(n, key).saveAsTable(name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.table(name)


def bitmaps(rows: DataFrame, **flags: Column) -> DataFrame:
    """One row per ``_chunk`` with, for each flag, the bitmap of the ``_pos`` where it holds (NULL: nowhere); see ``bit``."""
    return rows.groupBy("_chunk").agg(*[F.bitmap_construct_agg(F.when(test, F.col("_pos"))).alias(name) for name, test in flags.items()])


def bit(bitmap: Column, pos: Column) -> Column:
    """Whether the bit is set; false in a NULL bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (pos % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def decided(base: DataFrame, maps: DataFrame) -> DataFrame:
    """``base``, laid out by ``_chunk``, beside the bitmaps of its chunk; rows of chunks without bitmaps go."""
    return base.join(maps.hint("shuffle_hash"), "_chunk")


def shielded(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``used`` renamed so that an operator's own columns can't clash, and the way back."""
    names = {c: c if c in used else f"_given{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def words(text: Column) -> Column:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]`` of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """``size(words(text))``: the parts between blanks but for an empty one at either end."""
    parts = F.size(F.split(text, "[ \\t-\\r]+"))
    blank = [F.lit(b) for b in BLANKS]
    ends = F.substring(text, 1, 1).isin(*blank).cast("int") + F.substring(text, -1, 1).isin(*blank).cast("int")
    return F.when(text.rlike("[^ \\t-\\r]"), parts - ends).otherwise(0).cast("long")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``_chunk`` and ``_pos``: chunks of at most CHUNK_ROWS rows of one partition, and the place in them.

    Stable only once written.
    """
    at = F.monotonically_increasing_id()
    return df.withColumn("_at", at).withColumns({"_chunk": F.expr(f"_at div {CHUNK_ROWS}"), "_pos": F.expr(f"_at % {CHUNK_ROWS}")}).drop("_at")


def gapless(df: DataFrame, keys: list[str], name: str, chunk: str = "_chunk", order: list[str] | None = None) -> DataFrame:
    """Number the rows of each key 0, 1, 2, … by chunk, then by ``order`` (``_pos``), with no key gathered in one task.

    Rows are ranked inside (key, chunk) and moved up by the number of the key's rows in earlier chunks. Keys and chunks
    aren't null; the counts hold one row per (key, chunk), so chunks are to be of about equal, bounded size.
    """
    counts = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, chunk, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*(order or ["_pos"]))
    ranked = df.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(bases, [*keys, chunk]).withColumn(name, (F.col("_rank") + F.col("_base")).cast("long")).drop("_rank", "_base")
