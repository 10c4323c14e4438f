"""Duplicate blocks: identical windows of six stripped lines within a project.

Two phases. First only a digest of two longs (taken from the SHA-256 of the block) leaves the file row and is counted, with
map-side partial sums, so a block that fills a third of the corpus is folded before the shuffle. Then places are
worked out for the windows whose digest was found more than once, and for nothing else: the first one by a rank that each
task limits before the shuffle, all of them as rows. A preview is cut from the file of the first place; where the
corpus is laid out by file key (``sources.layout``), the text stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.text import is_blank, split_lines, starts_trimmed, strip

WINDOW_LINES = 6
PREVIEW_CHARS = 200
_KEY = ["project_id", "h1", "h2"]


def _windows(files: DataFrame, size: int) -> DataFrame:
    """(project_id, path, start_line, h1, h2) of every window with enough live lines."""
    lines = files.select("project_id", "path", split_lines(F.col("text")).alias("raw"))
    rows = lines.filter(F.size("raw") >= size).select(
        "project_id", "path", F.transform("raw", strip).alias("lines"),
        F.transform("raw", lambda x: F.when(is_blank(x) | starts_trimmed(x, ["#"]), 0).otherwise(1)).alias("live"),
    )
    starts = F.sequence(F.lit(1), F.size("lines") - size + 1)

    def window(start: Column) -> Column:
        live = F.aggregate(F.slice(F.col("live"), start, size), F.lit(0), lambda acc, x: acc + x)
        return F.when(live >= size // 2, F.struct(start.alias("start_line"), F.sha2(F.array_join(F.slice(F.col("lines"), start, size), "\n"), 256).alias("sha")))

    found = F.filter(F.transform(starts, window), lambda w: w.isNotNull())
    return rows.select("project_id", "path", F.explode(found).alias("w")).select(
        "project_id", "path", "w.start_line", F.xxhash64("w.sha").alias("h1"), F.xxhash64(F.lit(1), "w.sha").alias("h2")
    )


def _repeated(windows: DataFrame) -> DataFrame:
    """Digests of blocks found more than once in a project, counted."""
    return windows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def _digest() -> Column:
    return F.lower(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))).alias("digest")


def clone_groups(files: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """(project_id, digest, occurrences, first_file, first_line) of blocks found more than once."""
    windows = _windows(files, size)
    first = F.row_number().over(Window.partitionBy(*_KEY).orderBy("path", "start_line"))
    # a hot digest is a hot key with one row on the side of the counts: AQE splits it, and each task keeps one row of it
    return (
        windows.join(_repeated(windows), _KEY).withColumn("place", first).filter("place = 1")
        .select("project_id", _digest(), "occurrences", F.col("path").alias("first_file"), F.col("start_line").alias("first_line"))
    )


def clone_count(files: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """(project_id, digest, occurrences): the groups without their places, from the first phase alone."""
    return _repeated(_windows(files, size)).select("project_id", _digest(), "occurrences")


def clone_report(files: DataFrame, size: int = WINDOW_LINES, laid_out: DataFrame | None = None) -> DataFrame:
    """Groups with the preview of the block, taken from the file of the first place.

    ``laid_out``: the same files laid out by key; their texts then aren't exchanged. A file's groups are folded first,
    so its text is joined and split once.
    """
    per_file = clone_groups(files, size).groupBy("project_id", F.col("first_file").alias("path")).agg(
        F.collect_list(F.struct("occurrences", "first_line")).alias("groups"))
    texts = (files if laid_out is None else laid_out).select("project_id", "path", "text")
    joined = per_file.join(texts, ["project_id", "path"]).select("project_id", "path", "groups", F.transform(split_lines(F.col("text")), strip).alias("lines"))
    cut = F.transform("groups", lambda g: F.struct(
        F.substring(F.array_join(F.slice(F.col("lines"), g["first_line"], size), "\n"), 1, PREVIEW_CHARS).alias("block_preview"),
        g["occurrences"].alias("occurrences"), g["first_line"].alias("first_line")))
    return joined.select("project_id", F.col("path").alias("first_file"), F.explode(cut).alias("g")).select(
        "project_id", "g.block_preview", "g.occurrences", "first_file", "g.first_line")


def clone_locations(files: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """Every location of every group, one row each. A hot block is a hot join key: AQE splits it, the group side is one row."""
    windows = _windows(files, size)
    return windows.join(_repeated(windows), _KEY).select(
        "project_id", _digest(), "occurrences", F.col("path").alias("file"), "start_line", (F.col("start_line") + size - 1).alias("end_line")
    )


def merged_locations(files: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """Optional view: runs of consecutive duplicate windows of a file as one span (partitions are single files)."""
    rows = clone_locations(files, size).select("project_id", "file", "start_line", "end_line").distinct()
    run = F.col("start_line") - F.row_number().over(Window.partitionBy("project_id", "file").orderBy("start_line"))
    return rows.withColumn("run", run).groupBy("project_id", "file", "run").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")
    ).drop("run")
