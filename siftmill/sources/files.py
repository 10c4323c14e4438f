"""Source files: discovery, decoding, language and line arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.text import split_lines

# Suffixes per language, folders that hold no source, and the size cap.
SUFFIXES = {
    "python": [".py"],
    "javascript": [".js", ".jsx", ".ts", ".tsx"],
    "sql": [".sql"],
    "csharp": [".cs"],
}
SKIPPED_FOLDERS = [
    ".git", "__pycache__", "node_modules", ".venv", "venv", "env", ".env", ".tox", ".pytest_cache",
    ".mypy_cache", "dist", "build", ".eggs",
]
PROJECT_SKIPPED_FOLDERS = ["node_modules", "__pycache__", ".git", "venv", ".venv"]
MAX_FILE_KB = 500


def suffix(path: Column) -> Column:
    """The last suffix of the file name, with its dot; '' when there is none or nothing stands before it."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?s)^.+(\.[^.]+)$", 1)


def language_of(path: Column) -> Column:
    """Language by case-sensitive suffix, ``unknown`` otherwise."""
    found = suffix(path)
    out = F.lit("unknown")
    for language, endings in SUFFIXES.items():
        out = F.when(found.isin(endings), F.lit(language)).otherwise(out)
    return out


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_source_path(path: Column) -> Column:
    """A supported suffix, and no folder on the way that is skipped, hidden or an egg-info."""
    skipped = F.exists(
        folders(path), lambda d: d.isin(SKIPPED_FOLDERS) | d.startswith(".") | d.endswith(".egg-info")
    )
    return suffix(path).isin([s for endings in SUFFIXES.values() for s in endings]) & ~skipped


def within_size(size_bytes: Column, max_kb: int | None = MAX_FILE_KB) -> Column:
    return F.lit(True) if max_kb is None else size_bytes <= max_kb * 1024


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as the scan writes it in its paths: with scheme, absolute, without ``.`` parts, ending in a slash."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString().rstrip("/") + "/"


def decode(content: Column) -> Column:
    """UTF-8 text with undecodable bytes dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def with_lines(files: DataFrame) -> DataFrame:
    """Add ``language`` by path and the ``lines`` array; a file stays one row."""
    if "language" not in files.columns:
        files = files.withColumn("language", language_of(F.col("path")))
    return files.withColumn("lines", split_lines(F.col("text")))


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1. Narrow: only the key and the line leave the file row."""
    return files.select(
        "project_id", "path", "language", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    ).select("project_id", "path", "language", (F.col("pos") + 1).alias("line_no"), "line")


def skipped_files(spark: SparkSession, root: str, max_kb: int) -> DataFrame:
    """(path, size_bytes) of the files that ``read_tree`` leaves out under an explicit ``max_kb``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.filter(~within_size(F.col("length"), max_kb)).select("path", F.col("length").alias("size_bytes"))


def read_tree(spark: SparkSession, root: str, max_kb: int | None = None) -> DataFrame:
    """Source files under ``root/<project>/…``; all of them, or those within ``max_kb`` (see ``skipped_files`` for the others)."""
    base = qualified(spark, root)
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .filter(within_size(F.col("length"), max_kb))
    )
    relative = F.substr(F.col("path"), F.lit(len(base) + 1), F.length("path"))
    return (
        raw.withColumn("rel", relative)
        .withColumn("project_id", F.substring_index("rel", "/", 1))
        .withColumn("rel", F.substr("rel", F.length("project_id") + 2, F.length("rel")))
        .filter(is_source_path(F.col("rel")))
        .select(
            "project_id",
            F.col("rel").alias("path"),
            language_of(F.col("rel")).alias("language"),
            F.col("length").alias("size_bytes"),
            decode(F.col("content")).alias("text"),
        )
    )


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """``requirements.txt`` and ``package.json`` at the top of each project: (project_id, manifest, text)."""
    names = ["requirements.txt", "package.json"]
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(names) + "}").load(f"{root.rstrip('/')}/*")
    parts = F.split("path", "/")
    return raw.select(
        F.element_at(parts, -2).alias("project_id"), F.element_at(parts, -1).alias("manifest"), decode(F.col("content")).alias("text")
    )


def project_languages(paths: DataFrame) -> DataFrame:
    """Main language per project from its file names; the suffix test here ignores case."""
    kept = paths.filter(~F.exists(folders(F.col("path")), lambda d: d.isin(PROJECT_SKIPPED_FOLDERS)))
    ending = F.lower(suffix(F.col("path")))
    counts = kept.groupBy("project_id").agg(
        F.count_if(ending == ".py").alias("py"), F.count_if(ending.isin(SUFFIXES["javascript"])).alias("js")
    )
    both = (F.col("py") > 0) & (F.col("js") > 0)
    return counts.select(
        "project_id",
        F.when(both, "mixed").when(F.col("js") > 0, "javascript").otherwise("python").alias("language"),
    )

