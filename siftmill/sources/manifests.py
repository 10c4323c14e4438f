"""Dependency manifests and advisory dumps as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.text import let, split_lines, strip
from siftmill.schemas import ADVISORIES, RANGES

_NAME = r"^([a-zA-Z0-9_.-]+)"
_PINNED = r"^([a-zA-Z0-9_.-]+)\s*[=~><]+\s*([0-9][^\s;#]*)"


def clean_version(version: Column) -> Column:
    """Drop everything before the first digit."""
    return F.regexp_replace(version, "^[^0-9]*", "")


def requirements(manifests: DataFrame) -> DataFrame:
    """Declared packages of ``requirements.txt`` rows (project_id, manifest, text), in file order."""
    rows = manifests.filter(F.col("manifest") == "requirements.txt").select(
        "project_id", "manifest", F.posexplode(split_lines(F.col("text"))).alias("ord", "raw")
    ).withColumn("spec", strip(F.col("raw")))
    kept = rows.filter((F.col("spec") != "") & ~F.col("spec").startswith("#") & ~F.col("spec").startswith("-"))
    pinned = F.regexp_extract("spec", "(?U)" + _PINNED, 1)
    return kept.select(
        "project_id", F.lit("PyPI").alias("ecosystem"), "manifest", "ord",
        F.when(pinned != "", pinned).otherwise(F.regexp_extract("spec", _NAME, 1)).alias("name"),
        F.regexp_extract("spec", "(?U)" + _PINNED, 2).alias("version"),
    ).filter("name <> ''")


def _last_of_keys(entries: Column) -> Column:
    """Of entries with one key the last, in the order given: by a sort, so that one long manifest isn't compared pair by pair."""
    placed = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value")))
    lasts = let(F.array_sort(placed), lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1)["key"] != x["key"], F.lit(True))))
    in_order = F.array_sort(F.transform(lasts, lambda x: F.struct(x["at"].alias("at"), x["key"].alias("key"), x["value"].alias("value"))))
    return F.transform(in_order, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


def package_json(manifests: DataFrame) -> DataFrame:
    """Declared packages of ``package.json`` rows: dependencies, then devDependencies; invalid JSON gives none."""
    shape = "dependencies map<string,string>, devDependencies map<string,string>"
    rows = manifests.filter(F.col("manifest") == "package.json").withColumn("j", F.from_json("text", shape))
    out = None
    for at, section in enumerate(("dependencies", "devDependencies")):
        # of a repeated key the last value counts; values that are no plain text are no versions
        one = rows.select("project_id", "manifest", F.inline(_last_of_keys(F.map_entries(f"j.{section}"))).alias("name", "spec")).filter(~F.trim("spec").rlike(r"^[\[{]")).select(
            "project_id", F.lit("npm").alias("ecosystem"), "manifest", F.lit(at).alias("ord"), "name", clean_version(F.col("spec")).alias("version")
        )
        out = one if out is None else out.unionByName(one)
    return out


def declared(manifests: DataFrame) -> DataFrame:
    return requirements(manifests).unionByName(package_json(manifests))


def read_advisories(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An advisory dump with the declared schema (Parquet or JSON lines); without affected ranges they are NULL."""
    return spark.read.schema(f"{ADVISORIES}, {RANGES}").format(fmt).load(path)
