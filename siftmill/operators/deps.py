"""Reconciliation of declared and imported packages, and advisories for declared versions."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.versions import LAST, major, point_nodes, range_nodes, version_key
from siftmill.session import materialize

# Install names whose import names differ. All others import under their own name.
IMPORT_NAMES = {
    "pillow": ["PIL"],
    "scikit-learn": ["sklearn"],
    "beautifulsoup4": ["bs4"],
    "pyyaml": ["yaml"],
    "python-dotenv": ["dotenv"],
    "opencv-python": ["cv2"],
    "langchain-openai": ["langchain_openai"],
    "langchain-core": ["langchain_core"],
    "langchain-community": ["langchain_community"],
    "numpy": ["numpy", "np"],
    "pandas": ["pandas", "pd"],
    "psycopg2-binary": ["psycopg2"],
    "python-jose": ["jose"],
    "python-multipart": ["multipart"],
    "email-validator": ["email_validator"],
    "attrs": ["attr", "attrs"],
    "cattrs": ["cattr"],
    "more-itertools": ["more_itertools"],
    "setuptools": ["setuptools", "pkg_resources"],
}


def standard_modules(spark: SparkSession) -> DataFrame:
    """Top-level modules of the standard library: about 300 short rows, safe to broadcast."""
    return spark.createDataFrame([(m,) for m in sorted(sys.stdlib_module_names)], "module string")


def local_modules(files: DataFrame) -> DataFrame:
    """(project_id, module): what a project's own Python files can be imported as, with or without a leading ``src`` folder."""
    own = files.filter(F.col("language") == "python").select("project_id", F.regexp_extract("path", r"^(?:src/)?([^/]+?)(?:\.py)?(?:/|$)", 1).alias("module"))
    return own.filter("module <> ''").distinct()


def import_roots(imports: DataFrame, relative: bool = True) -> DataFrame:
    """Distinct top-level modules imported per project; partial distinct before the shuffle. ``relative=False`` leaves out
    ``from .x import y``, which names a module of the project itself."""
    imports = imports if relative else imports.filter(F.coalesce("level", F.lit(0)) == 0)
    dotted = F.when(F.col("node_type") == "Import", F.col("name")).otherwise(F.col("module"))
    return (
        imports.select("project_id", F.substring_index(dotted, ".", 1).alias("module"))
        .filter(F.col("module").isNotNull() & (F.col("module") != "")).distinct()
    )


def third_party(roots: DataFrame, standard: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Roots that aren't of the standard library nor, where ``local`` (``local_modules``) is given, of the project itself."""
    roots = roots if local is None else roots.join(local.hint(_MERGE), ["project_id", "module"], "left_anti")
    return roots.join(F.broadcast(standard), "module", "left_anti").select("project_id", "module")


def import_names(package: Column) -> Column:
    """Names a package may be imported under: the listed ones, or its lower-case name with '-' and with '_'."""
    lower = F.lower(package)
    table = F.create_map(*[x for name, imports in IMPORT_NAMES.items() for x in (F.lit(name), F.array(*[F.lit(i) for i in imports]))])
    return F.coalesce(F.try_element_at(table, lower), F.array_distinct(F.array(lower, F.replace(lower, F.lit("-"), F.lit("_")))))


def declared_names(declared: DataFrame) -> DataFrame:
    """One row per declared row and possible import name."""
    return declared.filter("ecosystem = 'PyPI'").select("project_id", "ord", "name", "version", F.explode(import_names(F.col("name"))).alias("module"))


#: Joins here are merges by hint: stored rows of projects and packages are so short that by the size of their files Spark would
#: have the driver gather millions of them for a broadcast.
_MERGE = "merge"

_DEP = ["project_id", "file", "package", "version", "rule_id", "severity", "summary", "suggestion"]


def unused(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """Declared rows none of whose names is imported."""
    names = declared_names(declared).join(imported.withColumn("hit", F.lit(1)).hint(_MERGE), ["project_id", "module"], "left")
    rows = names.groupBy("project_id", "ord", "name", "version").agg(F.max("hit").alias("hit")).filter("hit is null")
    quoted = F.concat(F.lit("'"), "name", F.lit("'"))
    return rows.select(
        "project_id", F.lit("requirements.txt").alias("file"), F.col("name").alias("package"), "version",
        F.lit("DEP002").alias("rule_id"), F.lit("MINOR").alias("severity"),
        F.concat(quoted, F.lit(" is declared in requirements.txt but never imported in any .py file.")).alias("summary"),
        F.concat(F.lit("Remove "), quoted, F.lit(" from requirements.txt if it is not needed, or verify it is used as a runtime plugin/entry-point.")).alias("suggestion"),
    )


def undeclared(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported third-party modules that no declared package covers, in projects that declare anything."""
    declaring = declared.filter("ecosystem = 'PyPI'").select("project_id").distinct()
    rows = (
        imported.join(declaring.hint(_MERGE), "project_id", "left_semi")
        .join(declared_names(declared).select("project_id", "module").distinct().hint(_MERGE), ["project_id", "module"], "left_anti")
    )
    quoted = F.concat(F.lit("'"), "module", F.lit("'"))
    return rows.select(
        "project_id", F.lit("requirements.txt").alias("file"), F.col("module").alias("package"), F.lit("").alias("version"),
        F.lit("DEP003").alias("rule_id"), F.lit("MAJOR").alias("severity"),
        F.concat(quoted, F.lit(" is imported in source code but not declared in requirements.txt.")).alias("summary"),
        F.concat(F.lit("Add "), quoted, F.lit(" to requirements.txt to ensure reproducible installs.")).alias("suggestion"),
    )


def advisory_severity(details: Column) -> Column:
    """Severity from words in the details, as substrings."""
    text = F.lower(F.coalesce(details, F.lit("")))
    return (
        F.when(text.rlike("critical|remote code execution|rce"), "CRITICAL").when(text.rlike("high|injection|overflow"), "MAJOR")
        .when(text.rlike("medium|moderate|xss"), "MINOR").otherwise("INFO")
    )


_TELLS = ["ecosystem", "package", "version", "vuln_id", "summary", "details"]


def affected(versions: DataFrame, advisories: DataFrame) -> DataFrame:
    """Which distinct (ecosystem, package, version) each advisory hits: by equal version, or inside one of its ranges.

    A range begins at ``introduced`` (NULL, '' or 0: from the start) and ends before ``fixed`` or with ``last_affected``
    (neither: no end). Ranges become nodes of a tree over major versions, of which a version has one per level: an equality join, after
    which keys that sort like versions decide. An advisory hits a version once, however many of its ranges hold it. Ranges are dealt
    in shares, to each of which the versions come: very many may lie in one node.
    """
    hits = versions.join(advisories.hint(_MERGE), ["ecosystem", "package", "version"]).select(*_TELLS, "refs")
    if "ranges" in advisories.columns:
        points = versions.withColumn("key", version_key(F.col("version"))).filter("key is not null")
        points = points.select("ecosystem", "package", "version", "key", F.explode(point_nodes(major(F.col("version")))).alias("n")).select("*", "n.*").drop("n")
        end = lambda c: F.when(F.trim(c).isin("", "0"), None).otherwise(c)
        ranges = advisories.select("ecosystem", "package", "vuln_id", "summary", "details", "refs", F.explode("ranges").alias("r"))
        ranges = ranges.withColumns({"low": end(F.col("r.introduced")), "fixed": end(F.col("r.fixed")), "last": end(F.col("r.last_affected"))})
        first, last = F.coalesce(major(F.col("low")), F.lit(0)), F.least(*[F.coalesce(F.when(F.col(c).isNotNull(), major(F.col(c))), F.lit(LAST)) for c in ("fixed", "last")])
        ranges = ranges.select(
            "ecosystem", "package", "vuln_id", "summary", "details", "refs", version_key(F.col("low")).alias("k1"), version_key(F.col("fixed")).alias("k2"),
            version_key(F.col("last")).alias("k3"), F.explode(range_nodes(F.when(F.col("low").isNull(), 0).otherwise(first), last)).alias("n"),
        ).select("*", "n.*").drop("n")
        inside = (F.coalesce(F.col("key") >= F.col("k1"), F.lit(True)) & F.coalesce(F.col("key") < F.col("k2"), F.lit(True))
                  & F.coalesce(F.col("key") <= F.col("k3"), F.lit(True)))
        met = met_in_shares(points, ranges, ["ecosystem", "package", "level", "node"]).filter(inside)
        hits = hits.unionByName(met.select(*hits.columns))
    return hits.dropDuplicates(_TELLS)


#: Shares of the declared rows of a version: as many tasks can word the findings of one that very many projects declare.
SHARES = 8


def pinned(declared: DataFrame) -> DataFrame:
    """Declared rows that name a version."""
    return declared.filter("version <> ''").select("project_id", F.col("manifest").alias("file"), "ecosystem", F.col("name").alias("package"), "version")


def advised(versions: DataFrame, advisories: DataFrame) -> DataFrame:
    """What the advisories say of each distinct (ecosystem, package, version): a row per version and advisory, worded."""
    return affected(versions.select("ecosystem", "package", "version").distinct(), advisories).select(
        "ecosystem", "package", "version", F.lit("DEP001").alias("rule_id"), advisory_severity(F.col("details")).alias("severity"),
        F.coalesce("summary", F.lit("No summary available")).alias("summary"),
        F.concat(F.lit("Review "), "package", F.lit(" usage.")).alias("suggestion"),
        F.coalesce("vuln_id", F.lit("UNKNOWN")).alias("vuln_id"), "refs",
    )


def met_in_shares(rows: DataFrame, many: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` beside all of ``many`` (advisories, or what they say) that have their key.

    Few and short rows on both sides make very many together, which Spark, going by the bytes that it reads, leaves to a task or
    two. ``many`` are dealt by key and share into a given number of parts, the other rows come to each of the shares. A merge holds
    the share of one key at a time.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = [*keys, "_share"]
    dealt = many.withColumn("_share", F.pmod(F.xxhash64("vuln_id", "summary"), F.lit(SHARES)).cast("int")).repartition(parts, *keys)
    shared = rows.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return shared.join(dealt.hint(_MERGE), keys)


def spread_out(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Declared rows beside all that is said of their version."""
    return met_in_shares(rows, found, ["ecosystem", "package", "version"])


def vulnerable(declared: DataFrame, advisories: DataFrame) -> DataFrame:
    """Advisories for the declared versions, exact ones and those in an affected range, all references kept.

    Versions meet advisories as distinct ones, so that a package that a third of all projects declare costs a few rows;
    what they hit, worded once per version and advisory, then meets the declared rows. Both are written first: the declared
    rows are read three times.
    """
    rows = materialize(pinned(declared), "pinned")
    return spread_out(rows, materialize(advised(rows, advisories), "advised")).select(
        "project_id", "file", "package", "version", "rule_id", "severity", "summary", "suggestion", "vuln_id", "refs")


def counted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(project_id, rule_id, severity, issues): how many rows ``spread_out`` has, counted on both sides before they meet."""
    keys = ["ecosystem", "package", "version"]
    told = found.groupBy(*keys, "rule_id", "severity").agg(F.count(F.lit(1)).alias("told"))
    held = rows.groupBy("project_id", *keys).agg(F.count(F.lit(1)).alias("held"))
    return held.join(told.hint(_MERGE), keys).groupBy("project_id", "rule_id", "severity").agg(F.sum(F.col("told") * F.col("held")).alias("issues"))


def reconciled(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """What is declared and not imported, and the other way round."""
    return unused(declared, imported).unionByName(undeclared(declared, imported))


def dependency_findings(declared: DataFrame, imported: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """All dependency findings; both inputs feed several branches, so each is worked out and written once."""
    declared, imported = materialize(declared, "declared"), materialize(imported, "imported")
    found = reconciled(declared, imported)
    return found if advisories is None else found.unionByName(vulnerable(declared, advisories).select(*_DEP))
