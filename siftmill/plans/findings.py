"""The findings warehouse: from hits to stored issues, filters, paging, export and purge."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.functions.text import snippet, split_lines
from siftmill.operators.catalog import with_metadata
from siftmill.schemas import SEVERITIES
from siftmill.session import freed_shuffles, materialize, remove_folder, scratch, work_dir

# Page sizes and the severity ranks.
DEFAULT_PAGE, MAX_PAGE = 50, 200
BUCKETS = 32
#: Removed projects of a table that every task is told; beyond it the rows that stay are exchanged.
BROADCAST_IDS = 250_000

EXPORT_CSV = ["file", "line", "rule_id", "rule_name", "severity", "category", "message", "suggestion", "owasp_category"]


# -- hits to issues ---------------------------------------------------------------------------------------------


def attach_snippets(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Cut the surrounding lines for hits that do not carry them.

    Hits are folded to one row per file first, so each text is joined once and cut for all of its hits; hits of
    files that are not given keep a NULL snippet. Where ``files`` are laid out by key (``sources.layout``), the hits
    come to the texts and no text is exchanged.
    """
    columns = [c for c in hits.columns if c not in ("project_id", "file")]
    per_file = hits.groupBy("project_id", "file").agg(F.collect_list(F.struct(*columns)).alias("hits"))
    texts = files.select("project_id", F.col("path").alias("file"), "text")
    joined = per_file.join(texts, ["project_id", "file"], "left").withColumn("lines", split_lines(F.col("text")))
    cut = F.transform("hits", lambda h: F.struct(h.alias("h"), snippet(F.col("lines"), h["line"]).alias("code_snippet")))
    return joined.select("project_id", "file", F.explode(cut).alias("x")).select("project_id", "file", "x.h.*", "x.code_snippet")


def dependency_hits(findings: DataFrame) -> DataFrame:
    """Dependency findings in the shape of issues: line 0, message ``package: summary``."""
    return findings.select(
        "project_id", "file", F.lit(0).alias("line"), F.lit(0).alias("column"), "rule_id",
        F.concat("package", F.lit(": "), "summary").alias("message"), "suggestion", F.lit(None).cast("string").alias("code_snippet"),
        F.col("severity").alias("found_severity"),
    )


def dependency_rollup(counted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Counted dependency findings (project_id, rule_id, severity, issues) in the shape of ``reports.rollup``."""
    named = with_metadata(counted.withColumnRenamed("severity", "found_severity"), catalog)
    return named.select("project_id", "rule_id", "rule_name", F.coalesce("found_severity", "severity").alias("severity"), "category", "owasp_category", "issues")


def to_issues(hits: DataFrame, catalog: DataFrame, scan_id: str | Column, ts: Column) -> DataFrame:
    """Issue rows with repeatable ids: a digest of the finding and its ordinal among equal findings."""
    scan = F.lit(scan_id) if isinstance(scan_id, str) else scan_id
    if "code_snippet" not in hits.columns:
        hits = hits.withColumn("code_snippet", F.lit(None).cast("string"))
    if "found_severity" not in hits.columns:
        hits = hits.withColumn("found_severity", F.lit(None).cast("string"))
    # equal findings meet under two longs instead of their texts; the snippet tells which of them comes first
    told = F.concat_ws("\x1f", scan, "project_id", "file", "line", "column", "rule_id", "message", F.coalesce("suggestion", F.lit("")), F.coalesce("found_severity", F.lit("")))
    same = Window.partitionBy("_k1", "_k2").orderBy("code_snippet")
    marked = hits.withColumn("_told", F.sha2(told, 256)).withColumns({"_k1": F.xxhash64("_told"), "_k2": F.xxhash64(F.lit(1), "_told")})
    named = with_metadata(marked.withColumn("ordinal", F.row_number().over(same)), catalog)
    identity = F.concat_ws("\x1f", told, "ordinal")
    return named.select(
        F.sha2(identity, 256).alias("issue_id"), "project_id", scan.alias("scan_id"), "file", F.col("line").cast("int"),
        F.col("column").cast("int"), F.lit(None).cast("int").alias("end_line"), "rule_id", "rule_name",
        F.coalesce("found_severity", "severity").alias("severity"), "category", "message", "suggestion", "owasp_category",
        "code_snippet", ts.alias("ts"),
    )


# -- filters: DataFrame to DataFrame ----------------------------------------------------------------------------


def of_project(issues: DataFrame, project_id: str) -> DataFrame:
    return issues.filter(F.col("project_id") == project_id)


def of_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues.filter(F.col("severity") == severity.upper())


def not_of_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues.filter(F.col("severity") != severity.upper())


def of_category(issues: DataFrame, category: str) -> DataFrame:
    return issues.filter(F.col("category") == category.upper())


def file_contains(rows: DataFrame, part: str) -> DataFrame:
    """Files with ``part`` in their name; ASCII case is ignored and '%' and '_' are wildcards."""
    return rows.filter(F.col("file").ilike(f"%{part}%"))


def of_rule(issues: DataFrame, rule_id: str) -> DataFrame:
    return issues.filter(F.col("rule_id") == rule_id)


def of_language(issues: DataFrame, language: str) -> DataFrame:
    """By file suffix; only python and javascript are known, other values filter nothing."""
    endings = {"python": [".py"], "javascript": [".js", ".ts", ".jsx", ".tsx"]}.get(language.lower(), [])
    keep = None
    for ending in endings:
        test = F.col("file").ilike(f"%{ending}")
        keep = test if keep is None else keep | test
    return issues if keep is None else issues.filter(keep)


def dependency_issues(issues: DataFrame) -> DataFrame:
    return of_category(issues, "DEPENDENCY").select(
        "project_id", "issue_id", "file", "rule_id", "severity", "message", "suggestion", "owasp_category", "ts"
    )


def select_issues(issues: DataFrame, project_id: str | None = None, severity: str | None = None, category: str | None = None,
                  language: str | None = None, file: str | None = None, rule_id: str | None = None,
                  exclude_severity: str | None = None) -> DataFrame:
    """All filters of the issue list, each optional."""
    steps = [(of_project, project_id), (of_severity, severity), (of_category, category), (file_contains, file),
             (of_rule, rule_id), (of_language, language), (not_of_severity, exclude_severity)]
    for apply, value in steps:
        if value:
            issues = apply(issues, value)
    return issues


# -- order and pages --------------------------------------------------------------------------------------------


def severity_rank(severity: Column) -> Column:
    out = F.lit(-1)
    for rank, name in enumerate(SEVERITIES):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def issue_order(by_rank: bool = False) -> list[Column]:
    """Severity descending (as text, or by rank), newest first, id as the tie-break."""
    first = severity_rank(F.col("severity")).desc() if by_rank else F.col("severity").desc()
    return [first, F.col("ts").desc(), F.col("issue_id").asc()]


def by_severity_text(issues: DataFrame, by_rank: bool = False) -> DataFrame:
    return issues.orderBy(*issue_order(by_rank))


def rank_index(issues: DataFrame, path: str | None = None, by_rank: bool = False) -> str:
    """Store the list in order, with an index, and return its folder: any page of it then opens the parts that hold it.

    ``rows`` holds the range-partitioned sort, one folder per part; ``parts`` holds, per part, the number of rows in it and
    before it. The order ends in the id, so equal severities and times spread over parts and no task sees all rows.
    """
    spark = issues.sparkSession
    path = (path or f"{work_dir(spark)}/ranked-{uuid.uuid4().hex}").rstrip("/")
    ordered = by_severity_text(issues, by_rank).select(
        "*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("at")
    )
    ordered.sortWithinPartitions("part", "at").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    # One row per part, so a running sum over them is small however long the list is.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = spark.read.schema(_ranked_schema(issues)).parquet(f"{path}/rows")
    rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    spark.createDataFrame([], issues.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/none")  # for pages beyond the end
    return path


def _ranked_schema(issues: DataFrame) -> T.StructType:
    return T.StructType([*issues.schema.fields, T.StructField("at", T.LongType()), T.StructField("part", T.IntegerType())])


def ranked(issues: DataFrame, by_rank: bool = False) -> DataFrame:
    """Every issue with its position in the list order, without one task seeing all rows."""
    spark, path = issues.sparkSession, rank_index(issues, by_rank=by_rank)
    rows, parts = spark.read.schema(_ranked_schema(issues)).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/parts").drop("n")
    return rows.join(parts, "part").withColumn("position", F.col("before") + F.col("at")).drop("part", "at", "before")


def indexed_page(spark: SparkSession, path: str, page: int = 1, per_page: int = DEFAULT_PAGE) -> DataFrame:
    """One page of a stored list (``rank_index``), in order, at any depth: the index names the parts that hold it, and of
    these only the page's rows are read. That is one part, or two where the page lies across an end; more only of parts
    with fewer rows than a page."""
    if page < 1:
        raise ValueError("page must be >= 1")
    first = (page - 1) * _checked(per_page)
    parts = spark.read.parquet(f"{path}/parts").filter((F.col("before") < first + per_page) & (F.col("before") + F.col("n") > first)).collect()
    if not parts:
        return spark.read.parquet(f"{path}/none")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/part={p['part']}" for p in parts])
    held = F.lit(False)
    for p in parts:
        held = held | ((F.col("part") == p["part"]) & (F.col("at") >= first - p["before"]) & (F.col("at") < first + per_page - p["before"]))
    return rows.filter(held).orderBy("part", "at").drop("part", "at")


def _checked(per_page: int) -> int:
    if not 1 <= per_page <= MAX_PAGE:
        raise ValueError(f"per_page must be within 1..{MAX_PAGE}")
    return per_page


def issue_page(issues: DataFrame, page: int = 1, per_page: int = DEFAULT_PAGE, by_rank: bool = False) -> DataFrame:
    """One page in list order, by number, without an index: a top-k of all rows up to the page's end, in one task at last.

    For first pages of any selection. Deep pages of a list are for ``indexed_page``; ``issues_after`` walks on from a page at hand.
    """
    if page < 1:
        raise ValueError("page must be >= 1")
    return by_severity_text(issues, by_rank).offset((page - 1) * _checked(per_page)).limit(per_page)


def issues_after(issues: DataFrame, severity: str, ts: object, issue_id: str, per_page: int = DEFAULT_PAGE, by_rank: bool = False) -> DataFrame:
    """The page that follows an issue in list order: a filter and a top-k at any depth."""
    first = (severity_rank(F.col("severity")), severity_rank(F.lit(severity))) if by_rank else (F.col("severity"), F.lit(severity))
    later = (first[0] < first[1]) | ((first[0] == first[1]) & ((F.col("ts") < F.lit(ts)) | ((F.col("ts") == F.lit(ts)) & (F.col("issue_id") > issue_id))))
    return by_severity_text(issues.filter(later), by_rank).limit(_checked(per_page))


def issue_total(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count("*").alias("total"))


# -- storage and export -----------------------------------------------------------------------------------------


def bucket_of(project_id: Column) -> Column:
    return F.pmod(F.xxhash64(project_id), F.lit(BUCKETS)).cast("int")


def write_table(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Store rows by project bucket.

    A folder per project would make as many folders as projects; buckets are bounded. The rebalance hint lets AQE
    split the bucket of an over-large project over several tasks and merge small ones. What was exchanged takes several times the
    table's place; it is freed once the table is written.
    """
    with freed_shuffles(rows.sparkSession):
        (
            rows.withColumn("project_bucket", bucket_of(F.col("project_id"))).hint("rebalance", F.col("project_bucket"))
            .sortWithinPartitions("project_bucket", "project_id").write.mode(mode).option("compression", "zstd").partitionBy("project_bucket").parquet(path)
        )


def read_table(spark: SparkSession, path: str | list[str], project_id: str | None = None) -> DataFrame:
    """Stored rows of a table, or of several alike; a project filter prunes to one bucket and, by row-group statistics, to its rows."""
    rows = None
    for p in [path] if isinstance(path, str) else path:
        own = spark.read.parquet(p)
        rows = own if rows is None else rows.unionByName(own)
    if project_id is not None:
        rows = rows.filter((F.col("project_bucket") == bucket_of(F.lit(project_id))) & (F.col("project_id") == project_id))
    return rows.drop("project_bucket")


def without_projects(table: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of projects that stay. ``removed`` is any table of project ids; AQE picks the join by its measured size."""
    return table.join(removed.select("project_id").distinct(), "project_id", "left_anti")


def purge(spark: SparkSession, tables: dict[str, str], removed: DataFrame) -> dict[str, list[int]]:
    """Take the removed projects out of every stored table, in place; the buckets that were written anew, per table.

    Only buckets that hold a removed project are read and written (dynamic partition overwrite); all other files stay as they
    are. A bucket that keeps nothing goes with its folder. Run again after a failure, it does the rest: a bucket is
    swapped as a whole, and one that is done holds no removed project any more.
    """
    gone = removed.select("project_id").distinct().withColumns({"project_bucket": bucket_of(F.col("project_id")), "gone": F.lit(True)})
    out = {}
    with scratch(spark):
        for name, path in tables.items():
            rows = spark.read.parquet(path)
            # the table's projects, which its files hold sorted, so that a task sends each once; they decide for all rows
            present = rows.select("project_bucket", "project_id").distinct()
            marked = materialize(present.join(gone, ["project_bucket", "project_id"], "left").withColumn("gone", F.coalesce("gone", F.lit(False))), "present")
            states = marked.groupBy("project_bucket").agg(F.bool_or("gone").alias("hit"), F.bool_or(~F.col("gone")).alias("left")).collect()  # BUCKETS rows at most
            hit, left = sorted(r["project_bucket"] for r in states if r["hit"]), {r["project_bucket"] for r in states if r["left"]}
            out[name] = hit
            staying = [b for b in hit if b in left]
            if staying:
                dropped = marked.filter("gone").select("project_bucket", "project_id")
                few = dropped.count() <= BROADCAST_IDS  # then tasks read, filter and write their files, and no row is exchanged
                kept = rows.filter(F.col("project_bucket").isin(staying)).join(F.broadcast(dropped) if few else dropped, ["project_bucket", "project_id"], "left_anti")
                kept = kept.select(*rows.columns)
                (
                    (kept if few else kept.hint("rebalance", F.col("project_bucket"))).sortWithinPartitions("project_bucket", "project_id").write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("project_bucket").parquet(path)
                )
            for bucket in hit:
                if bucket not in left:
                    remove_folder(spark, f"{path.rstrip('/')}/project_bucket={bucket}")
    return out


def csv_rows(issues: DataFrame) -> DataFrame:
    """The project and the nine exported columns; absent names, suggestions and labels become ''."""
    optional = {"rule_name", "suggestion", "owasp_category"}
    return issues.select("project_id", *[F.coalesce(c, F.lit("")).alias(c) if c in optional else F.col(c) for c in EXPORT_CSV])


def export_csv(issues: DataFrame, path: str) -> None:
    """Severity-ordered CSV parts with a header; part files in name order hold the whole order."""
    rows = issues.orderBy(F.col("severity").desc(), "file", "line", "rule_id", "issue_id")
    csv_rows(rows).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def json_rows(issues: DataFrame) -> DataFrame:
    return issues.select("project_id", *EXPORT_CSV, "code_snippet")


def json_header(issues: DataFrame, projects: DataFrame) -> DataFrame:
    """One header row per project: its name, language and total; the issues stay rows, as a project may be any size."""
    totals = issues.groupBy("project_id").agg(F.count("*").alias("total_issues"))
    return projects.select("project_id", "name", "language").join(totals, "project_id", "left").select(
        F.struct(F.col("project_id").alias("id"), "name", "language").alias("project"), F.coalesce("total_issues", F.lit(0)).alias("total_issues")
    )


def export_json(issues: DataFrame, projects: DataFrame, path: str) -> None:
    json_header(issues, projects).write.mode("overwrite").json(f"{path}/header")
    rows = issues.orderBy(F.col("severity").desc(), "file", "line", "rule_id", "issue_id")
    # each issue repeats all names and much of its text: as plain text the export is many times what its rows hold
    json_rows(rows).write.option("compression", "gzip").mode("overwrite").json(f"{path}/issues")
