"""Reports over projects, scans, issues and metrics. Distributions come from one pass; per-project lists are top-k
windows, which Spark limits per task before the shuffle, so an over-large project does not gather in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.text import split_lines
from siftmill.schemas import SEVERITIES, SEVERITY_WEIGHTS
from siftmill.sources.files import language_of

# List lengths of the reports.
TOP_FILES, TOP_RULES, HOTSPOTS, RECENT_SCANS, PROJECT_SCANS = 10, 10, 20, 10, 20


def distribution(issues: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Issue counts per value of a column, NULL left out, over all or per project."""
    return issues.filter(F.col(column).isNotNull()).groupBy(*(by or []), column).agg(F.count("*").alias("count"))


def overview(projects: DataFrame, scans: DataFrame, issues: DataFrame) -> DataFrame:
    one = projects.agg(F.count("*").alias("total_projects"))
    two = scans.agg(F.count_if(F.col("status") == "completed").alias("total_scans"))
    three = issues.agg(F.count("*").alias("total_issues"))
    # Three one-row aggregates side by side.
    return one.join(F.broadcast(two)).join(F.broadcast(three))


def scan_severities(issues: DataFrame) -> DataFrame:
    """Five severity counters per scan, absent ones 0; dependency findings are left out of the counters."""
    code = F.col("category") != "DEPENDENCY"
    return issues.groupBy("project_id", "scan_id").agg(
        F.count("*").alias("total_issues"),
        *[F.count_if(code & (F.col("severity") == s)).alias(f"{s.lower()}_count") for s in reversed(SEVERITIES)],
    )


def language_breakdown(issues: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Issues (not files) per language of their file."""
    return issues.groupBy(*(by or []), language_of(F.col("file")).alias("language")).agg(F.count("*").alias("issues"))


def language_files(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Files (not issues) per language."""
    return files.groupBy(*(by or []), language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def severity_score(issues: DataFrame, by: list[str]) -> DataFrame:
    weight = F.lit(0)
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == name, value).otherwise(weight)
    return issues.groupBy(*by).agg(F.sum(weight).alias("score"))


def file_sizes(files: DataFrame) -> DataFrame:
    """(project_id, lines) of every source file; a NULL text has no lines and is still a file."""
    return files.select("project_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(split_lines(F.col("text")))).alias("lines"))


def project_sizes(files: DataFrame, clones: DataFrame) -> DataFrame:
    """(project_id, files_scanned, lines_scanned, duplicated_blocks).

    ``files`` needs (project_id, lines), lines NULL for what names a project but isn't a source file; ``clones`` one
    row per duplicate group.
    """
    counted = files.groupBy("project_id").agg(F.count("lines").alias("files_scanned"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines_scanned"))
    blocks = clones.groupBy("project_id").agg(F.count("*").alias("duplicated_blocks"))
    return counted.join(blocks, "project_id", "left").withColumn("duplicated_blocks", F.coalesce("duplicated_blocks", F.lit(0)))


def rollup(issues: DataFrame) -> DataFrame:
    """Issues counted by all that reports group by. Counts add up over scans and projects, so reports read these rows only."""
    return issues.groupBy("project_id", "rule_id", "rule_name", "severity", "category", "owasp_category").agg(F.count(F.lit(1)).alias("issues"))


def summary_of(sizes: DataFrame, rollups: DataFrame) -> DataFrame:
    """Files, lines, findings, dependency findings and duplicate blocks of each project, from its sizes and rollup."""
    dependency = F.coalesce(F.col("category") == "DEPENDENCY", F.lit(False))
    total = lambda test: F.sum(F.when(test, F.col("issues")).otherwise(0))
    counts = rollups.groupBy("project_id").agg(
        total(~dependency).alias("total_issues"), total(dependency).alias("dependency_vulnerabilities"),
        *[total(~dependency & (F.col("severity") == s)).alias(s.lower()) for s in SEVERITIES],
    )
    joined = sizes.join(counts, "project_id", "left")
    numbers = ["total_issues", "dependency_vulnerabilities", "duplicated_blocks", *[s.lower() for s in SEVERITIES]]
    return joined.select("project_id", "files_scanned", "lines_scanned", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def scan_summary(files: DataFrame, issues: DataFrame, clones: DataFrame) -> DataFrame:
    """``summary_of`` for issues at hand, which need project_id, severity and category only."""
    counted = issues.groupBy("project_id", "severity", "category").agg(F.count(F.lit(1)).alias("issues"))
    return summary_of(project_sizes(files, clones), counted)


def global_dashboard(projects: DataFrame, scans: DataFrame, rollups: DataFrame, files: DataFrame) -> DataFrame:
    """One document over all projects: totals, distributions, the newest scans and the files with most issues.

    ``rollups`` and ``files`` (file, issues) are the rollups beside stored scans; no issue is read. Lists hold the known
    severities, categories and labels, or ten rows.
    """
    def shares(column: str) -> DataFrame:
        rows = rollups.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum("issues").alias("count"))
        return rows.agg(F.array_sort(F.collect_list(F.struct(F.col(column), "count"))).alias(column))

    def listed(rows: DataFrame, order: list[Column], k: int, name: str) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order))  # of k rows
        first = rows.orderBy(*order).limit(k).withColumn("place", place)
        return first.agg(F.array_sort(F.collect_list(F.struct("place", *rows.columns))).alias(name))

    totals = [
        projects.agg(F.count("*").alias("total_projects")), scans.agg(F.count_if(F.col("status") == "completed").alias("total_scans")),
        rollups.agg(F.coalesce(F.sum("issues"), F.lit(0)).alias("total_issues")),
    ]
    newest = scans.select(F.col("scan_id").alias("id"), "project_id", "status", "total_issues", "critical_count", "major_count", "scan_duration_seconds", "started_at")
    parts = [
        shares("severity"), shares("category"), shares("owasp_category"),
        listed(newest, [F.col("started_at").desc(), F.col("id")], RECENT_SCANS, "recent_scans"),
        listed(files.groupBy("file").agg(F.sum("issues").alias("issue_count")), [F.col("issue_count").desc(), F.col("file")], TOP_FILES, "top_files"),
    ]
    out = totals[0]
    for one in [*totals[1:], *parts]:
        out = out.join(F.broadcast(one))  # one-row aggregates side by side
    dropped = lambda c: F.transform(c, lambda x: x.dropFields("place"))
    return out.select(
        F.struct("total_projects", "total_scans", "total_issues").alias("overview"), F.col("severity").alias("severity_distribution"),
        F.col("category").alias("category_distribution"), F.col("owasp_category").alias("owasp_distribution"),
        dropped("recent_scans").alias("recent_scans"), dropped("top_files").alias("top_files_by_issues"),
    )


def latest_scans(scans: DataFrame) -> DataFrame:
    """Newest scan per project, by partial maximum."""
    row = F.struct("started_at", "scan_id", *[c for c in scans.columns if c not in ("started_at", "scan_id", "project_id")])
    return scans.groupBy("project_id").agg(F.max_by(row, F.struct("started_at", "scan_id")).alias("latest")).select("project_id", "latest.*")


def projects_with_latest_scan(projects: DataFrame, scans: DataFrame) -> DataFrame:
    newest = latest_scans(scans).drop("project_id_")
    return projects.join(newest, "project_id", "left")


def scan_history(scans: DataFrame) -> DataFrame:
    return scans.orderBy(F.col("started_at").desc(), "scan_id")


def projects_newest_first(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.col("created_at").desc(), "project_id")


def metrics_newest_first(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.col("ts").desc(), "file", "metric_type", "metric_name")


def top_files(issues: DataFrame, k: int = TOP_FILES) -> DataFrame:
    return issues.groupBy("file").agg(F.count("*").alias("issue_count")).orderBy(F.col("issue_count").desc(), "file").limit(k)


def top_rules(issues: DataFrame, k: int = TOP_RULES) -> DataFrame:
    return issues.groupBy("rule_id", "rule_name").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "rule_id", "rule_name").limit(k)


def hotspots(metrics: DataFrame, k: int = HOTSPOTS) -> DataFrame:
    rows = metrics.filter(F.col("metric_type") == "cyclomatic_complexity")
    return rows.select("project_id", "file", "metric_name", "value").orderBy(F.col("value").desc(), "project_id", "file", "metric_name").limit(k)


def recent_scans(scans: DataFrame, k: int = RECENT_SCANS) -> DataFrame:
    return scans.orderBy(F.col("started_at").desc(), "scan_id").limit(k)


def top_per_project(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each project, with their place. The rank filter lets each task keep k rows per project."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def project_scan_history(scans: DataFrame, k: int = PROJECT_SCANS) -> DataFrame:
    return top_per_project(scans, [F.col("started_at").desc(), F.col("scan_id")], k)


def chart_distribution(issues: DataFrame, column: str) -> DataFrame:
    """A distribution as charts show it: '_' as a blank, largest first."""
    return distribution(issues, column).select(F.replace(column, F.lit("_"), F.lit(" ")).alias("name"), F.col("count").alias("value")).orderBy(
        F.col("value").desc(), "name"
    )


def _distributions(issues: DataFrame) -> DataFrame:
    """Severity, category and label counts per project from one scan: arrays of at most 5, 7 and 10 structs."""
    issues = issues.select("project_id", "severity", "category", "owasp_category")
    sets = issues.groupingSets(
        [["project_id", "severity"], ["project_id", "category"], ["project_id", "owasp_category"]],
        "project_id", "severity", "category", "owasp_category",
    ).agg(F.grouping_id().alias("gid"), F.count("*").alias("count"))

    def pick(gid: int, column: str) -> Column:
        chosen = F.when((F.col("gid") == gid) & F.col(column).isNotNull(), F.struct(F.col(column), F.col("count")))
        return F.array_sort(F.collect_list(chosen)).alias(f"{column.removesuffix('_category')}_distribution")

    return sets.groupBy("project_id").agg(pick(3, "severity"), pick(5, "category"), pick(6, "owasp_category"))


def _packed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Ranked rows of a project as one ordered array (bounded by the rank filter)."""
    packed = F.array_sort(F.collect_list(F.struct("place", *columns)))
    unplaced = F.transform(packed, lambda s: F.struct(*[s[c].alias(c) for c in columns]))
    return rows.groupBy("project_id").agg(unplaced.alias(name))


def _files_per_project(issues: DataFrame) -> DataFrame:
    counts = issues.groupBy("project_id", "file").agg(F.count("*").alias("count"))
    return top_per_project(counts, [F.col("count").desc(), F.col("file")], TOP_FILES)


def _rules_per_project(issues: DataFrame) -> DataFrame:
    counts = issues.groupBy("project_id", "rule_id", "rule_name").agg(F.count("*").alias("count"))
    return top_per_project(counts, [F.col("count").desc(), F.col("rule_id"), F.col("rule_name")], TOP_RULES)


def project_summaries(projects: DataFrame, issues: DataFrame, scans: DataFrame) -> DataFrame:
    """One document per project: newest scan, three distributions and the top files."""
    newest = latest_scans(scans).select(
        "project_id", F.struct("total_issues", "blocker_count", "critical_count", "major_count", "minor_count", "info_count",
                               "files_scanned", "lines_scanned").alias("latest_scan"))
    head = projects.select("project_id", F.struct(F.col("project_id").alias("id"), "name", "language").alias("project"))
    return (
        head.join(newest, "project_id", "left").join(_distributions(issues), "project_id", "left")
        .join(_packed(_files_per_project(issues), "top_files", "file", "count"), "project_id", "left")
    )


def project_dashboards(projects: DataFrame, issues: DataFrame, scans: DataFrame, metrics: DataFrame) -> DataFrame:
    """One dashboard document per project."""
    complexity = metrics.filter(F.col("metric_type") == "cyclomatic_complexity").select("project_id", "file", "metric_name", "value")
    hot = top_per_project(complexity, [F.col("value").desc(), F.col("file"), F.col("metric_name")], HOTSPOTS)
    history = ["scan_id", "status", "total_issues", "critical_count", "major_count", "files_scanned", "lines_scanned",
               "scan_duration_seconds", "started_at", "completed_at"]
    head = projects.select("project_id", F.struct(F.col("project_id").alias("id"), "name", "path",
                                                  F.coalesce("language", F.lit("unknown")).alias("language")).alias("project"))
    return (
        head.join(_distributions(issues), "project_id", "left")
        .join(_packed(project_scan_history(scans), "scan_history", *history), "project_id", "left")
        .join(_packed(_rules_per_project(issues), "top_rules", "rule_id", "rule_name", "count"), "project_id", "left")
        .join(_packed(hot, "complexity_hotspots", "file", "metric_name", "value"), "project_id", "left")
    )
