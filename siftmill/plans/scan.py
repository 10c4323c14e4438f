"""A whole scan as one plan: files to issues, metrics, clone groups and scan records, for all projects at once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.operators import clones, deps, metrics
from siftmill.operators.catalog import rule_catalog
from siftmill.operators.extensions import RuleSet
from siftmill.operators.fact_rules import FACT_RULES, fact_rule_hits
from siftmill.operators.facts import imports, syntax_facts
from siftmill.operators.line_rules import text_rule_hits
from siftmill.operators.taint import CHANGES, FEEDS, LEAF_TYPES, NODE_TYPES, taint_hits
from siftmill.plans import findings, reports
from siftmill.session import materialize, remove_folder, scratch
from siftmill.sources.layout import lay_out
from siftmill.sources.manifests import declared

FACT_TYPES = sorted({t for r in FACT_RULES.values() for t in r.node_types} | set(NODE_TYPES) | {"Module"})
#: What a scan's plans read of these rows: the children of some types, the ancestors of some, of leaves only where they feed a flow.
WITH_CHILDREN = sorted({t for r in FACT_RULES.values() if r.children for t in r.node_types} | set(CHANGES) | {"Import", "ImportFrom"})
CHAINED = {t: FEEDS for t in LEAF_TYPES} | {t: None for r in FACT_RULES.values() if r.ancestors for t in r.node_types}


@dataclass
class Scan:
    """Lazy results; the facts table behind them has been written once."""

    files: DataFrame
    issues: DataFrame
    metrics: DataFrame
    clones: DataFrame
    facts: DataFrame
    manifests: DataFrame | None = None
    #: The rollup of ``issues`` where it costs less than to count them.
    rollups: DataFrame | None = None


def facts_of(files: DataFrame, stored: bool = True, whole: bool = False) -> DataFrame:
    """Facts for all rules; with what else the rows can carry, for plans that aren't known here, if they are to be ``whole``."""
    facts = syntax_facts(files, FACT_TYPES) if whole else syntax_facts(files, FACT_TYPES, children=WITH_CHILDREN, chained=CHAINED)
    return materialize(facts, "facts", "node_type") if stored else facts


def python_hits(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Fact rules and taint, with snippets cut where the file's text lies. Keyword flows carry no snippet, value flows the bare line."""
    hits = fact_rule_hits(facts).unionByName(taint_hits(facts))
    cut = findings.attach_snippets(hits, files)
    own = F.trim(F.regexp_extract("code_snippet", r"(?m)^>>> \d+: (.*)$", 1))
    taint = F.col("rule_id") == "TAINT001"
    return cut.withColumn(
        "code_snippet",
        F.when(taint & F.contains("message", F.lit(" via keyword arg ")), F.lit("")).when(taint, own).otherwise(F.col("code_snippet")),
    )


def file_hits(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Hits of all single-file kinds; which Python files parse is read off the facts."""
    parsed = facts.filter(F.col("node_type") == "Module").select("project_id", F.col("path").alias("file"))
    text = text_rule_hits(files, parsed=parsed, snippets=True)
    return text.unionByName(python_hits(files, facts).select(*text.columns))


def scan(files: DataFrame, manifests: DataFrame | None = None, advisories: DataFrame | None = None, scan_id: str = "scan",
         ts: Column | None = None, rules: RuleSet | None = None, laid_out: bool = False) -> Scan:
    """Run everything over ``files`` (project_id, path, language, text) and, if given, the projects' manifests and own rules.

    Files are laid out by key first, unless ``laid_out`` says that they are: no later step exchanges a text.
    """
    spark = files.sparkSession
    ts = ts if ts is not None else F.current_timestamp()
    files = files if laid_out else lay_out(files)
    facts = facts_of(files, whole=rules is not None)
    hits = file_hits(files, facts).withColumn("found_severity", F.lit(None).cast("string"))
    if rules is not None:
        own = findings.attach_snippets(rules.hits(files, facts), files)
        hits = hits.unionByName(own.withColumn("found_severity", F.lit(None).cast("string")).select(*hits.columns))
    catalog = rule_catalog(spark) if rules is None else rules.catalog(spark)
    if manifests is not None:
        wanted = materialize(declared(manifests), "declared")
        roots = materialize(deps.third_party(deps.import_roots(imports(facts)), deps.standard_modules(spark)), "imported")
        hits = hits.unionByName(findings.dependency_hits(deps.reconciled(wanted, roots)).select(*hits.columns))
    # Hits are sparse: written once, they keep the long rule plans apart from the grouping that follows.
    hits, rollups = materialize(hits, "hits"), None
    if manifests is not None and advisories is not None:
        # Advisories are not: projects times advisories. What they say of a version is written, its findings are made where they are read.
        pinned = deps.pinned(wanted)
        advised = materialize(deps.advised(pinned, advisories), "advised")
        rollups = reports.rollup(findings.to_issues(hits, catalog, scan_id, ts)).unionByName(
            findings.dependency_rollup(deps.counted(pinned, advised), catalog))
        hits = hits.unionByName(findings.dependency_hits(deps.spread_out(pinned, advised)).select(*hits.columns))
    issues = findings.to_issues(hits, catalog, scan_id, ts)
    measured = metrics.python_metrics(files, facts).unionByName(metrics.javascript_metrics(files))
    groups = clones.clone_groups(files)
    return Scan(files, issues, measured, groups, facts, manifests, rollups)


def sizes(result: Scan) -> DataFrame:
    """Files, lines and duplicate blocks per project.

    A project that has manifests but no source file is scanned too: it gets a row with no files and no lines.
    """
    files = reports.file_sizes(result.files)
    if result.manifests is not None:
        files = files.unionByName(result.manifests.select("project_id", F.lit(None).cast("int").alias("lines")))
    return reports.project_sizes(files, result.clones)


def summary(result: Scan) -> DataFrame:
    """Counters per project, of all kinds of findings."""
    return reports.summary_of(sizes(result), reports.rollup(result.issues) if result.rollups is None else result.rollups)


def scan_records(counters: DataFrame, scan_id: str, started: Column, completed: Column) -> DataFrame:
    """Scan rows: dependency findings count in the total, not in the severity counters."""
    return counters.select(
        F.lit(scan_id).alias("scan_id"), "project_id", F.lit("completed").alias("status"),
        (F.col("total_issues") + F.col("dependency_vulnerabilities")).alias("total_issues"),
        *[F.col(s).alias(f"{s}_count") for s in ("blocker", "critical", "major", "minor", "info")],
        "files_scanned", "lines_scanned",
        F.round(completed.cast("double") - started.cast("double"), 2).alias("scan_duration_seconds"),
        started.alias("started_at"), completed.alias("completed_at"),
    )


# -- stored scans -----------------------------------------------------------------------------------------------

_LOG = "scan_id string, state string, seq bigint, folder string, started_at timestamp, error string"


def _log(spark: SparkSession, target: str, scan_id: str, state: str, folder: str, started: datetime, error: str | None = None) -> None:
    """One more line of the target's commit log: a small Parquet file of its own, which appears whole or not at all."""
    row = spark.createDataFrame([(scan_id, state, time.time_ns(), folder, started, error)], _LOG)
    row.coalesce(1).write.mode("append").parquet(f"{target}/log")


def run(spark: SparkSession, target: str, scan_id: str, work: Callable[[], Scan]) -> str:
    """Work out a scan and store it under ``target``; its folder.

    The commit log says ``running`` before anything is worked out, and ``completed`` or ``failed`` when it has ended. Each run
    writes to a folder of its own, which readers open only once it is completed: what an earlier run of the same scan
    stored is read until then, and after a failure. Scratch tables of the run are removed either way.
    """
    target, started = target.rstrip("/"), datetime.now()
    folder = f"scan={uuid.uuid4().hex}"
    _log(spark, target, scan_id, "running", folder, started)
    try:
        with scratch(spark):
            _write(work(), f"{target}/{folder}", scan_id, F.lit(started))
    except Exception as error:
        _log(spark, target, scan_id, "failed", folder, started, str(error)[:2000])
        raise
    _log(spark, target, scan_id, "completed", folder, started)
    return folder


def store(result: Scan, target: str, scan_id: str) -> str:
    """``run`` for a scan that is at hand."""
    return run(result.files.sparkSession, target, scan_id, lambda: result)


def _write(result: Scan, folder: str, scan_id: str, started: Column) -> None:
    """Issues, metrics, their rollups and the scan's records; what only counts reads the rollups, never the issues."""
    spark = result.files.sparkSession
    findings.write_table(result.issues, f"{folder}/issues", "overwrite")
    issues = findings.read_table(spark, f"{folder}/issues")
    findings.write_table(result.metrics.withColumn("scan_id", F.lit(scan_id)).withColumn("ts", F.current_timestamp()), f"{folder}/metrics", "overwrite")
    findings.write_table(reports.rollup(issues), f"{folder}/rollups", "overwrite")
    findings.write_table(issues.groupBy("project_id", "file").agg(F.count(F.lit(1)).alias("issues")), f"{folder}/files", "overwrite")
    findings.write_table(sizes(result), f"{folder}/sizes", "overwrite")
    counters = reports.summary_of(findings.read_table(spark, f"{folder}/sizes"), findings.read_table(spark, f"{folder}/rollups"))
    findings.write_table(scan_records(counters, scan_id, started, F.current_timestamp()), f"{folder}/scans", "overwrite")


def scan_states(spark: SparkSession, target: str) -> DataFrame:
    """The last state of every scan of the log: (scan_id, status, folder, started_at, error)."""
    newest = Window.partitionBy("scan_id").orderBy(F.col("seq").desc())
    log = spark.read.schema(_LOG).parquet(f"{target.rstrip('/')}/log")
    return log.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select("scan_id", F.col("state").alias("status"), "folder", "started_at", "error")


def _committed(spark: SparkSession, target: str, scan_id: str | None) -> list[str]:
    """The folder of each scan's last completed run: one name per scan."""
    log = spark.read.schema(_LOG).parquet(f"{target.rstrip('/')}/log").filter("state = 'completed'")
    log = log if scan_id is None else log.filter(F.col("scan_id") == scan_id)
    newest = Window.partitionBy("scan_id").orderBy(F.col("seq").desc())
    return sorted(r["folder"] for r in log.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select("folder").collect())


def stored(spark: SparkSession, target: str, name: str, project_id: str | None = None, scan_id: str | None = None) -> DataFrame:
    """``issues``, ``metrics``, ``scans``, ``sizes``, ``files`` or ``rollups`` of all completed scans, or of one; buckets
    without the project are not opened."""
    folders = _committed(spark, target, scan_id)
    if not folders:
        raise ValueError(f"no completed scan under {target}")
    return findings.read_table(spark, [f"{target.rstrip('/')}/{f}/{name}" for f in folders], project_id)


def scans_with_states(spark: SparkSession, target: str) -> DataFrame:
    """Records of completed scans, and one row without project and counts for each scan that runs or has failed."""
    open_ = scan_states(spark, target).filter("status <> 'completed'")
    if not _committed(spark, target, None):
        return open_.select("scan_id", F.lit(None).cast("string").alias("project_id"), "status", "started_at", "error")
    done = stored(spark, target, "scans").withColumn("error", F.lit(None).cast("string"))
    return done.unionByName(open_.drop("folder"), allowMissingColumns=True)


def vacuum(spark: SparkSession, target: str) -> list[str]:
    """Remove the folders of failed runs and of runs that a later one has replaced; those of runs that still run stay."""
    target = target.rstrip("/")
    newest = Window.partitionBy("folder").orderBy(F.col("seq").desc())
    log = spark.read.schema(_LOG).parquet(f"{target}/log").withColumn("_n", F.row_number().over(newest)).filter("_n = 1 and state <> 'running'")
    gone = sorted({r["folder"] for r in log.select("folder").collect()} - set(_committed(spark, target, None)))
    for folder in gone:
        remove_folder(spark, f"{target}/{folder}")
    return gone
