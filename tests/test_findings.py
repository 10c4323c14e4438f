from pathlib import Path

from pyspark.sql import functions as F

from siftmill.plans import findings as W, prompts, reports as R
from siftmill.schemas import ISSUES

SEVERITIES = ["INFO", "MINOR", "MAJOR", "CRITICAL", "BLOCKER"]


def issues(spark, n=230):
    rows = spark.range(n)
    i = F.col("id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    return rows.select(
        F.format_string("i%04d", i).alias("issue_id"), F.concat(F.lit("p"), (i % 3).cast("string")).alias("project_id"), F.lit("s").alias("scan_id"),
        F.concat(F.lit("src/"), (i % 11).cast("string"), pick([".py", ".js", ".TSX", ".sql"])).alias("file"), i.cast("int").alias("line"), F.lit(0).alias("column"),
        F.lit(None).cast("int").alias("end_line"), pick(["SEC003", "CS001"]).alias("rule_id"), F.when(i % 4 > 0, "name, \"quoted\"").alias("rule_name"),
        pick(SEVERITIES).alias("severity"), pick(["SECURITY", "CODE_SMELL", "DEPENDENCY"]).alias("category"), F.lit("SQL Injection").alias("message"),
        F.when(i % 5 > 0, "s\nt").alias("suggestion"), F.when(i % 2 == 0, "A03:2021-Injection").alias("owasp_category"), F.lit("code").alias("code_snippet"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (i % 7)).alias("ts"))


def test_pages_together_are_the_whole_list(spark):
    rows = issues(spark)
    whole = [r.issue_id for r in W.by_severity_text(rows).collect()]
    assert W.by_severity_text(rows).first().severity == "MINOR" and W.by_severity_text(rows, by_rank=True).first().severity == "BLOCKER"
    pages = [[r.issue_id for r in W.issue_page(rows, p, 50).collect()] for p in range(1, 7)]
    assert sum(pages, []) == whole and [len(p) for p in pages] == [50, 50, 50, 50, 30, 0]
    for by_rank in (False, True):
        listed = W.by_severity_text(rows, by_rank).collect()
        last = listed[129]
        assert W.issues_after(rows, last.severity, last.ts, last.issue_id, 60, by_rank).collect() == listed[130:190]
    ranked = {r.issue_id: r.position for r in W.ranked(rows.repartition(5)).collect()}
    assert [k for k, _ in sorted(ranked.items(), key=lambda x: x[1])] == whole and set(ranked.values()) == set(range(230))


def test_filters(spark):
    rows = issues(spark)
    assert W.select_issues(rows, language="javascript").filter("lower(file) not like '%.js' and lower(file) not like '%.tsx'").count() == 0
    assert W.select_issues(rows, language="cobol").count() == 230
    assert W.file_contains(rows, "SRC/1_").count() == rows.filter("file rlike '(?i)src/1.'").count()
    assert W.select_issues(rows, severity="info", exclude_severity="INFO").count() == 0
    assert {r.category for r in W.dependency_issues(rows).join(rows.select("issue_id", "category"), "issue_id").select("category").distinct().collect()} == {"DEPENDENCY"}


def test_distributions_add_up(spark):
    rows = issues(spark)
    for column in ("severity", "category"):
        assert R.distribution(rows, column).agg(F.sum("count")).first()[0] == 230
    assert R.distribution(rows, "owasp_category").agg(F.sum("count")).first()[0] == 115
    assert R.scan_severities(rows).agg(F.sum("total_issues")).first()[0] == 230
    assert [r.name for r in R.chart_distribution(rows, "category").collect()][0] == "CODE SMELL"


def test_documents_per_project(spark):
    rows = issues(spark)
    projects = spark.createDataFrame([("p0", "zero", "/0", "python"), ("p9", "nine", "/9", None)], "project_id string, name string, path string, language string")
    scans = spark.createDataFrame([(f"s{i}", "p0", i) for i in range(25)], "scan_id string, project_id string, n int").select(
        "scan_id", "project_id", F.lit("completed").alias("status"), F.col("n").cast("bigint").alias("total_issues"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("blocker_count", "critical_count", "major_count", "minor_count", "info_count", "files_scanned", "lines_scanned")],
        F.lit(1.0).alias("scan_duration_seconds"), F.timestamp_seconds(F.col("n")).alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    metrics = spark.createDataFrame([("p0", f"f{i}", "cyclomatic_complexity", "CC", float(i)) for i in range(30)], "project_id string, file string, metric_type string, metric_name string, value double")
    docs = {r.project.id: r for r in R.project_summaries(projects, rows, scans).collect()}
    assert docs["p0"].latest_scan.total_issues == 24 and docs["p9"].latest_scan is None and docs["p9"].severity_distribution is None
    assert sum(x["count"] for x in docs["p0"].severity_distribution) == 77 and len(docs["p0"].top_files) == 10
    dash = {r.project.id: r for r in R.project_dashboards(projects, rows, scans, metrics).collect()}
    assert [x.scan_id for x in dash["p0"].scan_history] == [f"s{i}" for i in range(24, 4, -1)]
    assert [x.value for x in dash["p0"].complexity_hotspots] == [float(v) for v in range(29, 9, -1)] and dash["p9"].project.language == "unknown"
    assert sum(x["count"] for x in dash["p0"].top_rules) == 77


def test_store_export_and_purge(spark, tmp_path):
    rows = issues(spark)
    path = str(tmp_path / "issues")
    W.write_table(rows, path)
    assert W.read_table(spark, path).count() == 230
    plan = W.read_table(spark, path, "p1")
    assert plan.count() == rows.filter("project_id = 'p1'").count()
    assert "PartitionFilters: [isnotnull(project_bucket" in plan._jdf.queryExecution().toString()
    W.export_csv(rows, str(tmp_path / "csv"))
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert csv.columns == ["project_id", *W.EXPORT_CSV] and csv.count() == 230
    assert csv.filter("rule_name = 'name, \"quoted\"'").count() == rows.filter("rule_name is not null").count()
    projects = spark.createDataFrame([("p0", "zero", "python"), ("p9", "none", None)], "project_id string, name string, language string")
    W.export_json(rows, projects, str(tmp_path / "json"))
    header = {r.project.id: r.total_issues for r in spark.read.json(str(tmp_path / "json/header")).collect()}
    assert header == {"p0": 77, "p9": 0} and spark.read.json(str(tmp_path / "json/issues")).count() == 230


def test_issue_ids_tell_equal_findings_apart(spark):
    from siftmill.operators.catalog import rule_catalog

    hits = spark.createDataFrame([("p", "a.py", 3, 0, "PERF001", "m", "s")] * 2, "project_id string, file string, line int, `column` int, rule_id string, message string, suggestion string")
    rows = W.to_issues(hits, rule_catalog(spark), "s", F.current_timestamp()).collect()
    assert len({r.issue_id for r in rows}) == 2 and rows[0].severity == "MINOR"
    assert [f"{n} {t}" for n, t in W.to_issues(hits, rule_catalog(spark), "s", F.current_timestamp()).select([F.col("`" + c + "`") for c in rows[0].asDict()]).dtypes] == [
        x.strip().replace("`", "") for x in ISSUES.split(",")]


def test_prompt_text(spark):
    row = issues(spark, 1).withColumn("code_snippet", F.lit(None).cast("string"))
    text = prompts.prompts(row).first().prompt
    assert "Rule     : SEC003 — \n" in text and "Message  : SQL Unsanitized Input\n" in text and "Standard : A03:2021\n" in text and "(not available)" in text


def test_user_rules_take_part_in_a_scan(spark, make_files):
    from siftmill.operators.extensions import RuleSet
    from siftmill.operators.line_rules import LineRule
    from siftmill.plans.scan import scan

    rules = RuleSet()
    rules.register_pattern(("USR001", "Marks", "INFO", "CODE_SMELL", None, ["javascript"], "Marks."), LineRule("USR001", ("javascript",), [("@@@", "Marks.")], "Remove them.", ["@@@"]))
    files = make_files(("a.js", "var x = 1;\n@@@"), ("b.py", "password = 'hunter2hunter2'\n"), ("c.py", "password = 'hunter2hunter2'\n)("))
    found = {(r.file, r.rule_id, r.severity): r.code_snippet for r in scan(files, rules=rules).issues.collect()}
    assert found["a.js", "USR001", "INFO"].endswith(">>> 2: @@@") and ("a.js", "JSCS002", "MINOR") in {k[:2] + ("MINOR",) for k in found}
    assert "b.py" in {k[0] for k in found if k[1] == "SEC003"} and "c.py" not in {k[0] for k in found}


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("part-*.parquet")}


def test_purge_rewrites_only_buckets_of_removed_projects(spark, tmp_path):
    rows = issues(spark, 600).withColumn("project_id", F.concat(F.lit("p"), (F.col("line") % 40).cast("string")))
    W.write_table(rows, str(tmp_path / "issues"))
    W.write_table(rows.select("project_id", "scan_id").distinct(), str(tmp_path / "scans"))
    paths = {n: str(tmp_path / n) for n in ("issues", "scans")}
    before = {n: files_of(tmp_path / n) for n in paths}
    gone = rows.filter("project_id in ('p2', 'p17')").union(rows.limit(1).withColumn("project_id", F.lit("unknown")))
    hit = W.purge(spark, paths, gone)
    assert hit["issues"] == hit["scans"] and 1 <= len(hit["issues"]) <= 2
    for name in paths:
        after = files_of(tmp_path / name)
        untouched = {f: t for f, t in before[name].items() if not any(f.startswith(f"project_bucket={b}/") for b in hit[name])}
        assert len(untouched) > 5 and untouched.items() <= after.items()
        assert not set(before[name]) & set(after) - set(untouched)
    left = W.read_table(spark, paths["issues"])
    assert sorted(r.issue_id for r in left.collect()) == sorted(r.issue_id for r in rows.collect() if r.project_id not in ("p2", "p17"))
    assert W.purge(spark, paths, gone) == {"issues": [], "scans": []}
    alone = rows.filter("project_id = 'p3'")
    W.write_table(alone, str(tmp_path / "alone"))
    assert len(W.purge(spark, {"alone": str(tmp_path / "alone")}, alone)["alone"]) == 1 and not files_of(tmp_path / "alone")


def test_a_page_at_any_depth_opens_two_parts_at_most(spark, tmp_path):
    rows = issues(spark, 3000).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for by_rank in (False, True):
            path = W.rank_index(rows, str(tmp_path / f"list-{by_rank}"), by_rank)
            assert spark.read.parquet(f"{path}/parts").count() >= 4
            whole = W.by_severity_text(rows, by_rank).collect()
            for page in (1, 2, 7, 15, 16):
                got = W.indexed_page(spark, path, page, 200)
                assert got.collect() == whole[200 * (page - 1) : 200 * page]
                folders = {f.split("/part=")[1].split("/")[0] for f in got.inputFiles() if "/part=" in f}
                assert len(folders) <= 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    empty = W.rank_index(rows.limit(0), str(tmp_path / "none"))
    assert W.indexed_page(spark, empty, 1, 50).count() == 0


def test_exported_issues_are_compressed_rows(spark, tmp_path):
    rows = issues(spark, 300)
    W.export_json(rows, rows.select("project_id").distinct().withColumns({"name": F.lit("n"), "language": F.lit("python")}), str(tmp_path / "json"))
    parts = list((tmp_path / "json" / "issues").rglob("part-*"))
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
    back = spark.read.schema("project_id string, file string, line int, rule_id string").json(str(tmp_path / "json" / "issues"))
    assert sorted(back.collect()) == sorted(rows.select(*back.columns).collect())


def test_purge_with_few_and_with_many_removed_projects(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    rows = issues(spark, 400).withColumn("project_id", F.when(F.col("line") % 40 > 0, F.concat(F.lit("p"), (F.col("line") % 40).cast("string"))))
    gone = rows.filter("project_id in ('p2', 'p17')")
    want = sorted(r.issue_id for r in rows.collect() if r.project_id not in ("p2", "p17"))
    for name, ids in (("few", W.BROADCAST_IDS), ("many", 1)):
        monkeypatch.setattr(W, "BROADCAST_IDS", ids)
        W.write_table(rows, str(tmp_path / name))
        W.purge(spark, {"issues": str(tmp_path / name)}, gone)
        assert sorted(r.issue_id for r in W.read_table(spark, str(tmp_path / name)).collect()) == want
        codecs = {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in (tmp_path / name).rglob("part-*.parquet")}
        assert codecs == {"ZSTD"}


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    """Tables of a stored scan are written one after the other: the next one finds the disk as it was."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    exchanged = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*")}
    before = exchanged()
    rows = spark.range(2000).selectExpr("concat('p', id % 50) AS project_id", "id AS n").repartition(3)
    W.write_table(rows, str(tmp_path / "t"))
    assert exchanged() <= before
    assert W.read_table(spark, str(tmp_path / "t")).agg(F.sum("n")).first()[0] == 1999 * 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
