from pyspark.sql import functions as F

from siftmill.operators.line_rules import text_rule_hits
from siftmill.plans.scan import facts_of, file_hits
from siftmill.sources.files import language_of
from siftmill.streaming import history, scan_stream

SCHEMA = "project_id string, path string, text string"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, target, full = (str(tmp_path / n) for n in ("in", "hits", "full"))
    land(spark, source, [("p", "a.js", "debugger\nx == 1"), ("p", "b.py", "token = 'x'\nx = input()\neval(x)")])
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source).withColumn("language", language_of(F.col("path")))
    run = lambda: scan_stream.start_text_scan(stream(), target, target + "-c").awaitTermination()
    run()
    land(spark, source, [("p", "c.sql", "SELECT * FROM t;")])
    run()
    scan_stream.start_full_scan(stream(), full, full + "-c").awaitTermination()
    batch = text_rule_hits(spark.read.parquet(source).withColumn("language", language_of(F.col("path"))))
    key = lambda r: (r.file, r.line, r.rule_id)
    assert sorted(map(key, spark.read.parquet(target).collect())) == sorted(map(key, batch.collect()))
    got = {key(r) for r in scan_stream.current_issues(spark, full).collect()}
    assert {("b.py", 3, "SEC002"), ("b.py", 3, "TAINT001"), ("c.sql", 1, "SQL002"), ("a.js", 1, "JSEC009")} <= got


def test_a_changed_file_replaces_its_findings_and_an_unchanged_one_costs_nothing(spark, tmp_path):
    schema = "project_id string, path string, modified timestamp, text string"
    source, target, into = (str(tmp_path / n) for n in ("in", "out", "small"))
    stream = lambda: spark.readStream.schema(schema).parquet(source).withColumn("language", language_of(F.col("path")))
    now: dict = {}

    def land(at, *rows):
        for project, path, text in rows:
            now[project, path] = text
        spark.createDataFrame([(p, f, at + i, t) for i, (p, f, t) in enumerate(rows)], "project_id string, path string, s int, text string").select(
            "project_id", "path", F.timestamp_seconds("s").alias("modified"), "text").write.mode("append").parquet(source)

    def check(folder=target):
        files = spark.createDataFrame([(p, f, t) for (p, f), t in now.items() if t is not None], SCHEMA).withColumn("language", language_of(F.col("path")))
        want = file_hits(files, facts_of(files))
        key = lambda r: (r.project_id, r.file, r.line, r.rule_id, r.message, r.code_snippet)
        assert sorted(map(key, scan_stream.current_issues(spark, folder).collect())) == sorted(map(key, want.collect()))

    def scanned(number):
        return sorted(r.path for r in spark.read.parquet(f"{target}/versions/batch={number}").collect())

    land(0, ("p", "a.js", "debugger\nx == 1"), ("p", "b.py", "x = input()\neval(x)"), ("q", "a.js", "debugger"))
    scan_stream.start_full_scan(stream(), target, target + "-c").awaitTermination()
    check()
    # a changed, a repeated and a new file; one that lands twice counts with its newest text
    land(100, ("p", "a.js", "debugger"), ("p", "b.py", "x = input()\neval(x)"), ("p", "c.sql", "SELECT 1;"), ("p", "c.sql", "SELECT * FROM t;"))
    scan_stream.start_full_scan(stream(), target, target + "-c").awaitTermination()
    assert scanned(1) == ["a.js", "c.sql"]
    check()
    land(200, ("q", "a.js", None), ("p", "b.py", "x = 1\neval(x)"))  # one is gone
    scan_stream.start_full_scan(stream(), target, target + "-c").awaitTermination()
    check()
    assert not [p for p in (tmp_path / "out").rglob("scratch-*")]
    scan_stream.compact(spark, target, into)
    check(into)


def test_history_stream_ends_at_the_batch_lists(spark, tmp_path):
    rows = [(u, f"p{(i * 7 + u) % 23}", 1_700_000_000 + i * 11 + u) for i in range(60) for u in (1, 2)]
    visits = spark.createDataFrame(rows, "user_id bigint, project string, s bigint").select("user_id", "project", F.timestamp_seconds("s").alias("ts"))
    visits.coalesce(1).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v")).persist()
    stored.count()
    want = {(r.user_id, r.place, r.project) for r in history.history_lists(stored).collect()}
    stream = lambda: spark.readStream.schema(stored.schema).parquet(str(tmp_path / "v"))
    lists = lambda: {(r.user_id, r.place, r.project) for r in history.current_lists(spark, str(tmp_path / "out")).collect()}
    history.start_history(stream(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert lists() == want
    # later visits of one user change that user's list only; the old ones are too old by then
    later = spark.createDataFrame([(1, "px", 1_700_002_000), (1, "py", 1_700_002_010), (1, "px", 1_700_002_005)], "user_id bigint, project string, s bigint")
    later.select("user_id", "project", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    history.start_history(stream(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert lists() == {w for w in want if w[0] == 2} | {(1, 1, "py"), (1, 2, "px")}
    now = F.timestamp_seconds(F.lit(1_700_000_000 + 100))
    early = {(r.user_id, r.project) for r in history.recent_projects(stored, now).collect()}
    assert early == {(u, p) for u, p, s in rows if s <= 1_700_000_100 and s > 1_700_000_100 - 300}


def test_lists_are_folded_from_plain_visits():
    known = {"pz": 50}
    history.note_visits(known, ["pa", None, "pb", "pa", "pz"], [90, 99, 100, 80, 40])
    history.note_visits(known, ["pc", "pb"], [100, 10])
    assert known == {"pz": 50, "pa": 90, "pb": 100, "pc": 100}
    assert history.newest_first(known, 50, 20) == (["pb", "pc", "pa"], [100, 100, 90])  # pz is exactly 50 old
    assert history.newest_first(known, 51, 2) == (["pb", "pc"], [100, 100])
