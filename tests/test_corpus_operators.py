"""Clones, dependencies, file trees, scans and extensions on small inputs."""

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftmill.operators import clones, deps, metrics
from siftmill.operators.extensions import RuleSet
from siftmill.operators.facts import imports, syntax_facts
from siftmill.plans import scan as SC
from siftmill.sources import files as S, manifests as MF


def brute_clones(rows):
    groups = defaultdict(list)
    for project, path, text in rows:
        lines = text.splitlines()
        for i in range(len(lines) - 5):
            window = [x.strip() for x in lines[i:i + 6]]
            if sum(1 for x in window if x and not x.startswith("#")) >= 3:
                groups[project, "\n".join(window)].append((path, i + 1))
    return {k: sorted(v) for k, v in groups.items() if len(v) > 1}


def test_clones_equal_brute_force(make_files):
    block = "\n".join(f"  line {i}" for i in range(8))
    rows = [("p", "a.py", block + "\n" + block), ("p", "b.py", "x\n" + block.replace("  ", "\t")), ("q", "c.py", block),
            ("p", "d.py", "# c\n# c\n\na\nb\n# d\n" * 2), ("p", "e.py", "# c\n# c\n\na\nb\nc\n" * 2), ("p", "f.py", "a\nb\nc\nd\ne"), ("p", "g.py", "")]
    want = brute_clones(rows)
    files = make_files(*rows)
    report = clones.clone_report(files).collect()
    assert {(r.project_id, r.block_preview, r.occurrences, (r.first_file, r.first_line)) for r in report} == {
        (p, b[:200], len(v), v[0]) for (p, b), v in want.items()}
    located = sorted((r.project_id, r.file, r.start_line, r.end_line) for r in clones.clone_locations(files).collect())
    assert located == sorted((p, f, n, n + 5) for (p, _), v in want.items() for f, n in v)
    spans = {(r.file, r.start_line, r.end_line) for r in clones.merged_locations(files).collect()}
    assert ("b.py", 2, 9) in spans


def test_requirements_and_package_json(spark):
    text = "Flask==2.0 # x\n\n# c\n-r a.txt\nname[extra]==1.0\nx!=2\ny>=1,<2\n  numpy  \nz ~= 3.1;python\n==\n"
    package = json.dumps({"devDependencies": {"a": "^1.2", "b": "latest"}, "dependencies": {"a": ">=2"}})
    rows = spark.createDataFrame([("p", "requirements.txt", text), ("p", "package.json", package), ("q", "package.json", "{"), ("r", "requirements.txt", "")],
                                 "project_id string, manifest string, text string")
    got = [(r.name, r.version) for r in MF.requirements(rows).orderBy("ord").collect()]
    assert got == [("Flask", "2.0"), ("name", ""), ("x", ""), ("y", "1,<2"), ("numpy", ""), ("z", "3.1")]
    got = [(r.ord, r.name, r.version) for r in MF.package_json(rows).orderBy("ord", "name").collect()]
    assert got == [(0, "a", "2"), (1, "a", "1.2"), (1, "b", "")]


def test_dependency_findings(spark, make_files):
    files = make_files(("p", "a.py", "import os, yaml.x\nfrom PIL import Image\nfrom . import q\nfrom ..pkg import r\nimport numpy as n"), ("q", "b.py", "import flask"))
    found = deps.third_party(deps.import_roots(imports(syntax_facts(files))), deps.standard_modules(spark))
    assert {(r.project_id, r.module) for r in found.collect()} == {("p", "yaml"), ("p", "PIL"), ("p", "pkg"), ("p", "numpy"), ("q", "flask")}
    text = "PyYAML==5.0\nPillow\nrequests==2.0\nscikit-learn\n"
    declared = MF.declared(spark.createDataFrame([("p", "requirements.txt", text)], "project_id string, manifest string, text string"))
    assert {r.package for r in deps.unused(declared, found).collect()} == {"requests", "scikit-learn"}
    assert {(r.project_id, r.package) for r in deps.undeclared(declared, found).collect()} == {("p", "pkg"), ("p", "numpy")}
    advisory = [("PyPI", "requests", "2.0", "A1", None, "open source note", ["1", "2", "3", "4"]), ("PyPI", "requests", "2.1", "A2", "s", "", []), ("PyPI", "Pillow", "", "A3", "s", "", [])]
    known = spark.createDataFrame(advisory, MF.ADVISORIES)
    row = deps.vulnerable(declared, known).collect()
    assert [(r.package, r.severity, r.summary, list(r.refs)) for r in row] == [("requests", "CRITICAL", "No summary available", ["1", "2", "3", "4"])]


def test_scan_of_a_file_tree(spark, tmp_path):
    root = tmp_path / "trees"
    tree = {"app/src/a.py": "password = 'x'\nx = input()\neval(x)\neval('1', globals=x)\n", "app/node_modules/b.js": "debugger", "app/web/c.js": "function f() {\n  debugger;\n}\n",
            "app/requirements.txt": "flask==1.0\n", "app/bad.py": "token = 'abc'\ndef (", "lib/q.sql": "SELECT * FROM t;\n", "lib/note.txt": "x", "bare/requirements.txt": "\n", "lib/big.py": "x = 1\n" * 100_000}
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    files = S.read_tree(spark, str(root), max_kb=500).coalesce(1).cache()
    assert {(r.project_id, r.path) for r in files.collect()} == {("app", "src/a.py"), ("app", "bad.py"), ("app", "web/c.js"), ("lib", "q.sql")}
    manifests = S.read_manifests(spark, str(root))
    result = SC.scan(files, manifests, scan_id="s1", ts=F.lit("2024-01-01").cast("timestamp"))
    out = str(tmp_path / "out")
    for _ in range(2):  # stored again, a scan replaces itself
        SC.store(result, out, "s1")
    rows = SC.stored(spark, out, "issues").collect()
    got = {(r.file, r.line, r.rule_id) for r in rows}
    assert got == {("src/a.py", 1, "SEC003"), ("src/a.py", 3, "SEC002"), ("src/a.py", 4, "SEC002"), ("src/a.py", 3, "TAINT001"), ("src/a.py", 4, "TAINT001"),
                   ("web/c.js", 2, "JSEC009"), ("q.sql", 1, "SQL002"), ("requirements.txt", 0, "DEP002")}
    by_rule = {(r.rule_id, r.line): r for r in rows}
    assert by_rule["TAINT001", 3].code_snippet == "eval(x)" and by_rule["TAINT001", 4].code_snippet == ""
    assert by_rule["SEC003", 1].code_snippet.startswith(">>> 1: password = 'x'\n    2: x = input()")
    assert by_rule["DEP002", 0].message.startswith("flask: 'flask' is declared") and by_rule["DEP002", 0].severity == "MINOR"
    assert len({r.issue_id for r in rows}) == len(rows)
    scans = {r.project_id: r for r in SC.stored(spark, out, "scans").collect()}
    assert (scans["bare"].total_issues, scans["bare"].files_scanned, scans["bare"].lines_scanned) == (0, 0, 0)
    assert (scans["app"].total_issues, scans["app"].critical_count, scans["app"].minor_count, scans["app"].files_scanned) == (7, 5, 1, 3)
    assert {r.metric_type for r in SC.stored(spark, out, "metrics", "app", "s1").collect()} == {
        "loc", "maintainability_index", "cyclomatic_complexity", "function_length", "avg_complexity"}


def test_scans_are_read_once_they_are_completed(spark, make_files, tmp_path):
    from pathlib import Path

    out = str(tmp_path / "out")
    scratch = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(scratch.iterdir())
    state = lambda: {r.scan_id: r.status for r in SC.scan_states(spark, out).collect()}
    seen = []

    def work(text):
        def scanned():
            seen.append(state())
            return SC.scan(make_files(("p", "a.js", text)), scan_id="s")

        return scanned

    def fails():
        SC.scan(make_files(("p", "a.js", "debugger")))
        raise RuntimeError("lost the corpus")

    SC.run(spark, out, "s", work("debugger"))
    assert seen == [{"s": "running"}] and state() == {"s": "completed"}
    for scan_id in ("s", "t"):
        with pytest.raises(RuntimeError):
            SC.run(spark, out, scan_id, fails)
    # the failed run hides nothing of the completed one
    assert state() == {"s": "failed", "t": "failed"}
    assert [r.rule_id for r in SC.stored(spark, out, "issues").collect()] == ["JSEC009"]
    rows = {(r.scan_id, r.status, r.total_issues) for r in SC.scans_with_states(spark, out).collect()}
    assert rows == {("s", "completed", 1), ("s", "failed", None), ("t", "failed", None)}
    SC.run(spark, out, "s", work("x == 1"))
    assert [r.rule_id for r in SC.stored(spark, out, "issues", scan_id="s").collect()] == ["JSCS003"] and state() == {"s": "completed", "t": "failed"}
    rollup = SC.stored(spark, out, "rollups").collect()
    assert [(r.project_id, r.rule_id, r.issues) for r in rollup] == [("p", "JSCS003", 1)]
    gone = SC.vacuum(spark, out)
    assert len(gone) == 3 and [r.rule_id for r in SC.stored(spark, out, "issues").collect()] == ["JSCS003"] and SC.vacuum(spark, out) == gone
    assert set(scratch.iterdir()) == before
    with pytest.raises(ValueError, match="no completed scan"):
        SC.stored(spark, out, "issues", scan_id="t")


def test_maintainability_by_hand(make_files):
    import math

    files = make_files(("a.py", "def f(a):\n    return a\n"), ("b.py", ""), ("c.py", "x = ("))
    rows = {r.file: r.value for r in metrics.maintainability_metrics(files, syntax_facts(files)).collect()}
    tokens = ["def", "f", "(", "a", ")", ":", "return", "a"]
    want = 171 - 5.2 * math.log(len(tokens) * math.log2(len(set(tokens)))) - 0.23 * 1 - 16.2 * math.log(2)
    assert rows == {"a.py": min(100.0, round(want, 2)), "b.py": 100.0}


def test_user_rules(make_files):
    rules = RuleSet()
    row = ("U1", "Calls", "INFO", "CODE_SMELL", None, ["python"], "d")

    def calls(facts):
        return facts.filter("node_type = 'Call'").select("project_id", F.col("path").alias("file"), F.col("lineno").alias("line"), F.col("col").alias("column"),
                                                         F.lit("U1").alias("rule_id"), F.col("dotted").alias("message"), F.lit("").alias("suggestion"))

    rules.register(row, calls, over="facts")
    files = make_files(("a.py", "f(g(1))\n"))
    assert sorted(r.message for r in rules.hits(files, syntax_facts(files)).collect()) == ["f", "g"]
    assert rules.catalog(files.sparkSession).count() == 75


def test_unusual_python_does_not_end_the_job(spark, make_files):
    from pyspark.sql import functions as F

    from siftmill.operators.facts import TOO_DEEP, syntax_facts

    files = make_files(
        ("surrogate.py", 'x = "\\ud800"\n'), ("integer.py", "x = 0x" + "f" * 6000 + "\n"), ("terms.py", "x = f()" + " + 1" * 1500 + "\n"),
        ("calls.py", "x = a" + ".b()" * 600 + "\n"), ("subscripts.py", "x = a" + "[0]" * 600 + "\n"), ("deep.py", "x = " + "(" * 150 + "1" + ")" * 150 + "\n"),
        ("nested.py", "x = " + "-" * 20000 + "1\n"),
    )
    facts = syntax_facts(files).groupBy("path").agg(F.count("*").alias("n"), F.max((F.col("node_type") == TOO_DEEP).cast("int")).alias("deep"), F.max("const_value").alias("value")).collect()
    found = {r["path"]: r for r in facts}
    assert found["surrogate.py"]["value"] == "\\ud800" and found["integer.py"]["value"] == "0x" + "f" * 6000
    assert found["terms.py"]["n"] > 1500 and found["calls.py"]["n"] > 600 and found["subscripts.py"]["n"] > 600
    assert found["nested.py"]["deep"] == 1 and found["nested.py"]["n"] == 1


def test_tree_is_read_from_any_form_of_its_root(spark, tmp_path, monkeypatch):
    from siftmill.sources.files import read_tree, skipped_files

    (tmp_path / "c" / "proj" / "sub").mkdir(parents=True)
    (tmp_path / "c" / "proj" / "sub" / "a.py").write_text("x = 1\n" * 200_000)
    for root in (str(tmp_path / "c"), f"file://{tmp_path}/c", f"file:{tmp_path}/./c/"):
        assert [(r["project_id"], r["path"]) for r in read_tree(spark, root).select("project_id", "path").collect()] == [("proj", "sub/a.py")]
    assert read_tree(spark, str(tmp_path / "c"), max_kb=500).count() == 0 and skipped_files(spark, str(tmp_path / "c"), 500).count() == 1


def test_package_json_keeps_the_last_of_a_key_and_no_nested_values(spark):
    from siftmill.sources.manifests import package_json

    text = '{"dependencies": {"a": "^1", "a": "2", "b": {"c": "3"}}}'
    rows = package_json(spark.createDataFrame([("p", "package.json", text)], "project_id string, manifest string, text string")).collect()
    assert [(r["name"], r["version"]) for r in rows] == [("a", "2")]


def test_own_and_relative_modules_are_not_undeclared(spark, make_files):
    files = make_files(("app/core.py", "import helpers\nfrom . import views\nfrom .models import x\nimport lxml\nimport app.core"), ("src/helpers.py", "import tools.x\nimport yaml"),
                       ("tools/x.py", ""), ("q", "a.py", "import helpers"))
    found = imports(syntax_facts(files))
    standard = deps.standard_modules(spark)
    rows = lambda d: sorted((r.project_id, r.module) for r in d.collect())
    assert rows(deps.third_party(deps.import_roots(found), standard)) == [("p", "app"), ("p", "helpers"), ("p", "lxml"), ("p", "models"), ("p", "tools"), ("p", "yaml"), ("q", "helpers")]
    own = deps.local_modules(files)
    assert rows(own) == [("p", "app"), ("p", "helpers"), ("p", "tools"), ("q", "a")]
    assert rows(deps.third_party(deps.import_roots(found, relative=False), standard, own)) == [("p", "lxml"), ("p", "yaml"), ("q", "helpers")]


def test_long_manifests_take_the_last_of_each_key(spark):
    text = '{"dependencies": {' + ", ".join(f'"k{i % 400}": "{i}"' for i in range(2000)) + "}}"
    rows = MF.package_json(spark.createDataFrame([("p", "package.json", text)], "project_id string, manifest string, text string")).collect()
    assert {r.name: r.version for r in rows} == {f"k{i}": str(1600 + i) for i in range(400)} and len(rows) == 400


def test_function_bodies_are_followed_to_their_end_if_asked(make_files):
    from siftmill.operators.js_facts import js_function_metrics

    files = make_files(("a.js", "function f() {\n" + "  if (x) { y(); }\n" * 500 + "}\n"))
    cut, whole = (js_function_metrics(files, most).first() for most in (200, None))
    assert (cut["length"], cut.complexity) == (200, 200) and (whole["length"], whole.complexity) == (502, 501)
