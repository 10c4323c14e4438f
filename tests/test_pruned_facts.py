"""Facts that a plan doesn't read stay in the parser, those it reads are the same; inputs are cut into tasks by their rows."""

from pyspark.sql import functions as F

import pytest

from siftmill.fixtures import derive
from siftmill.operators import deps, facts, taint
from siftmill.operators.extensions import RuleSet
from siftmill.operators.facts import FUNCTION_TYPES, descendants, syntax_facts
from siftmill.plans import reports
from siftmill.plans import scan as SC

TEXT = "class A:\n    def f(self, x):\n        y = x.z[0] + input()\n        if y:\n            def g():\n                eval(y)\n        return y\n"


def test_enclosing_nodes_by_type_are_those_of_whole_chains(make_files):
    files = make_files(("a.py", TEXT), ("b.py", "def h():\n    return 1\n"))
    few = syntax_facts(files, None, FUNCTION_TYPES, False)
    assert {a["type"] for r in few.collect() for a in r["ancestors"]} == {"FunctionDef"}
    whole = sorted(map(tuple, descendants(syntax_facts(files), FUNCTION_TYPES).collect()))
    assert whole and sorted(map(tuple, descendants(few, FUNCTION_TYPES).collect())) == whole


def test_children_by_type_are_all_that_the_flow_reads(make_files):
    files = make_files(("a.py", TEXT))
    few = syntax_facts(files, taint.NODE_TYPES, children=taint.CHANGES)
    assert {r["node_type"] for r in few.collect() if r["children"]} == {"Assign"}
    rows = lambda facts: sorted(map(str, taint.flow_rows(facts).collect()))
    assert rows(few) == rows(syntax_facts(files, taint.NODE_TYPES))


def test_links_of_ancestors_are_kept_once_and_read_whole(make_files):
    rows = {r["node_id"]: r for r in syntax_facts(make_files(("a.py", TEXT))).collect()}
    for row in rows.values():
        chain = row["ancestors"]
        assert [a["id"] for a in chain] == ([a["id"] for a in rows[chain[-1]["id"]]["ancestors"]] + [chain[-1]["id"]] if chain else [])


def test_orders_are_cut_by_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(derive, "ORDERS_PER_TASK", 10)
    files = derive.corpus(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 100 and files.count() == 1000


def test_advisories_are_worded_before_they_meet_the_declared_rows(spark):
    declared = spark.createDataFrame([("p", "requirements.txt", "PyPI", 0, "a", "1.0")], "project_id string, manifest string, ecosystem string, ord int, name string, version string")
    known = spark.createDataFrame([("PyPI", "a", "1.0", "V", None, "stored XSS", ["u"])], "ecosystem string, package string, version string, vuln_id string, summary string, details string, refs array<string>")
    found = deps.vulnerable(declared, known)
    assert [(r["severity"], r["summary"]) for r in found.collect()] == [("MINOR", "No summary available")]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "RLIKE" not in above.upper()


def _declared_and_known(spark):
    names = "project_id string, manifest string, ecosystem string, ord int, name string, version string"
    declared = spark.createDataFrame([(f"p{i % 40}", "requirements.txt", "PyPI", i, "a", "1.0") for i in range(60)] + [(None, "requirements.txt", "PyPI", 0, "a", "1.0"), ("q", "requirements.txt", "PyPI", 0, "b", "")], names)
    advisories = [("PyPI", "a", "1.0", f"V{i}", None if i % 3 else "s", "high" if i % 2 else "", []) for i in range(50)] + [("PyPI", "a", "1.0", None, None, None, [])]
    return declared, spark.createDataFrame(advisories, "ecosystem string, package string, version string, vuln_id string, summary string, details string, refs array<string>")


def test_findings_of_one_version_are_made_by_many_tasks(spark):
    declared, known = _declared_and_known(spark)
    found = deps.vulnerable(declared, known)
    rows = found.select("project_id", "vuln_id", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 61 * 51 and len({r["task"] for r in rows}) > 3  # one, as all are of one version


def test_advisories_are_counted_as_they_are_listed(spark):
    declared, known = _declared_and_known(spark)
    pinned = deps.pinned(declared)
    counted = {(r["project_id"], r["rule_id"], r["severity"]): r["issues"] for r in deps.counted(pinned, deps.advised(pinned, known)).collect()}
    listed = deps.vulnerable(declared, known).groupBy("project_id", "rule_id", "severity").count().collect()
    assert counted == {(r["project_id"], r["rule_id"], r["severity"]): r["count"] for r in listed} and len(counted) == 41 * 2


def test_findings_of_advisories_are_not_written_to_be_counted(spark, make_files):
    files = make_files(("p0", "a.js", "debugger"), ("p1", "b.js", "x = 1"))
    manifests = spark.createDataFrame([(f"p{i}", "requirements.txt", "a==1.0\nb\n") for i in range(3)], "project_id string, manifest string, text string")
    result = SC.scan(files, manifests, _declared_and_known(spark)[1])
    by_project = lambda df: {r["project_id"]: r["n"] for r in df.groupBy("project_id").agg(F.sum("issues").alias("n")).collect()}
    assert by_project(result.rollups) == by_project(reports.rollup(result.issues)) == {"p0": 54, "p1": 53, "p2": 53}
    plan = result.rollups._jdf.queryExecution().optimizedPlan().toString()
    assert "_share" not in plan  # the rows that are listed meet under it
    assert {r["project_id"]: (r["total_issues"], r["dependency_vulnerabilities"]) for r in SC.summary(result).collect()} == {"p0": (1, 53), "p1": (0, 53), "p2": (0, 53)}


def test_valid_texts_are_told_without_a_tree(monkeypatch):
    monkeypatch.setattr(facts, "parse", lambda text: pytest.fail("a tree was made"))
    assert facts._parses("x = 1\n") and facts._parses("") and facts._parses("def f():\n    return '\\d'\n")


ODD = ["", "x = 1", "def f(:\n", "return 1\n", "await x", "from __future__ import nothing", "x = '\\d'", "x\0", "def f():\n    x = 1\n    global x\n", "nonlocal y", "break",
       "a" + ".b" * 9_990, "a" + ".b" * 20_000, "a" + ".b" * 4_000, "(" * 300 + ")" * 300, "-" * 8_000 + "a", "def f(a, a): pass", "class A: (yield)", "# coding: nope\nx", "\ufeffx", "print 1"]


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_texts_are_valid_where_there_is_a_tree(text):
    try:
        want = facts.parse(text) is not None
    except (RecursionError, MemoryError):
        want = False
    assert facts._parses(text) is want


def test_a_scan_leaves_ancestors_that_no_rule_reads_in_the_parser(spark, make_files):
    files = make_files(("a.py", TEXT), *((f"t{i}.py", t[4]) for i, t in enumerate(derive.TEMPLATES) if t[1] == "python"))
    few, whole = SC.facts_of(files), SC.facts_of(files, whole=True)
    assert not few.filter("node_type = 'Constant' and size(ancestors) > 0").count()
    leaves = few.filter("node_type = 'Name' and size(ancestors) > 0").select(F.concat_ws(".", "parent_type", "parent_field").alias("edge")).distinct().collect()
    assert leaves and {r["edge"] for r in leaves} <= set(taint.FEEDS)
    rows = lambda x: sorted(map(str, SC.python_hits(files, x).collect()))
    assert few.count() == whole.count() and rows(few) == rows(whole) and len(rows(few)) > 50


def test_own_rules_over_facts_see_all_ancestors(spark, make_files):
    rules = RuleSet()
    inside = lambda x: x.filter("node_type = 'Constant' and size(ancestors) > 0").select(
        "project_id", F.col("path").alias("file"), F.col("lineno").alias("line"), F.lit(0).alias("column"), F.lit("USR009").alias("rule_id"), F.lit("m").alias("message"), F.lit("s").alias("suggestion"))
    rules.register(("USR009", "Constant", "INFO", "CODE_SMELL", None, ["python"], "A constant."), inside, "facts")
    found = SC.scan(make_files(("a.py", TEXT)), rules=rules).issues.filter("rule_id = 'USR009'")
    assert [r["line"] for r in found.collect()] == [3]


def test_no_join_of_dependencies_gathers_its_rows_on_the_driver(spark):
    """Rows of projects and packages are broadcast at no size: their files are small, what they make is not."""
    ranged = "ecosystem string, package string, version string, vuln_id string, summary string, details string, refs array<string>, ranges array<struct<introduced:string,fixed:string,last_affected:string>>"
    declared = _declared_and_known(spark)[0]
    known = spark.createDataFrame([("PyPI", "a", "9.0", "V", "s", "", [], [("0", "2.0", None), ("1.0", None, "1.0")]), ("PyPI", "a", "1.0", "W", "s", "", [], None)], ranged)
    imported = spark.createDataFrame([("p1", "a"), ("q", "c")], "project_id string, module string")
    versions = declared.selectExpr("ecosystem", "name AS package", "version").distinct()
    plans = [deps.affected(versions, known), deps.dependency_findings(declared, imported, known), deps.third_party(imported, deps.standard_modules(spark), imported),
             deps.counted(deps.pinned(declared), deps.advised(versions, known))]
    broadcasts = [p._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") for p in plans]
    assert broadcasts == [0, 0, 1, 0]  # the standard library's names are a fixed table
    assert {(r["version"], r["vuln_id"]) for r in plans[0].collect()} == {("1.0", "V"), ("1.0", "W")}
    assert {r["rule_id"]: r["count"] for r in plans[1].groupBy("rule_id").count().collect()} == {"DEP001": 122, "DEP002": 60, "DEP003": 1}


MORE = "import os\nfor i in range(3):\n    a, b = f(os.environ['x'])[0], i\n    a += g(k=b.c, *d)\nwith open(a) as h:\n    os.system(f'{a}' + h.read())\nx = lambda y: [z for z in y if z]\n"


def test_facts_of_a_flow_are_few_and_tell_the_same(spark, make_files):
    files = make_files(("a.py", TEXT), ("b.py", MORE), ("bad.py", "def f(:\n"), ("deep.py", "a" + ".b" * 20_000), *((f"t{i}.py", t[4]) for i, t in enumerate(derive.TEMPLATES) if t[1] == "python"))
    few, whole = taint.flow_facts(files), syntax_facts(files, taint.NODE_TYPES)
    assert few.columns == ["project_id", "path", "node_id", "node_type", "lineno", "col", "name", "strict", "base", "parent_type", "parent_field", "ancestors", "children"]
    assert "const_value" not in few.schema.simpleString() and few.count() < whole.count() / 2
    rows = lambda df: sorted(map(str, df.collect()))
    for step in (taint.carried, taint.tainted_definitions, taint.definition_of_use, taint.taint_hits, taint.sink_calls):
        assert rows(step(few)) == rows(step(whole)) != []


def test_columns_of_facts_are_those_asked_for(spark, make_files):
    files = make_files(("a.py", TEXT), ("b.py", MORE), ("deep.py", "a" + ".b" * 20_000))
    whole = syntax_facts(files)
    owned = syntax_facts(files, None, FUNCTION_TYPES, False, columns=facts.OWNED)
    assert owned.schema.simpleString() == "struct<project_id:string,path:string,node_id:int,node_type:string,ancestors:array<struct<id:int,type:string,name:string,lineno:int>>>"
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(descendants(owned, FUNCTION_TYPES)) == rows(descendants(whole, FUNCTION_TYPES)) != []
    plain = ["path", "dfs_id", "end_lineno", "const_value"]
    assert rows(syntax_facts(files, columns=plain)) == rows(whole.select(*plain))
    kids = syntax_facts(files, columns=["path", "node_id", "children.pos", "children.lineno"])
    assert rows(kids) == rows(whole.select("path", "node_id", F.transform("children", lambda c: F.struct(c["pos"].alias("pos"), c["lineno"].alias("lineno"))).alias("children")))
    with pytest.raises(ValueError):
        syntax_facts(files, columns=["path", "nothing"])
