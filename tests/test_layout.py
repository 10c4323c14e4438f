"""Texts stay where they are: plans over a corpus laid out by file key exchange no text and sort for no aggregate."""

from pyspark.sql import functions as F

from siftmill.operators import clones
from siftmill.operators.catalog import rule_catalog
from siftmill.plans import findings as W
from siftmill.plans.scan import facts_of, python_hits
from siftmill.sources.layout import lay_out, open_layout

CODE = "import os\n\n\ndef f(a):\n    try:\n        os.system(a)\n    except:\n        pass\n" * 2


def nodes(df):
    """(name, output columns) of every operator of the plan as it is before any stage has run."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        at = todo.pop()
        name = at.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(at.initialPlan())
            continue
        columns = at.output()
        found.append((name, [columns.apply(i).name() for i in range(columns.size())]))
        children = at.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return found


def corpus(make_files):
    block = "\n".join(f"line number {i}" for i in range(8))
    return make_files(("a.py", CODE), ("b.js", "var x = 1;\n" + block), ("c.js", block + "\nx"), ("q", "d.js", block), ("q", "e.js", block + "\n" + block))


def test_laid_out_files_are_the_files(spark, make_files, tmp_path):
    files = corpus(make_files)
    for laid in (lay_out(files), lay_out(files, str(tmp_path / "laid"), 3), open_layout(spark, str(tmp_path / "laid"), 3)):
        assert sorted(laid.select(*files.columns).collect()) == sorted(files.collect())


def test_previews_and_snippets_exchange_no_text(spark, make_files):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid = lay_out(corpus(make_files))
        facts = facts_of(laid)
        for plan in (clones.clone_report(laid, laid_out=laid), python_hits(laid, facts)):
            seen = nodes(plan)
            assert any("Exchange" in name for name, _ in seen)
            assert not [n for n in seen if "Exchange" in n[0] and {"text", "lines", "raw"} & set(n[1])]
        assert any("Exchange" in name and "text" in c for name, c in nodes(clones.clone_report(corpus(make_files))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hits = [h for h in python_hits(laid, facts).collect() if h.rule_id == "CS007"]
    assert [h.code_snippet.split("\n")[2] for h in hits] == [">>> 7:     except:", ">>> 15:     except:"]


def test_no_sort_aggregate_in_clones_and_issues(spark, make_files):
    files = corpus(make_files)
    hits = spark.createDataFrame([("p", "a.py", 3, 0, "PERF001", "m", None), ("p", "a.py", 3, 0, "PERF001", "m", "")] * 2, W_HIT)
    plans = [clones.clone_report(files), clones.clone_groups(files), clones.clone_locations(files), W.to_issues(hits, rule_catalog(spark), "s", F.current_timestamp())]
    for plan in plans:
        assert not [name for name, _ in nodes(plan) if "SortAggregate" in name]
    assert len({r.issue_id for r in plans[-1].collect()}) == 4


W_HIT = "project_id string, file string, line int, `column` int, rule_id string, message string, suggestion string"


def test_clone_groups_equal_plain_counts(make_files):
    """Groups hold equal blocks and nothing else, first places come first, and projects don't mix."""
    files = corpus(make_files)
    want = {}
    for r in files.collect():
        lines = [x.strip() for x in r.text.split("\n")]
        for i in range(len(lines) - 5):
            own = lines[i : i + 6]
            if sum(bool(x) and not x.startswith("#") for x in own) >= 3:
                want.setdefault((r.project_id, "\n".join(own)), []).append((r.path, i + 1))
    want = {(p, b[:200], len(at), *min(at)) for (p, b), at in want.items() if len(at) > 1}
    assert {(r.project_id, r.block_preview, r.occurrences, r.first_file, r.first_line) for r in clones.clone_report(files, laid_out=lay_out(files)).collect()} == want
