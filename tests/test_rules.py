"""Every hand-written label is found, and nothing else, for all rules over syntax facts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftmill.fixtures import snippets
from siftmill.operators import facts as A, metrics as M
from siftmill.operators.catalog import RULES, rule_catalog, rules_summary
from siftmill.operators.fact_rules import FACT_RULES, fact_rule_hits, rule_facts
from siftmill.operators.js_facts import js_function_metrics
from siftmill.operators.line_rules import FILE_RULES, LINE_RULES, text_rule_hits
from siftmill.operators.taint import taint_hits


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(str(i), f"t{i}{suffix}", lang, text) for i, lang, suffix, _, text in snippets.templates()]
    return spark.createDataFrame(rows, "project_id string, path string, language string, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def facts(corpus):
    return A.syntax_facts(corpus).cache()


def expected(*rules):
    return Counter((i, r, n, m) for i, r, n, m in snippets.labels() if r in rules)


def found(hits):
    return Counter((int(r.project_id), r.rule_id, r.line, r.message) for r in hits.collect())


def test_fact_rules_match_the_labels(facts):
    assert found(fact_rule_hits(facts)) == expected(*FACT_RULES)


def test_taint_matches_the_labels(facts):
    assert found(taint_hits(facts)) == expected("TAINT001")


def test_gated_facts_give_the_same_hits(corpus, facts):
    for rule_id in ("SEC001", "SEC009", "CS005", "MAINT004", "ASYNC004"):
        rule = FACT_RULES[rule_id]
        assert found(rule.run(rule_facts(corpus, [rule]))) == found(rule.run(facts))


def test_extended_sources(make_files):
    files = make_files(("a.py", "x = request.args.get('q')\ncursor.execute(x)\n"))
    facts = A.syntax_facts(files)
    assert taint_hits(facts).count() == 0
    assert taint_hits(facts, extended_sources=True).count() == 1


def test_function_metrics_match_the_labels(corpus, facts):
    js = Counter((int(r.project_id), "FN", r.line, f"{r.name}|{r.length}|{r.complexity}") for r in js_function_metrics(corpus).collect())
    assert js == expected("FN")
    rows = M.python_complexity(facts).join(M.python_lengths(facts), ["project_id", "file", "line", "name"]).collect()
    assert Counter((int(r.project_id), "PYFN", r.line, f"{r.name}|{r.length}|{r.complexity}") for r in rows) == expected("PYFN")


def test_unparsable_files_give_nothing(corpus):
    bad = corpus.filter(F.col("project_id").isin([str(i) for i in snippets.UNPARSABLE]))
    assert A.syntax_facts(bad).count() == 0
    assert text_rule_hits(bad).count() == 0


def test_facts_are_breadth_first(facts):
    import ast

    for i, lang, _, _, text in snippets.templates():
        if lang != "python" or i in snippets.UNPARSABLE or not text:
            continue
        walked = [type(n).__name__ for n in ast.walk(ast.parse(text)) if not isinstance(n, (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop))]
        rows = sorted((r.node_id, r.node_type) for r in facts.filter(F.col("project_id") == str(i)).select("node_id", "node_type").collect())
        assert [t for _, t in rows] == walked


def lines_of(make_files, path, text, rule):
    return sorted(r.line for r in text_rule_hits(make_files((path, text)), [rule]).collect())


def test_text_rule_edges(make_files):
    check = lambda path, text, rule, lines: lines_of(make_files, path, text, rule) == lines
    assert check("a.js", "el.innerHTML=''\nel.innerHTML = ''\nel.innerHTML=x\n// el.innerHTML=x", "JSEC001", [2, 3])
    assert check("a.js", "a == b\na === b\na != b\na <= b\na==b\n* a == b", "JSCS003", [1, 5])
    assert check("a.js", "catch (e) {}\ncatch (e)\n{\n}\ncatch(e) { x }", "JSCS004", [1, 2])
    assert check("a.js", "jwt.decode(a)\njwt.decode(a, verify)\njwt.decode(verify(jwt.decode(b)))", "JSEC006", [1, 3])
    assert check("a.sql", "UPDATE a SET b=1 UPDATE c SET d=2 WHERE e; update\nx set y=1", "SQL003", [1])
    assert check("a.sql", "UPDATE a SET b=1 WHERE c=1; UPDATE d SET e=2", "SQL003", [1])
    assert check("a.cs", "catch {\n\n}\ncatch {\n x\n}\ncatch (E e) {", "CS_SEC004", [1])
    assert check("a.py", "pässword = 'x'\npassword = 'x'\nif:", "SEC003", [])
    assert check("a.py", "PASSWORD = 'x'\n# pwd='y'", "SEC003", [1, 2])
    assert check("a.js", "// }\n{{{{{\n// {{\n}\nx\n{", "JSCS008", [2, 6])


def test_gates_are_wide_enough():
    """A line that a pattern matches opens the gate of its rule: tried on the labelled corpus without gates."""
    import re

    texts = [t for *_, t in snippets.templates()]
    for rule in LINE_RULES.values():
        gate = re.compile("|".join(map(re.escape, rule.gate)), re.I)
        for text in texts:
            for line in text.splitlines():
                if any(re.search(p, line, re.I if rule.ignore_case else 0) for p, _ in rule.patterns):
                    assert gate.search(line), (rule.rule_id, line)


def test_catalogue_is_complete(spark):
    ids = [r[0] for r in RULES]
    assert len(ids) == len(set(ids)) == 74
    assert set(ids) == set(LINE_RULES) | set(FILE_RULES) | set(FACT_RULES) | {"TAINT001", "DEP001", "DEP002", "DEP003"}
    row = rules_summary(rule_catalog(spark)).filter("rule_id = 'SEC003'").first()
    assert row.languages == "python, javascript" and row.owasp_category.startswith("A07:2021-")


def _brace_lines(seed, n):
    import random

    rng = random.Random(seed)
    kinds = ["function f%d() {", "{", "}", "x();", "if (a) { b(); }", "// {", "} else {", "}}", "const g%d = () => {"]
    return [k % i if "%d" in k else k for i, k in enumerate(rng.choices(kinds, k=n))]


def test_braces_equal_a_plain_walk(spark, make_files):
    for seed, n in [(1, 1), (2, 7), (3, 400), (4, 901)]:
        lines = _brace_lines(seed, n)
        depth, deep = 0, []
        for i, line in enumerate(lines, 1):
            if not line.strip().startswith(("//", "*")):
                depth += line.count("{") - line.count("}")
                if depth > 4:
                    deep.append(i)
        long_ = []
        for i, line in enumerate(lines):
            if line.startswith(("function", "const")):
                depth, opened = 0, False
                for k, other in enumerate(lines[i:], 1):
                    depth += other.count("{") - other.count("}")
                    opened |= depth > 0
                    if opened and depth <= 0:
                        if k > 50:
                            long_.append((i + 1, k))
                        break
        hits = text_rule_hits(make_files(("a.js", "\n".join(lines))), ["JSCS001", "JSCS008"]).collect()
        assert sorted(h.line for h in hits if h.rule_id == "JSCS008") == deep
        assert sorted((h.line, int(h.message.split(" approximately ")[1].split()[0])) for h in hits if h.rule_id == "JSCS001") == long_


def test_one_large_file_is_no_quadratic_work(make_files):
    import time

    def seconds(n):
        text = "\n".join(["function f() {", "{", "try { a(); } catch (e)", "{"] * (n // 4))
        files = make_files(("a.js", text), ("b.cs", "catch (Exception e) {\n\n}\n" * (n // 3)))
        start = time.perf_counter()
        assert text_rule_hits(files, ["JSCS001", "JSCS008", "CS_SEC004"]).count() > n // 3
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(40_000) < 3 * seconds(20_000) + 2


def test_source_and_sink_labels_are_what_patterns_find():
    """The labels came from the operator; patterns over the lines, with strings cut out, find the same sources and sinks."""
    import re

    from siftmill.fixtures import snippets
    from siftmill.operators.taint import SINKS, SOURCES

    want = {"SRC": set(), "SINK": set()}
    for i, language, _, _, text in snippets.templates():
        if language != "python" or i in snippets.UNPARSABLE:
            continue
        bare = re.sub(r'"""(?:.|\n)*?"""|"[^"\n]*"|\'[^\'\n]*\'', lambda m: "0" + "\n" * m[0].count("\n"), text)
        for n, line in enumerate(bare.split("\n"), 1):
            line = line.split("#")[0]
            if re.match(r"\s*(async\s+)?(def|class|import|from)\b", line):
                continue
            for m in re.finditer(r"(?<![\w.)\]])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", line):
                parts, called = m[0].split("."), line[m.end() :].startswith("(")
                for k in range(2, len(parts) + 1):
                    if ".".join(parts[:k]).endswith(tuple(SOURCES)):
                        want["SRC"].add((i, n, "Attribute|" + ".".join(parts[:k])))
                if called and m[0].endswith(tuple(SOURCES)):
                    want["SRC"].add((i, n, "Call|" + m[0]))
                if called and any(m[0] == s or m[0].endswith("." + s) for s in SINKS):
                    label = next(v for s, v in SINKS.items() if m[0] == s or m[0].endswith("." + s))
                    want["SINK"].add((i, n, f"{m[0]}|{label}"))
    got = {"SRC": set(), "SINK": set()}
    for i, rule, n, message in snippets.labels():
        if rule in got:
            got[rule].add((i, n, message if rule == "SRC" else message.split("|", 1)[1]))
    assert got == want
