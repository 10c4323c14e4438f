"""Data flow against a step-by-step model on random straight-line programs."""

import random

from siftmill.operators import taint
from siftmill.operators.facts import syntax_facts


def program(seed):
    rnd, names, lines, events = random.Random(seed), "abcde", [], []
    for _ in range(rnd.randint(5, 25)):
        target, reads = rnd.choice(names), rnd.sample(names, rnd.randint(1, 2))
        kind = rnd.choice(["source", "copy", "copy", "grow", "clean", "sink"])
        text = {"source": f"{target} = input()", "copy": f"{target} = {' + '.join(reads)}", "grow": f"{target} += {reads[0]}",
                "clean": f"{target} = 1", "sink": f"eval({', '.join(reads)})"}[kind]
        lines.append(text)
        events.append((len(lines), kind, target, reads))
    return "\n".join(lines), events


def model(events):
    """All assignments of a flat module come before its calls in breadth-first order."""
    tainted, hits = set(), []
    for _, kind, target, reads in [e for e in events if e[1] != "sink"]:
        if kind == "source" or (kind in ("copy", "grow") and tainted & set(reads[:1] if kind == "grow" else reads)):
            tainted.add(target)
        elif kind != "grow":
            tainted.discard(target)
    return sorted(line for line, kind, _, reads in events if kind == "sink" and tainted & set(reads))


def test_flow_equals_the_model(spark, make_files):
    programs = {f"s{i}.py": program(i) for i in range(60)}
    files = make_files(*[(path, text) for path, (text, _) in programs.items()])
    got = {path: [] for path in programs}
    for r in taint.taint_hits(syntax_facts(files, taint.NODE_TYPES)).collect():
        got[r.file].append(r.line)
    want = {path: model(events) for path, (_, events) in programs.items()}
    assert {p: sorted(v) for p, v in got.items()} == want
    assert sum(map(len, want.values())) > 20


def test_latest_definition(spark, make_files):
    files = make_files(("a.py", "x = 1\nx = x + 2\ny = x\nx += 1\n"))
    rows = taint.definition_of_use(syntax_facts(files, taint.NODE_TYPES)).collect()
    # Events are numbered breadth-first: the four statements are nodes 1 to 4.
    assert sorted((r.name, r.use_id, r.def_id) for r in rows) == [("x", 2, 1), ("x", 3, 2)]
    defs = taint.tainted_definitions(syntax_facts(files, taint.NODE_TYPES)).collect()
    assert {(r.line, r.name, r.tainted) for r in defs} == {(1, "x", False), (2, "x", False), (3, "y", False), (4, "x", False)}


def test_long_files_fold_in_linear_time(spark, make_files):
    """16,000 events in one file, read in many batches; every name is tainted by the one before it."""
    import time

    def took(n):
        text = "\n".join(["v0 = input()", *[f"v{i} = v{i - 1} + 'x'" for i in range(1, n)], f"eval(v{n - 1})"])
        facts = syntax_facts(make_files(("a.py", text), ("b.py", "v5 = 1\neval(v5)")), taint.NODE_TYPES).persist()
        facts.count()
        start = time.perf_counter()
        assert [(r.file, r.line) for r in taint.taint_hits(facts).collect()] == [("a.py", n + 1)]
        facts.unpersist()
        return time.perf_counter() - start

    took(1000)
    assert took(16_000) < 8 * took(4_000) + 1
