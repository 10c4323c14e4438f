"""Versions sort as they should, ranges hold what lies inside them, and advisories with ranges hit exactly that."""

import random

from pyspark.sql import functions as F

from siftmill.functions.versions import LAST, LEVELS, point_nodes, range_nodes, version_key
from siftmill.operators import deps
from siftmill.schemas import ADVISORIES, RANGES

ORDER = ["0", "0.0.1", "0.9", "1.0.dev2", "1.0-next.3", "1.0a1", "1.0.0b2", "1.0rc1", "1.0.0rc10", "1.0", "1.0.post1", "1.0.1", "1.2", "1.10.0", "2", "10.0", "2024.1", "99999999999999.1", "1!0.5"]


def test_versions_sort(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ORDER)], "i int, v string").withColumn("k", version_key(F.col("v"))).collect()
    order = [r.v for r in sorted(rows, key=lambda r: r.k)]
    expected = [v for v in ORDER if v != "1.0-next.3"]
    assert [v for v in order if v != "1.0-next.3"] == expected and order.index("0.9") < order.index("1.0-next.3") < order.index("1.0")
    same = spark.createDataFrame([("1",), ("1.0.0",), ("v1.0",), ("01.00",), ("1.0+build.5",)], "v string").select(version_key(F.col("v")).alias("k")).distinct()
    assert same.count() == 1
    assert [r.k for r in spark.createDataFrame([("",), ("latest",), (None,)], "v string").select(version_key(F.col("v")).alias("k")).collect()] == [None] * 3


def test_nodes_hold_each_leaf_once(spark):
    rnd = random.Random(4)
    ranges = [(rnd.randrange(3000), 0) for _ in range(60)]
    ranges = [(a, min(LAST, a + rnd.choice([0, 1, 5, 100, LAST]))) for a, _ in ranges] + [(0, LAST), (LAST, LAST), (0, 0)]
    held = spark.createDataFrame(ranges, "a int, b int").select("a", "b", range_nodes(F.col("a"), F.col("b")).alias("n")).collect()
    points = {r.p: {(n.level, n.node) for n in r.n} for r in spark.createDataFrame([(p,) for p in [*range(0, 3200, 7), LAST]], "p int").select("p", point_nodes(F.col("p")).alias("n")).collect()}
    for r in held:
        nodes = [(n.level, n.node) for n in r.n]
        assert len(nodes) <= 2 * (LEVELS + 1)
        for p, own in points.items():
            assert sum(n in own for n in nodes) == (r.a <= p <= r.b)


def test_ranges_hit_the_versions_inside_them_and_no_others(spark):
    told = [
        ("A", [("1.0", "1.4", None)]), ("B", [("0", "1.0", None)]), ("C", [(None, None, "1.2")]), ("D", [("2.0", None, None)]), ("E", [("1.3", "1.3.1", None), ("1.2.9", "1.4", None)]),
        ("F", [("3", "2", None)]), ("G", []), ("H", None), ("I", [("1.0rc1", "1.0", None)]),
    ]
    advisories = spark.createDataFrame([("PyPI", "x", "7.7" if i == "G" else None, i, None, "", ["r"], r) for i, r in told], f"{ADVISORIES}, {RANGES}")
    versions = ["0.9", "1.0rc1", "1.0", "1.2", "1.2.1", "1.3", "1.3.5", "1.4", "2.0.0", "2024.1", "7.7", "latest"]
    rows = spark.createDataFrame([(f"p{i % 3}", "PyPI", "requirements.txt", i, "x", v) for i, v in enumerate(versions * 2)], "project_id string, ecosystem string, manifest string, ord int, name string, version string")
    got = {}
    for r in deps.vulnerable(rows.union(rows.filter("ord = 0").withColumn("ecosystem", F.lit("npm"))), advisories).collect():
        got.setdefault(r.vuln_id, []).append(r.version)
    want = {
        "A": ["1.0", "1.2", "1.2.1", "1.3", "1.3.5"], "B": ["0.9", "1.0rc1"], "C": ["0.9", "1.0rc1", "1.0", "1.2"], "D": ["2.0.0", "2024.1", "7.7"],
        "E": ["1.3", "1.3.5"], "G": ["7.7"], "I": ["1.0rc1"],
    }
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v * 2) for k, v in want.items()}
