import re

from pyspark.sql import functions as F

from siftmill.functions import text as T

EDGES = ["", "\n", "a", "a\n", "a\r\nb", "a\rb\r", "\fa\x0bb", "a\x85b c ", "\n\n a \n", "x\x1cy\x1dz\x1e", "  é\t"]


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def test_lines_are_those_of_splitlines(spark):
    rows = column(spark, EDGES).select("i", T.split_lines(F.col("t")).alias("x")).collect()
    assert {r.i: list(r.x) for r in rows} == {i: v.splitlines() for i, v in enumerate(EDGES)}


def test_strip_and_blank(spark):
    rows = column(spark, EDGES).select("t", T.strip(F.col("t")).alias("s"), T.is_blank(F.col("t")).alias("b")).collect()
    assert all(r.s == r.t.strip() and r.b == (not r.t.strip()) for r in rows)


def test_snippet_at_every_line(spark):
    text = "one\ntwo\nthree\nfour\nfive"
    lines = text.splitlines()

    def expected(n):
        return "\n".join(f"{'>>> ' if i == n else '    '}{i}: {lines[i - 1]}" for i in range(max(1, n - 2), min(5, n + 2) + 1))

    rows = spark.range(1, 6).select("id", T.snippet(T.split_lines(F.lit(text)), F.col("id").cast("int")).alias("s")).collect()
    assert {r.id: r.s for r in rows} == {n: expected(n) for n in range(1, 6)}
    assert spark.range(1).select(T.snippet(T.split_lines(F.lit("")), F.lit(1)).alias("s")).first().s == ""


def test_match_lines(spark):
    pattern = r"b\s+c|d"
    texts = ["", "b c", "a\nb\n\nc d\nd", "d\nd\n\nb  c\x01d", "b\nb c\n"]
    rows = column(spark, texts).select("t", T.match_lines(F.col("t"), pattern).alias("n")).collect()
    for r in rows:
        assert list(r.n) == [r.t[: m.start()].count("\n") + 1 for m in re.finditer(pattern, r.t)]


def test_token_volume(spark):
    import math

    texts = ["", "   ", "a", "a b a + b", "é_x1 = 'ü'"]
    rows = column(spark, texts).select("t", T.token_volume(F.col("t")).alias("v")).collect()
    for r in rows:
        tokens = re.findall(r"[a-zA-Z_]\w*|[^\s\w]", r.t)
        want = max(1.0, len(tokens) * math.log2(max(1, len(set(tokens)))))
        assert abs(r.v - want) < 1e-9


def test_gate_passes_escaped_and_joined_literals(spark):
    texts = ['x = "SELECT"', 'x = "\\x53ELECT"', 'x = "SEL" "ECT"', 'x = ("SEL"  # c\n  f"ECT")', "ｓelect", "y = 1"]
    rows = column(spark, texts).select("i", T.may_name(F.col("t"), ["select"], True).alias("g")).collect()
    assert [r.g for r in sorted(rows)] == [True] * 5 + [False]


def test_decode_and_paths(spark):
    from siftmill.sources import files as S

    raw = spark.createDataFrame([(b"a\xff\xc3b\xe9",), ("é\n".encode(),)], "c binary")
    assert [r.t for r in raw.select(S.decode(F.col("c")).alias("t")).collect()] == ["ab", "é\n"]
    paths = {"a.py": "python", "x/a.PY": "unknown", ".py": "unknown", "a.b.tsx": "javascript", "c.cs": "csharp", "q.sql": "sql", "py": "unknown"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.language_of(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in rows} == paths
    keep = {"a.py": True, "src/a.py": True, "node_modules/a.py": False, "x/.git/a.js": False, "p.egg-info/a.py": False, "build2/a.py": True, "env/a.py": False, ".a.py": True}
    rows = spark.createDataFrame([(p,) for p in keep], "p string").select("p", S.is_source_path(F.col("p")).alias("k")).collect()
    assert {r.p: r.k for r in rows} == keep
