"""JavaScript structure facts and function metrics, from lines. All narrow; a file stays one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import let, occurrences, running_sum, split_lines, strip, uregex
from siftmill.operators import line_patterns as P

# Fixed value: lines of a function body that its metrics see, unless more are asked for.
METRIC_LINES = 200


def _first_group(line: Column, patterns: list[str], excluded: list[str] | None = None) -> Column:
    """Group 1 of the first pattern (in order) that matches with a name not excluded; '' when none does."""
    out = F.lit("")
    for pattern in reversed(patterns):
        found = F.regexp_extract(line, uregex(pattern), 1)
        keep = found != ""
        if excluded:
            keep = keep & ~found.isin(excluded)
        out = F.when(keep, found).otherwise(out)
    return out


def function_name(line: Column) -> Column:
    return _first_group(line, P.JS_FUNCTIONS)


def brace_index(delta: Column) -> Column:
    """Depth after each line (``delta``: net braces per line), and the highest and lowest depth of blocks of ``width`` lines.

    Searches skip whole blocks by these, so looking for the end of every function of a file isn't quadratic in its lines.
    """

    def indexed(depths: Column, width: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(depths), F.lit(1)), width)
        return F.struct(
            depths.alias("depths"), width.alias("width"),
            F.transform(starts, lambda s: F.array_max(F.slice(depths, s, width))).alias("highs"),
            F.transform(starts, lambda s: F.array_min(F.slice(depths, s, width))).alias("lows"),
        )

    width = lambda d: F.greatest(F.ceil(F.sqrt(F.size(d))).cast("int"), F.lit(1))
    return let(running_sum(delta), lambda d: let(width(d), lambda w: indexed(d, w)))


def _first_from(index: Column, extremes: str, start: Column, test: Callable[[Column], Column]) -> Column:
    """First line from ``start`` (1-based) on whose depth passes ``test``, 0 if none; a block whose extreme fails holds none."""
    depths, width = index["depths"], index["width"]
    place = lambda values: F.array_position(F.transform(values, test), F.lit(True)).cast("int")
    block = F.floor((start - 1) / width).cast("int")
    here = place(F.slice(depths, start, (block + 1) * width - start + 1))
    later = place(F.slice(index[extremes], block + 2, F.size(index[extremes])))
    there = let(later, lambda n: F.when(n > 0, let((block + n) * width, lambda before: before + place(F.slice(depths, before + 1, width)))).otherwise(0))
    return let(here, lambda n: F.when(n > 0, start + n - 1).otherwise(there))


def braced_length(index: Column, start: Column, limit: Column, unclosed: Column) -> Column:
    """Lines from ``start`` (1-based) to where the braces opened since then are closed again.

    ``index`` is the file's ``brace_index``. When they never close within ``limit`` lines the length is ``unclosed``.
    """

    def ended(base: Column) -> Column:
        opened = _first_from(index, "highs", start, lambda d: d > base)
        closed = let(opened, lambda n: F.when(n > 0, _first_from(index, "lows", n, lambda d: d <= base)).otherwise(0))
        return let(closed, lambda n: F.when((n > 0) & (n - start < limit), n - start + 1).otherwise(unclosed))

    return let(F.when(start > 1, F.get(index["depths"], start - 2)).otherwise(0), ended)


def _js_lines(files: DataFrame) -> DataFrame:
    js = files.filter(F.col("language") == "javascript")
    return js.select(
        "project_id", "path", F.posexplode(split_lines(F.col("text"))).alias("pos", "src")
    ).select("project_id", F.col("path").alias("file"), (F.col("pos") + 1).alias("line"), "src")


def js_functions(files: DataFrame) -> DataFrame:
    return (
        _js_lines(files).filter(F.col("src").rlike("function|=>"))
        .select("project_id", "file", "line", function_name(F.col("src")).alias("name"), strip(F.col("src")).alias("body"))
        .filter(F.col("name") != "")
    )


def js_classes(files: DataFrame) -> DataFrame:
    return (
        _js_lines(files)
        .select("project_id", "file", "line", F.regexp_extract("src", uregex(P.JS_CLASS), 1).alias("name"),
                strip(F.col("src")).alias("body"))
        .filter(F.col("name") != "")
    )


def js_imports(files: DataFrame) -> DataFrame:
    return (
        _js_lines(files).filter(F.col("src").rlike(uregex(P.JS_IMPORT)))
        .select("project_id", "file", "line", strip(F.col("src")).alias("statement"))
    )


def js_calls(files: DataFrame) -> DataFrame:
    names = F.regexp_extract_all(F.col("src"), F.lit(uregex(P.JS_CALL)), F.lit(1))
    return (
        _js_lines(files).select("project_id", "file", "line", F.explode(names).alias("name"))
        .filter(~F.col("name").isin(P.JS_CALL_KEYWORDS))
    )


def js_variables(files: DataFrame) -> DataFrame:
    return (
        _js_lines(files)
        .select("project_id", "file", "line", F.regexp_extract("src", uregex(P.JS_VARIABLE), 1).alias("name"))
        .filter(F.col("name") != "")
    )


def decision_count(body: Column) -> Column:
    total = F.lit(1)
    for pattern in P.JS_DECISIONS:
        total = total + F.regexp_count(body, F.lit(uregex(pattern)))
    return total


def js_function_metrics(files: DataFrame, most_lines: int | None = METRIC_LINES) -> DataFrame:
    """(project_id, file, line, name, length, complexity) per function start; bodies end after ``most_lines`` (None: never)."""
    js = files.filter(F.col("language") == "javascript").select(
        "project_id", "path", split_lines(F.col("text")).alias("lines")
    )
    rows = js.withColumn("braces", brace_index(F.transform("lines", lambda x: occurrences(x, "{") - occurrences(x, "}"))))
    named = F.filter(
        F.transform(
            "lines",
            lambda x, i: F.struct(
                (i + 1).alias("line"), _first_group(x, P.JS_METRIC_FUNCTIONS, P.JS_METRIC_KEYWORDS).alias("name")
            ),
        ),
        lambda f: f["name"] != "",
    )
    cap = F.size("lines") if most_lines is None else F.lit(most_lines)
    sized = F.transform(
        F.col("starts"),
        lambda f: F.struct(
            f["line"].alias("line"), f["name"].alias("name"),
            braced_length(F.col("braces"), f["line"], cap, F.least(cap, F.size("lines") - f["line"] + 1)).alias("length"),
        ),
    )
    measured = F.transform(
        F.col("sized"),
        lambda f: F.struct(
            f["line"].alias("line"), f["name"].alias("name"), f["length"].alias("length"),
            decision_count(F.array_join(F.slice(F.col("lines"), f["line"], f["length"]), "\n")).alias("complexity"),
        ),
    )
    return (
        rows.withColumn("starts", named).filter(F.size("starts") > 0).withColumn("sized", sized)
        .select("project_id", F.col("path").alias("file"), F.explode(measured).alias("f"))
        .select("project_id", "file", "f.line", "f.name", "f.length", "f.complexity")
    )
