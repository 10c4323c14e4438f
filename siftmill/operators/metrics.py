"""Size and complexity metrics, as tall rows (project, file, type, name, value, details)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import is_blank, split_lines, starts_trimmed, token_volume
from siftmill.operators.fact_rules import function_complexity
from siftmill.operators.facts import FUNCTION_TYPES
from siftmill.operators.js_facts import js_function_metrics

# Comment marks per language.
COMMENT_MARKS = {"python": ["#"], "javascript": ["//", "*", "/*"]}


def line_counts(files: DataFrame, language: str, marks: list[str] | None = None) -> DataFrame:
    """total, blank, comment and code lines per file; narrow, one regex per line kind."""
    marks = marks or COMMENT_MARKS[language]
    rows = files.filter(F.col("language") == language).select("project_id", F.col("path").alias("file"), split_lines(F.col("text")).alias("lines"))
    counted = rows.select(
        "project_id", "file", F.size("lines").alias("total"),
        F.size(F.filter("lines", is_blank)).alias("blank"),
        F.size(F.filter("lines", lambda x: starts_trimmed(x, marks))).alias("comment"),
    )
    return counted.withColumn("code", F.col("total") - F.col("blank") - F.col("comment"))


def tall_line_counts(counts: DataFrame) -> DataFrame:
    """Four metric rows per file; the first carries the counts as text."""
    text = F.format_string("{'total': %d, 'code': %d, 'comment': %d, 'blank': %d}", "total", "code", "comment", "blank")
    row = lambda name, column, details: F.struct(
        F.lit(name).alias("metric_name"), F.col(column).cast("double").alias("value"), details.alias("details"))
    none = F.lit(None).cast("string")
    rows = F.array(row("Total Lines", "total", text), row("Code Lines", "code", none),
                   row("Comment Lines", "comment", none), row("Blank Lines", "blank", none))
    return counts.select("project_id", "file", F.lit("loc").alias("metric_type"), F.inline(rows))


def complexity_metrics(functions: DataFrame) -> DataFrame:
    """From (project_id, file, line, name, complexity)."""
    return functions.select(
        "project_id", "file", F.lit("cyclomatic_complexity").alias("metric_type"), F.concat(F.lit("CC: "), "name").alias("metric_name"),
        F.col("complexity").cast("double").alias("value"), F.concat(F.lit("line "), "line").alias("details"),
    )


def length_metrics(functions: DataFrame) -> DataFrame:
    return functions.select(
        "project_id", "file", F.lit("function_length").alias("metric_type"), F.concat(F.lit("Length: "), "name").alias("metric_name"),
        F.col("length").cast("double").alias("value"), F.concat(F.lit("line "), "line").alias("details"),
    )


def average_complexity(functions: DataFrame) -> DataFrame:
    """Mean over the functions of a file, two decimals; files without functions give no row."""
    return functions.groupBy("project_id", "file").agg(F.round(F.avg("complexity"), 2).alias("value")).select(
        "project_id", "file", F.lit("avg_complexity").alias("metric_type"), F.lit("Average Cyclomatic Complexity").alias("metric_name"),
        "value", F.lit(None).cast("string").alias("details"),
    )


def python_complexity(facts: DataFrame) -> DataFrame:
    return function_complexity(facts).select("project_id", F.col("path").alias("file"), F.col("lineno").alias("line"), "name", "complexity")


def python_lengths(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("node_type").isin(FUNCTION_TYPES)).select(
        "project_id", F.col("path").alias("file"), F.col("lineno").alias("line"), "name",
        (F.col("end_lineno") - F.col("lineno") + 1).alias("length"),
    )


def maintainability(volume: Column, mean_complexity: Column, code_lines: Column) -> Column:
    """171 - 5.2 ln V - 0.23 G - 16.2 ln LOC, kept within 0 to 100."""
    raw = 171 - 5.2 * F.ln(F.greatest(volume, F.lit(1.0))) - 0.23 * mean_complexity - 16.2 * F.ln(F.greatest(code_lines, F.lit(1)).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def maintainability_metrics(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Index per Python file that parses.

    The facts side is folded to one row per file first (its Module row makes files without functions appear);
    the text side sends two numbers per file, never the text, through the join.
    """
    parsed = function_complexity(facts, with_files=True).groupBy("project_id", "path").agg(
        F.avg(F.when(F.col("name").isNotNull(), F.col("complexity"))).alias("mean_cc"))
    text = (
        files.filter(F.col("language") == "python")
        .select("project_id", "path", split_lines(F.col("text")).alias("lines"), token_volume(F.col("text")).alias("volume"))
        .select("project_id", "path", "volume",
                F.size(F.filter("lines", lambda x: ~is_blank(x) & ~starts_trimmed(x, ["#"]))).alias("code"))
    )
    index = F.round(maintainability(F.col("volume"), F.coalesce("mean_cc", F.lit(1.0)), F.col("code")), 2)
    return text.join(parsed, ["project_id", "path"]).select(
        "project_id", F.col("path").alias("file"), F.lit("maintainability_index").alias("metric_type"),
        F.lit("Maintainability Index").alias("metric_name"), index.alias("value"), F.lit(None).cast("string").alias("details"),
    )


def javascript_metrics(files: DataFrame) -> DataFrame:
    functions = js_function_metrics(files)
    return (
        tall_line_counts(line_counts(files, "javascript")).unionByName(complexity_metrics(functions))
        .unionByName(length_metrics(functions)).unionByName(average_complexity(functions))
    )


def python_metrics(files: DataFrame, facts: DataFrame) -> DataFrame:
    parsed = facts.filter(F.col("node_type") == "Module").select("project_id", F.col("path").alias("file"))
    functions = python_complexity(facts)
    counts = line_counts(files, "python").join(parsed, ["project_id", "file"], "left_semi")
    return (
        tall_line_counts(counts).unionByName(complexity_metrics(functions))
        .unionByName(average_complexity(functions)).unionByName(length_metrics(python_lengths(facts)))
        .unionByName(maintainability_metrics(files, facts))
    )
