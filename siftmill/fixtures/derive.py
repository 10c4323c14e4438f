"""Inputs of the registered queries, derived from the given tables: in Spark here, in SQL for the oracle below.

Every input is a projection of (or a join onto) a whole table, so its size follows the data.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.fixtures import snippets

TEMPLATES = snippets.templates()
K = len(TEMPLATES)
EXTENSION = {"python": ".py", "javascript": ".js", "sql": ".sql", "csharp": ".cs"}

REQUIREMENTS = [
    "requests==@V@\nflask>=@V@ # web\nPyYAML ~= @V@\n-r other.txt\n\n# note\nnumpy\nDjango[argon2]==4.2\n",
    "httpx>=1.0,<2\nlxml!=3.0\nunused-package==@V@\nopencv-python==@V@\nasyncio-helper\n",
    "",
    "# only comments\n-e .\n",
    "flask==@V@\n  requests == @V@ ; python_version > '3'\nDB==1\napp\n",
]
PACKAGE_JSON = [
    '{"dependencies": {"express": "^@V@", "lodash": "~@V@"}, "devDependencies": {"jest": ">=@V@", "express": "1.0"}}',
    '{"devDependencies": {"left-pad": "@V@"}}',
    '{"dependencies": {"express": ',
    '{"name": "x"}',
]
ADVISORY_PACKAGES = [("PyPI", "requests"), ("PyPI", "flask"), ("PyPI", "PyYAML"), ("PyPI", "opencv-python"),
                     ("npm", "express"), ("npm", "lodash"), ("npm", "jest"), ("npm", "left-pad")]
ADVISORY_DETAILS = ["A critical flaw", "Remote Code Execution by upload", "open source note", "High load", "SQL injection in filter",
                    "buffer overflow", "moderate impact", "stored XSS", "nothing known", ""]


def table(spark: SparkSession, sf: str, name: str, stream: bool = False) -> DataFrame:
    """A given table, or a stream over its files."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spark.readStream.schema(rows.schema).parquet(f"{sf}/{name}*.parquet") if stream else rows


#: Orders of which one task makes and reads the files: a few bytes of a row become a whole text, so bytes say nothing here.
ORDERS_PER_TASK = 20_000


def spread(rows: DataFrame, key: str, per_task: int | None = None) -> DataFrame:
    """A table that sits in fewer input splits than there are cores is spread by key; larger ones stay as they are.

    With ``per_task``, into as many parts as have that many rows each, at least one a core: the count comes from the files' footers.
    """
    if rows.isStreaming:
        return rows
    parts = rows.sparkSession.sparkContext.defaultParallelism
    if per_task:
        return rows.repartition(max(parts, -(-rows.count() // per_task)), key)
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts, key)


def corpus(spark: SparkSession, sf: str, language: str | None = None, stream: bool = False) -> DataFrame:
    """One file per order: a snippet under 0 to 2 comment lines that name the order."""
    rows = [t for t in TEMPLATES if language is None or t[1] == language]
    known = spark.createDataFrame(rows, "template_id int, language string, suffix string, mark string, body string")
    orders = spread(table(spark, sf, "orders", stream).select("o_orderkey", "o_custkey"), "o_orderkey", ORDERS_PER_TASK)
    note = F.concat("mark", F.lit(" order "), F.col("o_orderkey").cast("string"), F.lit("\n"))
    # A fixed table of a few dozen snippets.
    return orders.join(F.broadcast(known), F.col("o_orderkey") % K == F.col("template_id")).select(
        F.concat(F.lit("c"), "o_custkey").alias("project_id"), F.concat(F.lit("src/f"), "o_orderkey", "suffix").alias("path"),
        "language", F.concat(F.repeat(note, (F.col("o_custkey") % 3).cast("int")), "body").alias("text"),
    )


def prose(spark: SparkSession, sf: str, language: str, stream: bool = False) -> DataFrame:
    """Documents and pages, read as files of a language."""
    docs = spread(table(spark, sf, "documents", stream), "doc_id").select(
        F.col("source").alias("project_id"), F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(EXTENSION[language])).alias("path"),
        F.lit(language).alias("language"), "text")
    pages = spread(table(spark, sf, "pages", stream), "page_id").select(
        F.lit("web").alias("project_id"), F.concat(F.lit("pages/"), "page_id", F.lit(EXTENSION[language])).alias("path"),
        F.lit(language).alias("language"), F.col("html").alias("text"))
    return docs.unionByName(pages)


def text_files(spark: SparkSession, sf: str, language: str) -> DataFrame:
    code = corpus(spark, sf, language)
    return code if language == "python" else code.unionByName(prose(spark, sf, language))


def documents(spark: SparkSession, sf: str, language: str = "unknown") -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("source").alias("project_id"), F.concat(F.lit("doc"), "doc_id").alias("path"), F.lit(language).alias("language"), "text")


def turns(spark: SparkSession, sf: str, language: str = "unknown") -> DataFrame:
    return spread(table(spark, sf, "conversations"), "conv_id").select(
        F.lit("conversations").alias("project_id"), F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("path"),
        F.lit(language).alias("language"), "text")


def _choose(index, values):
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(index == i, F.lit(v)).otherwise(out)
    return out


SUFFIXES = [".py", ".js", ".tsx", ".sql", ".cs"]
RULES = ["SEC003", "JSEC001", "SQL003", "CS005", "MAINT002", "DEP001", "TAINT001"]
SEVERITIES = ["INFO", "MINOR", "MAJOR", "CRITICAL", "BLOCKER"]
CATEGORIES = ["SECURITY", "CODE_SMELL", "PERFORMANCE", "COMPLEXITY", "MAINTAINABILITY"]
LABELS = ["A01:2021-Broken Access Control", "A03:2021-Injection", "A07:2021-Identification and Authentication Failures"]
STATUSES = ["completed", "running", "failed"]


def issues(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda *c: F.concat_ws("-", *[F.col(x).cast("string") for x in c])
    quantity, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    category = F.when(n == 6, "DEPENDENCY").otherwise(_choose((F.col("l_partkey") + quantity) % 5, CATEGORIES))
    rule = _choose(n - 1, RULES)
    return table(spark, sf, "lineitem").select(
        F.concat(key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit("-"), F.date_format("l_shipdate", "yyyyMMdd")).alias("issue_id"),
        F.concat(F.lit("p"), "l_suppkey").alias("project_id"), F.concat(F.lit("s"), "l_orderkey").alias("scan_id"),
        F.concat(F.lit("src/m"), "l_partkey", _choose(F.col("l_partkey") % 5, SUFFIXES)).alias("file"),
        (quantity * 10).alias("line"), F.lit(0).alias("column"), rule.alias("rule_id"), F.concat(F.lit("Name of "), rule).alias("rule_name"),
        _choose(quantity % 5, SEVERITIES).alias("severity"), category.alias("category"),
        F.concat(F.lit("SQL Injection found, injection and XSS in line "), (quantity * 10).cast("string")).alias("message"),
        F.when(n != 4, "Review it.").alias("suggestion"),
        F.when(category == "SECURITY", _choose(F.col("l_partkey") % 3, LABELS)).alias("owasp_category"),
        F.when(n != 5, F.concat(F.lit(">>> 1: x = "), F.col("l_partkey").cast("string"))).alias("code_snippet"),
        F.col("l_shipdate").alias("ts"),
    )


def scans(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("s"), "o_orderkey").alias("scan_id"), F.concat(F.lit("p"), "o_custkey").alias("project_id"), status.alias("status"),
        (k % 97).alias("total_issues"), (k % 3).alias("blocker_count"), (k % 5).alias("critical_count"), (k % 7).alias("major_count"),
        (k % 11).alias("minor_count"), (k % 13).alias("info_count"), (k % 17).alias("files_scanned"), (k % 1009).alias("lines_scanned"),
        F.col("o_totalprice").alias("scan_duration_seconds"), F.col("o_orderdate").alias("started_at"),
        F.when(status == "completed", F.col("o_orderdate")).alias("completed_at"),
    )


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    row = lambda kind, name, value: F.struct(F.lit(kind).alias("metric_type"), name.alias("metric_name"), value.cast("double").alias("value"))
    rows = F.array(row("cyclomatic_complexity", F.concat(F.lit("CC: "), "p_brand"), F.col("p_size")),
                   row("loc", F.lit("Total Lines"), F.col("p_partkey") % 500), row("maintainability_index", F.lit("Maintainability Index"), F.col("p_size") * 2))
    return part.select(
        F.concat(F.lit("p"), (F.col("p_partkey") % 100).cast("string")).alias("project_id"),
        F.concat(F.lit("src/m"), "p_partkey", _choose(F.col("p_partkey") % 5, SUFFIXES)).alias("file"), F.inline(rows),
        F.col("p_type").alias("p_type"), F.col("p_size").alias("p_size"),
    ).select("project_id", "file", "metric_type", "metric_name", "value", F.col("p_type").alias("details"),
             (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("p_size"))).alias("ts"))


def projects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.concat(F.lit("p"), "c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.concat(F.lit("/srv/"), "c_name").alias("path"),
        F.when(F.col("c_nationkey") != 3, F.lower("c_mktsegment")).alias("language"),
        (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(F.col("c_nationkey"))).alias("created_at"),
    )


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """requirements.txt and package.json of every third-party-free or declaring project (one per customer)."""
    c = F.col("c_custkey")
    version = F.concat((c % 50 + 1).cast("string"), F.lit(".0"))
    base = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(F.concat(F.lit("c"), "c_custkey").alias("project_id"), c, version.alias("v"))
    one = lambda name, texts: base.filter(c % 7 < len(texts)).select(
        "project_id", F.lit(name).alias("manifest"), F.replace(_choose(c % 7, texts), F.lit("@V@"), F.col("v")).alias("text"))
    return one("requirements.txt", REQUIREMENTS).unionByName(one("package.json", PACKAGE_JSON))


def advisories(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").select(
        _choose(p % 8, [e for e, _ in ADVISORY_PACKAGES]).alias("ecosystem"), _choose(p % 8, [n for _, n in ADVISORY_PACKAGES]).alias("package"),
        F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("version"), F.concat(F.lit("ADV-"), p.cast("string")).alias("vuln_id"),
        F.when(p % 9 != 0, F.col("p_name")).alias("summary"), _choose(p % 10, ADVISORY_DETAILS).alias("details"),
        F.transform(F.sequence(F.lit(1), (p % 5 + 1).cast("int")), lambda i: F.concat(F.lit("https://a/"), i.cast("string"))).alias("refs"),
        _ranges(F.floor(p / 8) % 4, F.col("p_size")).alias("ranges"),
    )


def _ranges(kind, n):
    """None, two versions up to a fix, everything before 2.0 and two single versions, or from a version on to 3.1 less and no end."""
    text = lambda c: c.cast("string")
    one = lambda a=None, b=None, c=None: F.struct(*[F.lit(x).cast("string").alias(k) if x is None or isinstance(x, str) else x.alias(k) for k, x in (("introduced", a), ("fixed", b), ("last_affected", c))])
    return (
        F.when(kind == 1, F.array(one(text(n), F.concat(text(n + 2), F.lit(".0.0")))))
        .when(kind == 2, F.array(one("0", "2.0"), one(F.concat(text(n), F.lit(".0rc1")), None, F.concat(text(n), F.lit(".0"))), one(text(n), F.concat(text(n), F.lit(".0.1")))))
        .when(kind == 3, F.array(one("49.5"), one(F.concat(text(n), F.lit(".0.post1")), F.concat(text(n + 1), F.lit(".1")))))
    )


def visits(spark: SparkSession, sf: str, stream: bool = False) -> DataFrame:
    return table(spark, sf, "events", stream).select(
        "user_id", F.concat(F.lit("p"), F.get_json_object("props", "$.k")).alias("project"), "ts")


def tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths and sizes as a file tree would list them, one per line item."""
    folders = ["src", "node_modules/x", ".git", "build", "pkg.egg-info", "lib/.hidden/y", "venv", "Build", "src/env2", "docs"]
    names = ["a.py", "b.PY", "c.tsx", "d.min.js", "e.cs", "f.sql", "g.md", ".py", "h.py.bak"]
    rows = table(spark, sf, "lineitem")
    return rows.select(
        F.concat(F.lit("p"), "l_suppkey").alias("project_id"),
        F.concat(_choose(F.col("l_partkey") % 10, folders), F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("/"),
                 _choose(F.col("l_orderkey") % 9, names)).alias("path"),
        (F.col("l_extendedprice") * 10).cast("bigint").alias("size_bytes"),
    )


# -- the same inputs as SQL -------------------------------------------------------------------------------------


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _case(index: str, values: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values[:-1])) + f" ELSE {q(values[-1])} END"


@lru_cache
def sql_corpus(language: str | None = None) -> str:
    rows = [t for t in TEMPLATES if language is None or t[1] == language]
    values = ", ".join(f"({i}, {q(lang)}, {q(s)}, {q(m)}, {q(b)})" for i, lang, s, m, b in rows)
    return (
        f"templates(template_id, language, suffix, mark, body) AS (VALUES {values}), "
        "corpus AS (SELECT template_id, 'c' || o_custkey AS project_id, 'src/f' || o_orderkey || suffix AS path, language, "
        "o_custkey % 3 AS shift, repeat(mark || ' order ' || o_orderkey || chr(10), CAST(o_custkey % 3 AS BIGINT)) || body AS text "
        f"FROM orders JOIN templates ON o_orderkey % {K} = template_id)"
    )


def sql_prose(language: str) -> str:
    return (
        f"SELECT source AS project_id, 'docs/' || source || '/' || doc_id || '{EXTENSION[language]}' AS path, text FROM documents "
        f"UNION ALL SELECT 'web', 'pages/' || page_id || '{EXTENSION[language]}', html FROM pages"
    )


def sql_files(language: str) -> str:
    more = "" if language == "python" else f" UNION ALL {sql_prose(language)}"
    skip = f" WHERE template_id NOT IN ({', '.join(map(str, snippets.UNPARSABLE))})" if language == "python" else ""
    return f"{sql_corpus(language)}, files AS (SELECT project_id, path, text FROM corpus{skip}{more})"


_BREAK = r"[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SQL_LINES = (
    "parts AS (SELECT project_id, path, text, regexp_split_to_array(text, '\\r\\n|" + _BREAK + "') AS a FROM files WHERE text <> ''), "
    "arrays AS (SELECT project_id, path, text, CASE WHEN regexp_matches(text, '" + _BREAK + "$') THEN a[:len(a)-1] ELSE a END AS a FROM parts), "
    "lines AS (SELECT project_id, path, CAST(generate_subscripts(a, 1) AS INTEGER) AS n, unnest(a) AS line FROM arrays)"
)


def sql_labels(rule_ids: list[str]) -> str:
    """``expected``: hand-written labels of the given rules on every file of the corpus."""
    rows = [(t, r, n, m) for t, r, n, m in snippets.labels() if r in rule_ids]
    values = ", ".join(f"({t}, {q(r)}, {n}, {q(m)})" for t, r, n, m in rows)
    return (
        f"labels(template_id, rule_id, n, message) AS (VALUES {values}), {sql_corpus(None)}, "
        "expected AS (SELECT c.project_id, c.path AS file, CAST(n + shift AS INTEGER) AS line, rule_id, message "
        "FROM labels JOIN corpus c USING (template_id))"
    )


SQL_ISSUES = (
    "issues AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS issue_id, "
    "'p' || l_suppkey AS project_id, 's' || l_orderkey AS scan_id, "
    f"'src/m' || l_partkey || {_case('l_partkey % 5', SUFFIXES)} AS file, CAST(l_quantity AS INTEGER) * 10 AS line, 0 AS \"column\", "
    f"{_case('l_linenumber - 1', RULES)} AS rule_id, 'Name of ' || {_case('l_linenumber - 1', RULES)} AS rule_name, "
    f"{_case('CAST(l_quantity AS INTEGER) % 5', SEVERITIES)} AS severity, "
    f"CASE WHEN l_linenumber = 6 THEN 'DEPENDENCY' ELSE {_case('(l_partkey + CAST(l_quantity AS INTEGER)) % 5', CATEGORIES)} END AS category, "
    "'SQL Injection found, injection and XSS in line ' || CAST(l_quantity AS INTEGER) * 10 AS message, "
    "CASE WHEN l_linenumber <> 4 THEN 'Review it.' END AS suggestion, "
    f"CASE WHEN l_linenumber <> 6 AND (l_partkey + CAST(l_quantity AS INTEGER)) % 5 = 0 THEN {_case('l_partkey % 3', LABELS)} END AS owasp_category, "
    "CASE WHEN l_linenumber <> 5 THEN '>>> 1: x = ' || l_partkey END AS code_snippet, l_shipdate AS ts FROM lineitem)"
)
SQL_SCANS = (
    "scans AS (SELECT 's' || o_orderkey AS scan_id, 'p' || o_custkey AS project_id, "
    "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, "
    "o_orderkey % 97 AS total_issues, o_orderkey % 3 AS blocker_count, o_orderkey % 5 AS critical_count, o_orderkey % 7 AS major_count, "
    "o_orderkey % 11 AS minor_count, o_orderkey % 13 AS info_count, o_orderkey % 17 AS files_scanned, o_orderkey % 1009 AS lines_scanned, "
    "o_totalprice AS scan_duration_seconds, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at FROM orders)"
)
_PART = f"'p' || (p_partkey % 100) AS project_id, 'src/m' || p_partkey || {_case('p_partkey % 5', SUFFIXES)} AS file"
_PART_END = "p_type AS details, TIMESTAMP '2024-01-01' + to_days(p_size) AS ts FROM part"
SQL_METRICS = (
    f"metrics AS (SELECT {_PART}, 'cyclomatic_complexity' AS metric_type, 'CC: ' || p_brand AS metric_name, CAST(p_size AS DOUBLE) AS value, {_PART_END} "
    f"UNION ALL SELECT {_PART}, 'loc', 'Total Lines', CAST(p_partkey % 500 AS DOUBLE), {_PART_END} "
    f"UNION ALL SELECT {_PART}, 'maintainability_index', 'Maintainability Index', CAST(p_size * 2 AS DOUBLE), {_PART_END})"
)
SQL_PROJECTS = (
    "projects AS (SELECT 'p' || c_custkey AS project_id, c_name AS name, '/srv/' || c_name AS path, "
    "CASE WHEN c_nationkey <> 3 THEN lower(c_mktsegment) END AS language, TIMESTAMP '2020-01-01' + to_days(c_nationkey) AS created_at FROM customer)"
)


def _manifest(name: str, texts: list[str]) -> str:
    return (
        f"SELECT 'c' || c_custkey AS project_id, {q(name)} AS manifest, "
        f"replace({_case('c_custkey % 7', texts)}, '@V@', (c_custkey % 50 + 1) || '.0') AS text FROM customer WHERE c_custkey % 7 < {len(texts)}"
    )


SQL_MANIFESTS = f"manifests AS ({_manifest('requirements.txt', REQUIREMENTS)} UNION ALL {_manifest('package.json', PACKAGE_JSON)})"
SQL_ADVISORIES = (
    f"advisories AS (SELECT {_case('p_partkey % 8', [e for e, _ in ADVISORY_PACKAGES])} AS ecosystem, "
    f"{_case('p_partkey % 8', [n for _, n in ADVISORY_PACKAGES])} AS package, p_size || '.0' AS version, 'ADV-' || p_partkey AS vuln_id, "
    f"CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS summary, {_case('p_partkey % 10', ADVISORY_DETAILS)} AS details, "
    "CAST(p_partkey % 5 + 1 AS INTEGER) AS n_refs, (p_partkey // 8) % 4 AS kind, p_size FROM part)"
)
