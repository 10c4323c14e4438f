"""Registered queries by inventory id, and for most of them the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.fixtures import derive as D
from siftmill.fixtures.derive import q
from siftmill.functions import text as T
from siftmill.operators import clones, deps, facts as A, js_facts, metrics as M, taint
from siftmill.operators import line_patterns as P
from siftmill.operators.catalog import rule_catalog, rule_runs, rules_summary, with_metadata
from siftmill.operators.extensions import RuleSet
from siftmill.operators.fact_rules import FACT_RULES, rule_facts
from siftmill.operators.line_rules import FILE_RULES, LINE_RULES, LineRule, MagicNumberRule, text_rule_hits
from siftmill.plans import findings as W, prompts, reports as R, scan as SC
from siftmill.sources import files as S, manifests as MF
from siftmill.sources.layout import lay_out
from siftmill.streaming import history, scan_stream
from siftmill.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# -- text rules (one per rule) ----------------------------------------------------------------------------------

RE2 = {  # the same tests without look-around
    ("JSEC001", 0): r"""\.innerHTML\s*=(\s|$|[^\s'"]|['"]\s*([^\s'"]|$))""",
    ("JSEC001", 1): r"""\.outerHTML\s*=(\s|$|[^\s'"]|['"]\s*([^\s'"]|$))""",
    ("JSCS003", 0): r"(^|[^=!<>])==([^=]|$)",
    ("JSCS006", 0): r"\.then\s*\([^)]*\)",
}
HIT = "project_id, path AS file, n AS line, message"


def sql_files(languages: tuple[str, ...]) -> str:
    kept = ", ".join(q(x) for x in languages)
    skip = ", ".join(map(str, D.snippets.UNPARSABLE))
    parts = [f"SELECT project_id, path, text FROM corpus WHERE language IN ({kept}) AND template_id NOT IN ({skip})"]
    parts += [D.sql_prose(x) for x in languages if x != "python"]
    return f"{D.sql_corpus(None)}, files AS ({' UNION ALL '.join(parts)})"


def line_sql(rule: LineRule) -> str:
    cases = []
    for i, (pattern, message) in enumerate(rule.patterns):
        test = f"regexp_matches(line, {q(('(?i)' if rule.ignore_case else '') + RE2.get((rule.rule_id, i), pattern))})"
        if (rule.rule_id, i) == ("JSEC006", 1):
            head = r"jwt\.decode\s*\("
            test = f"(regexp_matches(line, {q(head)}) AND NOT regexp_matches(regexp_extract(line, {q('.*' + head + '(.*)$')}, 1), 'verify'))"
        cases.append(f"WHEN {test} THEN {q(message)}")
    message = f"CASE {' '.join(cases)} END" if cases else ""
    where = [f"NOT contains(line, {q(u)})" for u in rule.unless]
    if isinstance(rule, MagicNumberRule):
        number = r"regexp_extract(line, '(^|[^.\w])([2-9]\d{2,}|\d{4,})([^\w.]|$)', 2)"
        message = f"CASE WHEN {number} <> '' THEN 'Magic number ' || {number} || ' — use a named constant.' END"
        where += ["NOT contains(line, 'const')", "NOT contains(line, 'PORT')"]
    if rule.comments:
        marks = "|".join(c.replace("*", "\\*") for c in rule.comments)
        where.append(f"NOT regexp_matches(line, '^\\s*({marks})')")
    condition = f" WHERE {' AND '.join(where)}" if where else ""
    return (
        f"WITH {sql_files(rule.languages)}, {D.SQL_LINES} SELECT {HIT} FROM "
        f"(SELECT *, {message} AS message FROM lines{condition}) WHERE message IS NOT NULL"
    )


def _text_query(rule_id: str, languages: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        sources = [D.text_files(spark, sf, x) for x in languages]
        out = sources[0]
        for other in sources[1:]:
            out = out.unionByName(other)
        return text_rule_hits(out, [rule_id]).select("project_id", "file", "line", "message")

    return run


def _newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def match_line_sql(source: str, pattern: str) -> str:
    """(project_id, path, line) of every match in a whole text: newlines before it, plus one."""
    return (
        f"pieces AS (SELECT project_id, path, regexp_split_to_array(text, {q(pattern)}) AS g, regexp_extract_all(text, {q(pattern)}) AS h FROM {source}), "
        "found AS (SELECT project_id, path, g, h, CAST(unnest(range(1, len(h) + 1)) AS INTEGER) AS k FROM pieces WHERE len(h) > 0), "
        f"placed AS (SELECT project_id, path, CAST(1 + list_sum(list_transform(g[:k], lambda x: {_newlines('x')})) + "
        f"coalesce(list_sum(list_transform(h[:k-1], lambda x: {_newlines('x')})), 0) AS INTEGER) AS line FROM found)"
    )


def file_rule_sql(rule_id: str) -> str | None:
    head = f"WITH {sql_files(FILE_RULES[rule_id].languages)}, {D.SQL_LINES}"
    over = "OVER (PARTITION BY project_id, path ORDER BY n ROWS BETWEEN"
    if rule_id == "SEC012":
        near = f"string_agg(line, chr(10)) {over} 5 PRECEDING AND 9 FOLLOWING)"
        return (f"{head} SELECT project_id, path AS file, n AS line, {q(P.MESSAGES['SEC012'])} AS message FROM (SELECT *, {near} AS near FROM lines) "
                f"WHERE regexp_matches(line, {q('|'.join(P.ROUTES))}) AND NOT regexp_matches(near, {q('|'.join(P.ROUTE_AUTH))})")
    if rule_id == "JSEC012":
        return (f"{head} SELECT project_id, path AS file, CAST(1 AS INTEGER) AS line, {q(P.MESSAGES['JSEC012'])} AS message FROM files "
                f"WHERE regexp_matches(text, {q(P.EXPRESS)}) AND NOT regexp_matches(text, {q(P.HELMET)})")
    if rule_id == "SQL005":
        count = f"len(regexp_extract_all(text, {q('(?i)' + P.SQL_DML)}))"
        return (f"{head} SELECT project_id, path AS file, CAST(1 AS INTEGER) AS line, 'Found ' || {count} || ' DML statements with no transaction control "
                f"(BEGIN/COMMIT/ROLLBACK).' AS message FROM files WHERE {count} >= 2 AND NOT regexp_matches(text, {q('(?i)' + P.SQL_TRANSACTION)})")
    if rule_id == "CS_SEC004":
        after = f"first_value(CASE WHEN trim(line) <> '' THEN trim(line) END IGNORE NULLS) {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
        return (f"{head} SELECT {HIT} FROM (SELECT *, {after} AS after, {q(P.MESSAGES['CS_SEC004'])} AS message FROM lines) "
                f"WHERE regexp_matches(line, {q(P.CS_CATCH)}) AND after = '}}'")
    if rule_id == "JSCS004":
        return f"{head}, {match_line_sql('files', P.JS_EMPTY_CATCH)} SELECT project_id, path AS file, line, {q(P.MESSAGES['JSCS004'])} AS message FROM placed"
    if rule_id == "JSCS008":
        delta = "CASE WHEN regexp_matches(line, '^\\s*(//|\\*)') THEN 0 ELSE length(replace(line, '}', '')) - length(replace(line, '{', '')) END"
        depth = f"CAST(sum({delta}) {over} UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER)"
        return (f"{head} SELECT project_id, path AS file, n AS line, 'Code nested ' || depth || ' levels deep (max 4).' AS message "
                f"FROM (SELECT *, {depth} AS depth FROM lines) WHERE depth > 4 AND NOT regexp_matches(line, '^\\s*(//|\\*)')")
    if rule_id == "SQL003":
        # Statements are cut at ';'; heads after the last WHERE of a statement have none.
        heads = "(?i)" + P.SQL_UPDATE_HEAD
        return (
            f"{head}, cut AS (SELECT project_id, path, CAST(generate_subscripts(s, 1) AS INTEGER) AS k, unnest(s) AS stmt FROM "
            "(SELECT project_id, path, string_split(text, ';') AS s FROM files)), "
            f"placed0 AS (SELECT *, coalesce(sum({_newlines('stmt')}) OVER (PARTITION BY project_id, path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, "
            "regexp_replace(upper(stmt), '^(.|\\n)*WHERE', '') AS tail FROM cut), "
            f"tails AS (SELECT project_id, path, before + {_newlines('stmt')} - {_newlines('tail')} AS before, regexp_split_to_array(tail, {q(heads)}) AS g, "
            f"regexp_extract_all(tail, {q(heads)}) AS h FROM placed0), "
            "heads AS (SELECT *, CAST(unnest(range(1, len(h) + 1)) AS INTEGER) AS k FROM tails WHERE len(h) > 0) "
            f"SELECT project_id, path AS file, CAST(1 + before + list_sum(list_transform(g[:k], lambda x: {_newlines('x')})) + "
            f"coalesce(list_sum(list_transform(h[:k-1], lambda x: {_newlines('x')})), 0) AS INTEGER) AS line, {q(P.MESSAGES['SQL003_UPDATE'])} AS message FROM heads "
            f"UNION ALL SELECT project_id, path, n, {q(P.MESSAGES['SQL003_DELETE'])} FROM lines WHERE NOT regexp_matches(line, '^\\s*--') "
            f"AND regexp_matches(line, {q('(?i)' + P.SQL_DELETE_ALL)})"
        )
    return None


def _label_sql(rule_id: str) -> str:
    return f"WITH {D.sql_labels([rule_id])} SELECT project_id, file, line, message FROM expected"


def _code_query(rule_id: str) -> Query:
    return lambda spark, sf: text_rule_hits(D.corpus(spark, sf), [rule_id]).select("project_id", "file", "line", "message")


def _fact_query(rule_id: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rule = FACT_RULES[rule_id]
        return rule.run(rule_facts(D.corpus(spark, sf, "python"), [rule])).select("project_id", "file", "line", "message")

    return run


for _id, _rule in LINE_RULES.items():
    add(_id.lower(), _text_query(_id, _rule.languages), line_sql(_rule))
for _id, _rule in FILE_RULES.items():
    if _id == "JSCS001":
        add("jscs001", _code_query(_id), _label_sql(_id))
    else:
        add(_id.lower(), _text_query(_id, _rule.languages), file_rule_sql(_id))
for _id in FACT_RULES:
    add(_id.lower(), _fact_query(_id), _label_sql(_id))


# -- data flow --------------------------------------------------------------------------------------------------


def _flow_facts(spark: SparkSession, sf: str) -> DataFrame:
    return taint.flow_facts(D.corpus(spark, sf, "python"))


def _plain_facts(spark: SparkSession, sf: str, *types: str) -> DataFrame:
    return A.syntax_facts(D.corpus(spark, sf, "python"), types, False, False)


def _flow_candidates(spark: SparkSession, sf: str) -> DataFrame:
    files = D.corpus(spark, sf, "python")
    return taint.flow_facts(files.filter(taint.may_flow(F.col("text"))))


add("taint001", lambda s, d: taint.taint_hits(_flow_candidates(s, d)).select("project_id", "file", "line", "message"), _label_sql("TAINT001"))
add("taint_src", lambda s, d: taint.source_nodes(_plain_facts(s, d, "Attribute", "Call")),
    f"WITH {D.sql_labels(['SRC'])} SELECT project_id, file, line, split_part(message, '|', 1) AS node_type, split_part(message, '|', 2) AS name FROM expected")
add("taint_sink", lambda s, d: taint.sink_calls(_plain_facts(s, d, "Call")).drop("node_id"),
    f"WITH {D.sql_labels(['SINK'])} SELECT project_id, file, line, CAST(split_part(message, '|', 1) AS INTEGER) AS \"column\", split_part(message, '|', 2) AS name, split_part(message, '|', 3) AS label FROM expected")
add("taint_carry", lambda s, d: taint.carried(_flow_facts(s, d)))


def _definitions_sql() -> str:
    """Every assignment of the corpus; those with a hand-written mark are tainted."""
    rows = ", ".join(f"({t}, {n}, {q(k)}, {q(x)})" for t, n, k, x in D.snippets.definitions())
    return (
        f"WITH {D.sql_labels(['DEF'])}, defs(template_id, n, kind, name) AS (VALUES {rows}) "
        "SELECT c.project_id, c.path AS file, CAST(d.n + shift AS INTEGER) AS line, d.kind, d.name, l.n IS NOT NULL AS tainted "
        "FROM defs d JOIN corpus c USING (template_id) LEFT JOIN labels l ON l.template_id = d.template_id AND l.n = d.n AND l.message = d.name"
    )


add("taint_prop", lambda s, d: taint.tainted_definitions(_flow_facts(s, d)), _definitions_sql())
add("j_defuse", lambda s, d: taint.definition_of_use(_flow_facts(s, d)))


# -- facts and metrics ------------------------------------------------------------------------------------------

add("f_py_ast", lambda s, d: A.syntax_facts(D.corpus(s, d, "python"), None, False, False).groupBy("node_type").agg(F.count("*").alias("nodes")))
add("f_py_defs", lambda s, d: A.definitions(A.syntax_facts(D.corpus(s, d, "python"), A.FUNCTION_TYPES, False, False)).select("project_id", "file", "line", "name"),
    f"WITH {D.sql_labels(['PYFN'])} SELECT project_id, file, line, split_part(message, '|', 1) AS name FROM expected")
add("f_py_classes", lambda s, d: A.classes(A.syntax_facts(D.corpus(s, d, "python"), ["ClassDef"], False, False)).select("project_id", "file", "line", "name"),
    f"WITH {sql_files(('python',))}, {D.SQL_LINES} SELECT project_id, path AS file, n AS line, regexp_extract(line, '^\\s*class (\\w+)', 1) AS name "
    "FROM lines WHERE regexp_matches(line, '^\\s*class \\w+')")
add("f_py_imports", lambda s, d: A.imports(A.syntax_facts(D.corpus(s, d, "python"), ["Import", "ImportFrom"], False)).select(
        "project_id", "file", "line", F.coalesce("module", F.lit("")).alias("module"), "name", F.coalesce("asname", F.lit("")).alias("asname")),
    f"WITH {sql_files(('python',))}, {D.SQL_LINES}, parsed AS (SELECT *, regexp_extract(line, '^from (\\S+) import ', 1) AS src, "
    "string_split(regexp_replace(line, '^(from \\S+ )?import ', ''), ', ') AS names FROM lines WHERE regexp_matches(line, '^(from \\S+ )?import ')), "
    "one AS (SELECT project_id, path, n, src, unnest(names) AS item FROM parsed) "
    "SELECT project_id, path AS file, n AS line, CASE WHEN src = '.' THEN '' ELSE src END AS module, split_part(item, ' as ', 1) AS name, split_part(item, ' as ', 2) AS asname FROM one")
add("f_py_calls", lambda s, d: A.calls(A.syntax_facts(D.corpus(s, d, "python"), ["Call"], False, False)).groupBy("name").agg(F.count("*").alias("calls")))
add("j_desc", lambda s, d: A.descendants(A.syntax_facts(D.corpus(s, d, "python"), None, A.FUNCTION_TYPES, False, columns=A.OWNED), A.FUNCTION_TYPES).groupBy("owner_name", "node_type").agg(F.count("*").alias("nodes")))

_JS = ("javascript",)
_JS_HEAD = f"WITH {sql_files(_JS)}, {D.SQL_LINES}"


def _js(spark: SparkSession, sf: str) -> DataFrame:
    return D.text_files(spark, sf, "javascript")


def _first(patterns: list[str]) -> str:
    cases = " ".join(f"WHEN regexp_matches(line, {q(p)}) THEN regexp_extract(line, {q(p)}, 1)" for p in patterns)
    return f"CASE {cases} END"


_STRIPPED = "trim(line, chr(32) || chr(9))"
add("f_js_func", lambda s, d: js_facts.js_functions(_js(s, d)),
    f"{_JS_HEAD} SELECT * FROM (SELECT project_id, path AS file, n AS line, {_first(P.JS_FUNCTIONS)} AS name, {_STRIPPED} AS body FROM lines) WHERE name IS NOT NULL")
add("f_js_class", lambda s, d: js_facts.js_classes(_js(s, d)),
    f"{_JS_HEAD} SELECT * FROM (SELECT project_id, path AS file, n AS line, {_first([P.JS_CLASS])} AS name, {_STRIPPED} AS body FROM lines) WHERE name IS NOT NULL")
add("f_js_import", lambda s, d: js_facts.js_imports(_js(s, d)),
    f"{_JS_HEAD} SELECT project_id, path AS file, n AS line, {_STRIPPED} AS statement FROM lines WHERE regexp_matches(line, {q(P.JS_IMPORT)})")
add("f_js_call", lambda s, d: js_facts.js_calls(_js(s, d)),
    f"{_JS_HEAD}, named AS (SELECT project_id, path AS file, n AS line, unnest(regexp_extract_all(line, {q(P.JS_CALL)}, 1)) AS name FROM lines) "
    f"SELECT * FROM named WHERE name NOT IN ({', '.join(q(k) for k in P.JS_CALL_KEYWORDS)})")
add("f_js_var", lambda s, d: js_facts.js_variables(_js(s, d)),
    f"{_JS_HEAD} SELECT * FROM (SELECT project_id, path AS file, n AS line, {_first([P.JS_VARIABLE])} AS name FROM lines) WHERE name IS NOT NULL")

_FN = "WITH {0} SELECT project_id, file, line, split_part(message, '|', 1) AS name, CAST(split_part(message, '|', {1}) AS INTEGER) AS {2} FROM expected"
add("m_fn_js", lambda s, d: js_facts.js_function_metrics(D.corpus(s, d)).select("project_id", "file", "line", "name", "length"), _FN.format(D.sql_labels(["FN"]), 2, "length"))
add("m_cc_js", lambda s, d: js_facts.js_function_metrics(D.corpus(s, d)).select("project_id", "file", "line", "name", "complexity"), _FN.format(D.sql_labels(["FN"]), 3, "complexity"))



def _whole(part: int, name: str) -> str:
    """Bodies followed to their end: labels of their own where a body is longer than METRIC_LINES."""
    return (
        f"WITH {D.sql_labels(['FN', 'FNW'])} SELECT project_id, file, line, split_part(message, '|', 1) AS name, CAST(split_part(message, '|', {part}) AS INTEGER) AS {name} FROM expected e "
        "WHERE rule_id = 'FNW' OR NOT EXISTS (SELECT 1 FROM expected w WHERE w.rule_id = 'FNW' AND w.project_id = e.project_id AND w.file = e.file AND w.line = e.line)"
    )


add("m_fn_js_whole", lambda s, d: js_facts.js_function_metrics(D.corpus(s, d), None).select("project_id", "file", "line", "name", "length"), _whole(2, "length"))
add("m_cc_js_whole", lambda s, d: js_facts.js_function_metrics(D.corpus(s, d), None).select("project_id", "file", "line", "name", "complexity"), _whole(3, "complexity"))


def _cc_facts(spark: SparkSession, sf: str) -> DataFrame:
    return rule_facts(D.corpus(spark, sf, "python"), [FACT_RULES["CS003"]], A.FUNCTION_TYPES)


add("m_cc_py", lambda s, d: M.python_complexity(_cc_facts(s, d)), _FN.format(D.sql_labels(["PYFN"]), 3, "complexity"))
add("m_len_py", lambda s, d: M.python_lengths(A.syntax_facts(D.corpus(s, d, "python"), A.FUNCTION_TYPES, False, False)), _FN.format(D.sql_labels(["PYFN"]), 2, "length"))
add("a_avgcc", lambda s, d: M.average_complexity(M.python_complexity(_cc_facts(s, d))).unionByName(
        M.average_complexity(js_facts.js_function_metrics(D.corpus(s, d)))).select("project_id", "file", "value"),
    f"WITH {D.sql_labels(['PYFN', 'FN'])} SELECT project_id, file, round(avg(CAST(split_part(message, '|', 3) AS INTEGER)), 2) AS value FROM expected GROUP BY 1, 2")


def _loc_sql(language: str, marks: str) -> str:
    return (
        f"WITH {sql_files((language,))}, {D.SQL_LINES}, c AS (SELECT f.project_id, f.path AS file, count(n) AS total, count(*) FILTER (WHERE n IS NOT NULL AND regexp_matches(line, '^\\s*$')) AS blank, "
        f"count(*) FILTER (WHERE regexp_matches(line, '^\\s*({marks})')) AS comment FROM files f LEFT JOIN lines l ON f.project_id = l.project_id AND f.path = l.path GROUP BY 1, 2) "
        "SELECT project_id, file, unnest(['Total Lines', 'Code Lines', 'Comment Lines', 'Blank Lines']) AS metric_name, "
        "CAST(unnest([total, total - comment - blank, comment, blank]) AS DOUBLE) AS value FROM c"
    )


def _loc(language: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        files = D.text_files(spark, sf, language)
        if language == "python":
            files = files.filter(A.parses(F.col("text")))
        return M.tall_line_counts(M.line_counts(files, language)).select("project_id", "file", "metric_name", "value")

    return run


add("m_loc_py", _loc("python"), _loc_sql("python", "#"))
add("m_loc_js", _loc("javascript"), _loc_sql("javascript", "//|\\*|/\\*"))
_TOKENS = r"[a-zA-Z_][\pL\pN_]*|[^\s\pL\pN_]"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return D.documents(spark, sf).unionByName(D.turns(spark, sf))


_SQL_TEXTS = ("files AS (SELECT source AS project_id, 'doc' || doc_id AS path, text FROM documents UNION ALL "
              "SELECT 'conversations', 'c' || conv_id || '/' || turn, text FROM conversations)")
add("u_halstead", lambda s, d: _texts(s, d).select("project_id", F.col("path").alias("file"), F.round(T.token_volume(F.col("text")), 2).alias("volume")),
    f"WITH {_SQL_TEXTS}, t AS (SELECT project_id, path, regexp_extract_all(text, {q(_TOKENS)}) AS tokens FROM files) "
    "SELECT project_id, path AS file, round(greatest(1.0, len(tokens) * CASE WHEN len(tokens) = 0 THEN 0 ELSE log2(len(list_distinct(tokens))) END), 2) AS volume FROM t")
add("m_mi", lambda s, d: M.maintainability_metrics(
        D.corpus(s, d, "python"), A.syntax_facts(D.corpus(s, d, "python"), [*FACT_RULES["CS003"].node_types, "Module"], A.FUNCTION_TYPES, False)
    ).select("project_id", "file", "value"),
    f"WITH {D.sql_labels(['PYFN'])}, files AS (SELECT project_id, path, text FROM corpus WHERE language = 'python' AND template_id NOT IN ({', '.join(map(str, D.snippets.UNPARSABLE))})), {D.SQL_LINES}, "
    "cc AS (SELECT project_id, file, avg(CAST(split_part(message, '|', 3) AS INTEGER)) AS g FROM expected GROUP BY 1, 2), "
    "loc AS (SELECT project_id, path, count(*) FILTER (WHERE NOT regexp_matches(line, '^\\s*(#|$)')) AS loc FROM lines GROUP BY 1, 2), "
    f"vol AS (SELECT project_id, path, regexp_extract_all(text, {q(_TOKENS)}) AS t FROM files) "
    "SELECT v.project_id, v.path AS file, round(greatest(0.0, least(100.0, 171 - 5.2 * ln(greatest(1.0, len(t) * CASE WHEN len(t) = 0 THEN 0 ELSE log2(len(list_distinct(t))) END)) "
    "- 0.23 * coalesce(g, 1.0) - 16.2 * ln(greatest(coalesce(loc, 0), 1)))), 2) AS value FROM vol v LEFT JOIN loc USING (project_id, path) LEFT JOIN cc ON cc.project_id = v.project_id AND cc.file = v.path")

_WINDOWS = (
    "arr AS (SELECT project_id, path, list_transform(a, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS a FROM arrays), "
    "w0 AS (SELECT project_id, path, a, CAST(unnest(range(1, len(a) - 4)) AS INTEGER) AS s FROM arr WHERE len(a) >= 6), "
    "w AS (SELECT project_id, path, s, array_to_string(a[s:s+5], chr(10)) AS block FROM w0 WHERE len(list_filter(a[s:s+5], lambda x: x <> '' AND NOT starts_with(x, '#'))) >= 3), "
    "dup AS (SELECT project_id, block, count(*) AS occurrences, min({'p': path, 's': s}) AS first FROM w GROUP BY 1, 2 HAVING count(*) > 1)"
)
add("m_dup", lambda s, d: clones.clone_report(_texts(s, d)),
    f"WITH {_SQL_TEXTS}, {D.SQL_LINES}, {_WINDOWS} SELECT project_id, substr(block, 1, 200) AS block_preview, occurrences, first.p AS first_file, first.s AS first_line FROM dup")
add("m_dup_locations", lambda s, d: clones.clone_locations(_texts(s, d)).drop("digest"),
    f"WITH {_SQL_TEXTS}, {D.SQL_LINES}, {_WINDOWS} SELECT w.project_id, occurrences, w.path AS file, s AS start_line, s + 5 AS end_line FROM w JOIN dup USING (project_id, block)")
add("u_preview", lambda s, d: clones.clone_report(_texts(s, d), laid_out=lay_out(_texts(s, d))).select("project_id", "first_file", "first_line", F.length("block_preview").alias("chars")),
    f"WITH {_SQL_TEXTS}, {D.SQL_LINES}, {_WINDOWS} SELECT project_id, first.p AS first_file, first.s AS first_line, CAST(least(200, length(block)) AS INTEGER) AS chars FROM dup")

# -- sources ----------------------------------------------------------------------------------------------------

_TREE = (
    "tree AS (SELECT 'p' || l_suppkey AS project_id, "
    + D._case("l_partkey % 10", ["src", "node_modules/x", ".git", "build", "pkg.egg-info", "lib/.hidden/y", "venv", "Build", "src/env2", "docs"])
    + " || '/' || l_orderkey || '/' || " + D._case("l_orderkey % 9", ["a.py", "b.PY", "c.tsx", "d.min.js", "e.cs", "f.sql", "g.md", ".py", "h.py.bak"])
    + " AS path, CAST(floor(l_extendedprice * 10) AS BIGINT) AS size_bytes FROM lineitem)"
)
_SKIP = "(^|/)(\\.[^/]*|__pycache__|node_modules|venv|env|dist|build|[^/]*\\.egg-info)/"
add("s_discover", lambda s, d: D.tree_paths(s, d).filter(S.is_source_path(F.col("path")) & S.within_size(F.col("size_bytes"))),
    f"WITH {_TREE} SELECT * FROM tree WHERE size_bytes <= 512000 AND NOT regexp_matches(path, '{_SKIP}') AND regexp_matches(path, '[^/]\\.(py|js|jsx|ts|tsx|sql|cs)$')")
_LANG = ("CASE WHEN regexp_matches({0}, '[^/]\\.py$') THEN 'python' WHEN regexp_matches({0}, '[^/]\\.(js|jsx|ts|tsx)$') THEN 'javascript' "
         "WHEN regexp_matches({0}, '[^/]\\.sql$') THEN 'sql' WHEN regexp_matches({0}, '[^/]\\.cs$') THEN 'csharp' ELSE 'unknown' END")
add("s_lang", lambda s, d: D.tree_paths(s, d).groupBy(S.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files")),
    f"WITH {_TREE} SELECT {_LANG.format('path')} AS language, count(*) AS files FROM tree GROUP BY 1")
add("s_projlang", lambda s, d: S.project_languages(D.tree_paths(s, d)),
    f"WITH {_TREE}, c AS (SELECT project_id, count(*) FILTER (WHERE regexp_matches(path, '(?i)[^/]\\.py$')) AS py, count(*) FILTER (WHERE regexp_matches(path, '(?i)[^/]\\.(js|jsx|ts|tsx)$')) AS js "
    "FROM tree WHERE NOT regexp_matches(path, '(^|/)(node_modules|__pycache__|\\.git|venv|\\.venv)/') GROUP BY 1) "
    "SELECT project_id, CASE WHEN py > 0 AND js > 0 THEN 'mixed' WHEN js > 0 THEN 'javascript' ELSE 'python' END AS language FROM c")
add("s_decode", lambda s, d: D.documents(s, d).select(
        "project_id", "path", S.decode(F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF61C3")))).alias("decoded")).select("project_id", "path", F.md5("decoded").alias("digest"), F.length("decoded").alias("chars")),
    "SELECT source AS project_id, 'doc' || doc_id AS path, md5(text || 'a') AS digest, CAST(length(text) + 1 AS INTEGER) AS chars FROM documents")
add("s_lines", lambda s, d: S.explode_lines(_texts(s, d)).select("project_id", "path", "line_no", "line"),
    f"WITH {_SQL_TEXTS}, {D.SQL_LINES} SELECT project_id, path, n AS line_no, line FROM lines")
add("s_req", lambda s, d: MF.requirements(D.manifests(s, d)).select("project_id", "ord", "name", "version"),
    f"WITH {D.SQL_MANIFESTS}, l AS (SELECT project_id, string_split(text, chr(10)) AS a FROM manifests WHERE manifest = 'requirements.txt' AND text <> ''), "
    "r AS (SELECT project_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS ord, trim(unnest(a)) AS x FROM l) "
    "SELECT project_id, ord, regexp_extract(x, '^([a-zA-Z0-9_.-]+)', 1) AS name, regexp_extract(x, '^[a-zA-Z0-9_.-]+\\s*[=~><]+\\s*([0-9][^\\s;#]*)', 1) AS version FROM r "
    "WHERE x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '-')")
_NPM = (
    f"WITH {D.SQL_MANIFESTS}, j AS (SELECT project_id, CAST(text AS JSON) AS j FROM manifests WHERE manifest = 'package.json' AND json_valid(text)), "
    "e AS (SELECT project_id, unnest(json_keys(j, '$.dependencies')) AS name, 0 AS ord, j->'$.dependencies' AS m FROM j UNION ALL "
    "SELECT project_id, unnest(json_keys(j, '$.devDependencies')), 1, j->'$.devDependencies' FROM j), "
    "npm AS (SELECT project_id, ord, name, regexp_replace(json_extract_string(m, '$.\"' || name || '\"'), '^[^0-9]*', '') AS version FROM e) "
)
add("s_pkgjson", lambda s, d: MF.package_json(D.manifests(s, d)).select("project_id", "ord", "name", "version"), _NPM + "SELECT project_id, ord, name, version FROM npm")
add("u_version", lambda s, d: MF.package_json(D.manifests(s, d)).groupBy("version").agg(F.count("*").alias("n")), _NPM + "SELECT version, count(*) AS n FROM npm GROUP BY 1")


def _stored_advisories(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark, "advisories")
    D.advisories(spark, sf).write.json(path)
    return MF.read_advisories(spark, path, "json")


def _fresh(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


add("s_advisory", lambda s, d: _stored_advisories(s, d).select("ecosystem", "package", "version", "vuln_id", "summary", "details", F.size("refs").alias("n_refs"),
                                                            F.array_join("refs", " ").alias("refs"), F.when(F.col("ranges").isNull(), 0).otherwise(F.size("ranges")).alias("n_ranges")),
    f"WITH {D.SQL_ADVISORIES} SELECT ecosystem, package, version, vuln_id, summary, details, n_refs, "
    "array_to_string(list_transform(range(1, n_refs + 1), lambda i: 'https://a/' || i), ' ') AS refs, CAST([0, 1, 3, 2][kind + 1] AS INTEGER) AS n_ranges FROM advisories")


def _imports(spark: SparkSession, sf: str) -> DataFrame:
    files = D.corpus(spark, sf, "python").filter(T.may_name(F.col("text"), ["import"]))
    return A.imports(A.syntax_facts(files, ["Import", "ImportFrom"], False))


_SQL_ROOTS = (
    f"{sql_files(('python',))}, {D.SQL_LINES}, imp AS (SELECT project_id, CASE WHEN regexp_matches(line, '^from ') THEN regexp_extract(line, '^from ([^.\\s]*)', 1) END AS src, "
    "string_split(regexp_replace(line, '^import ', ''), ', ') AS names FROM lines WHERE regexp_matches(line, '^(from \\S+ )?import ')), "
    "roots AS (SELECT DISTINCT project_id, module FROM (SELECT project_id, src AS module FROM imp WHERE src IS NOT NULL UNION ALL "
    "SELECT project_id, regexp_extract(x, '^[^. ]+') FROM (SELECT project_id, unnest(names) AS x FROM imp WHERE src IS NULL)) WHERE module <> '')"
)
add("s_imports", lambda s, d: deps.import_roots(_imports(s, d)), f"WITH {_SQL_ROOTS} SELECT * FROM roots")
add("u_distinct", lambda s, d: deps.import_roots(_imports(s, d)).groupBy("module").agg(F.count("*").alias("projects")),
    f"WITH {_SQL_ROOTS} SELECT module, count(*) AS projects FROM roots GROUP BY 1")


def _catalog_use(spark: SparkSession, sf: str) -> DataFrame:
    used = D.issues(spark, sf).groupBy("rule_id").agg(F.count("*").alias("issues"))
    return rules_summary(rule_catalog(spark)).join(used, "rule_id", "left").select("rule_id", "name", "severity", "category", "languages", F.coalesce("issues", F.lit(0)).alias("issues"))


def _catalog_values() -> str:
    from siftmill.operators.catalog import RULES

    rows = ", ".join(f"({q(r[0])}, {q(r[1])}, {q(r[2] or '')}, {q(r[3])}, {q(', '.join(r[5]))})" for r in RULES)
    return f"catalog(rule_id, name, severity, category, languages) AS (VALUES {rows})"


add("s_catalog", _catalog_use,
    f"WITH {_catalog_values()}, {D.SQL_ISSUES} SELECT c.*, count(i.issue_id) AS issues FROM catalog c LEFT JOIN issues i ON i.rule_id = c.rule_id GROUP BY ALL")

# -- dependencies -----------------------------------------------------------------------------------------------


def _standard() -> str:
    import sys

    return "stdlib AS (SELECT unnest([" + ", ".join(q(m) for m in sorted(sys.stdlib_module_names)) + "]) AS module)"


_SQL_DECLARED = (
    f"{D.SQL_MANIFESTS}, dl AS (SELECT project_id, string_split(text, chr(10)) AS a FROM manifests WHERE manifest = 'requirements.txt' AND text <> ''), "
    "dr AS (SELECT project_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS ord, trim(unnest(a)) AS x FROM dl), "
    "declared AS (SELECT project_id, ord, regexp_extract(x, '^([a-zA-Z0-9_.-]+)', 1) AS name, regexp_extract(x, '^[a-zA-Z0-9_.-]+\\s*[=~><]+\\s*([0-9][^\\s;#]*)', 1) AS version FROM dr "
    "WHERE x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '-')), "
    "names AS (SELECT DISTINCT project_id, ord, name, version, unnest(CASE lower(name) WHEN 'pyyaml' THEN ['yaml'] WHEN 'opencv-python' THEN ['cv2'] WHEN 'numpy' THEN ['numpy', 'np'] "
    "ELSE [lower(name), replace(lower(name), '-', '_')] END) AS module FROM declared)"
)
_SQL_THIRD = f"{_SQL_ROOTS}, {_standard()}, third AS (SELECT * FROM roots WHERE module NOT IN (SELECT module FROM stdlib))"


def _third(spark: SparkSession, sf: str) -> DataFrame:
    return deps.third_party(deps.import_roots(_imports(spark, sf)), deps.standard_modules(spark))


_DEP2 = "project_id, 'requirements.txt' AS file, {n} AS package, {v} AS version, {id} AS rule_id, {sev} AS severity, {text} AS summary"
_DEP_COLS = ["project_id", "file", "package", "version", "rule_id", "severity", "summary"]
_UNUSED = ("SELECT " + _DEP2.format(n="name", v="version", id="'DEP002'", sev="'MINOR'", text="'''' || name || ''' is declared in requirements.txt but never imported in any .py file.'")
           + " FROM declared d WHERE NOT EXISTS (SELECT 1 FROM names n JOIN third t ON t.project_id = n.project_id AND t.module = n.module WHERE n.project_id = d.project_id AND n.ord = d.ord)")
_UNDECLARED = ("SELECT " + _DEP2.format(n="module", v="''", id="'DEP003'", sev="'MAJOR'", text="'''' || module || ''' is imported in source code but not declared in requirements.txt.'")
               + " FROM third t WHERE project_id IN (SELECT project_id FROM declared) AND NOT EXISTS (SELECT 1 FROM names n WHERE n.project_id = t.project_id AND n.module = t.module)")
_SEVEST = ("CASE WHEN regexp_matches(lower(details), 'critical|remote code execution|rce') THEN 'CRITICAL' WHEN regexp_matches(lower(details), 'high|injection|overflow') THEN 'MAJOR' "
           "WHEN regexp_matches(lower(details), 'medium|moderate|xss') THEN 'MINOR' ELSE 'INFO' END")
_SQL_ALL_DECLARED = (
    _SQL_DECLARED + ", " + _NPM[len(f"WITH {D.SQL_MANIFESTS}, "):].rstrip()
    + ", every AS (SELECT project_id, 'requirements.txt' AS file, 'PyPI' AS ecosystem, name, version FROM declared UNION ALL SELECT project_id, 'package.json', 'npm', name, version FROM npm)"
)
_RELEASE = "list_transform(string_split(regexp_replace(regexp_extract(e.version, '^[0-9]+(\\.[0-9]+)*'), '(\\.0+)+$', ''), '.'), lambda x: TRY_CAST(x AS INTEGER))"
#: The ranges of the derived advisories, spelled out over release numbers without trailing zeros.
_IN_RANGE = (
    f"CASE a.kind WHEN 1 THEN {_RELEASE} >= [p_size] AND {_RELEASE} < [p_size + 2] WHEN 2 THEN {_RELEASE} < [2] OR {_RELEASE} = [p_size] "
    f"WHEN 3 THEN {_RELEASE} >= [49, 5] OR ({_RELEASE} > [p_size] AND {_RELEASE} < [p_size + 1, 1]) ELSE false END"
)
_VULNERABLE = (f"SELECT e.project_id, e.file, e.name AS package, e.version, 'DEP001' AS rule_id, {_SEVEST} AS severity, coalesce(summary, 'No summary available') AS summary{{more}} "
               f"FROM every e JOIN advisories a ON a.ecosystem = e.ecosystem AND a.package = e.name AND (a.version = e.version OR {_IN_RANGE}) WHERE e.version <> ''")
add("j_declnames", lambda s, d: deps.declared_names(MF.declared(D.manifests(s, d))), f"WITH {_SQL_DECLARED} SELECT project_id, ord, name, version, module FROM names")
add("j_stdlib", _third, f"WITH {_SQL_THIRD} SELECT * FROM third")
add("j_unused", lambda s, d: deps.unused(MF.declared(D.manifests(s, d)), _third(s, d)).select(*_DEP_COLS), f"WITH {_SQL_DECLARED}, {_SQL_THIRD} {_UNUSED}")
add("j_undeclared", lambda s, d: deps.undeclared(MF.declared(D.manifests(s, d)), _third(s, d)).select(*_DEP_COLS), f"WITH {_SQL_DECLARED}, {_SQL_THIRD} {_UNDECLARED}")
add("j_undeclared_own", lambda s, d: deps.undeclared(MF.declared(D.manifests(s, d)), deps.third_party(
        deps.import_roots(_imports(s, d), relative=False), deps.standard_modules(s), deps.local_modules(D.corpus(s, d, "python")))).select(*_DEP_COLS),
    f"WITH {_SQL_DECLARED}, {_SQL_THIRD.replace('third AS (', 'every_third AS (')}, own AS (SELECT DISTINCT project_id, regexp_extract(path, '^(src/)?([^/]+?)([.]py)?(/|$)', 2) AS module FROM files), "
    f"third AS (SELECT * FROM every_third t WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.project_id = t.project_id AND o.module = t.module)) {_UNDECLARED}")
add("j_vuln", lambda s, d: deps.vulnerable(MF.declared(D.manifests(s, d)), D.advisories(s, d)).select(*_DEP_COLS, "vuln_id", F.size("refs").alias("n_refs")),
    f"WITH {_SQL_ALL_DECLARED}, {D.SQL_ADVISORIES} " + _VULNERABLE.format(more=", vuln_id, n_refs"))
add("u_deps", lambda s, d: deps.dependency_findings(MF.declared(D.manifests(s, d)), _third(s, d), D.advisories(s, d)).select(*_DEP_COLS),
    f"WITH {_SQL_ALL_DECLARED}, {_SQL_THIRD}, {D.SQL_ADVISORIES} {_VULNERABLE.format(more='')} UNION ALL {_UNUSED} UNION ALL {_UNDECLARED}")
add("u_sevest", lambda s, d: D.advisories(s, d).select("vuln_id", deps.advisory_severity(F.col("details")).alias("severity")),
    f"WITH {D.SQL_ADVISORIES} SELECT vuln_id, {_SEVEST} AS severity FROM advisories")

# -- findings: filters, lists, pages ----------------------------------------------------------------------------

_I = f"WITH {D.SQL_ISSUES} "
_ROW = ["issue_id", "project_id", "file", "line", "rule_id", "severity", "category"]
_COLS = ", ".join(_ROW)


def _issues(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: step(D.issues(s, d)).select(*_ROW)


for _name, _step, _where in [
    ("q_proj", lambda x: W.of_project(x, "p7"), "project_id = 'p7'"),
    ("q_sev", lambda x: W.of_severity(x, "critical"), "severity = 'CRITICAL'"),
    ("q_cat", lambda x: W.of_category(x, "code_smell"), "category = 'CODE_SMELL'"),
    ("q_file", lambda x: W.file_contains(x, "SRC/M1_"), "file ILIKE '%SRC/M1_%'"),
    ("q_rule", lambda x: W.of_rule(x, "JSEC001"), "rule_id = 'JSEC001'"),
    ("q_langf", lambda x: W.of_language(x, "JavaScript"), "regexp_matches(lower(file), '\\.(js|ts|jsx|tsx)$')"),
    ("q_notsev", lambda x: W.not_of_severity(x, "info"), "severity <> 'INFO'"),
]:
    add(_name, _issues(_step), f"{_I}SELECT {_COLS} FROM issues WHERE {_where}")

_ORDER = "ORDER BY severity DESC, ts DESC, issue_id"
add("q_page", lambda s, d: W.indexed_page(s, W.rank_index(W.select_issues(D.issues(s, d), exclude_severity="minor", language="python")), 3, 200).select(*_ROW),
    f"{_I}SELECT {_COLS} FROM issues WHERE severity <> 'MINOR' AND file LIKE '%.py' {_ORDER} LIMIT 200 OFFSET 400")
add("q_page_total", lambda s, d: W.issue_total(W.select_issues(D.issues(s, d), exclude_severity="minor", language="python")),
    f"{_I}SELECT count(*) AS total FROM issues WHERE severity <> 'MINOR' AND file LIKE '%.py'")
add("q_page_ranked", lambda s, d: W.ranked(D.issues(s, d)).select("issue_id", F.col("position").cast("bigint")),
    f"{_I}SELECT issue_id, row_number() OVER ({_ORDER}) - 1 AS position FROM issues")
_MET = ["project_id", "file", "metric_type", "metric_name", "value", "details"]
add("q_metrics", lambda s, d: R.metrics_newest_first(W.file_contains(D.metrics(s, d), ".PY")).select(*_MET),
    f"WITH {D.SQL_METRICS} SELECT {', '.join(_MET)} FROM metrics WHERE file ILIKE '%.py%'")
add("q_deps", lambda s, d: W.by_severity_text(W.dependency_issues(D.issues(s, d))).drop("ts"),
    f"{_I}SELECT project_id, issue_id, file, rule_id, severity, message, suggestion, owasp_category FROM issues WHERE category = 'DEPENDENCY'")
add("q_scans", lambda s, d: R.scan_history(D.scans(s, d)).select("project_id", "scan_id", "status", "total_issues"),
    f"WITH {D.SQL_SCANS} SELECT project_id, scan_id, status, total_issues FROM scans")
add("q_projects", lambda s, d: R.projects_newest_first(D.projects(s, d)).select("project_id", "name", "path", "language"),
    f"WITH {D.SQL_PROJECTS} SELECT project_id, name, path, language FROM projects")
add("t_sevtext", lambda s, d: W.by_severity_text(D.issues(s, d)).select(*_ROW), f"{_I}SELECT {_COLS} FROM issues")

_EVERY = ", ".join([D.sql_corpus(None), "files AS (SELECT project_id, path, text FROM corpus UNION ALL " + " UNION ALL ".join(D.sql_prose(x) for x in ("javascript", "sql", "csharp")) + ")"])

# -- reports ----------------------------------------------------------------------------------------------------

_P, _S = f"WITH {D.SQL_PROJECTS} ", f"WITH {D.SQL_SCANS} "
add("a_overview", lambda s, d: R.overview(D.projects(s, d), D.scans(s, d), D.issues(s, d)),
    f"WITH {D.SQL_PROJECTS}, {D.SQL_SCANS}, {D.SQL_ISSUES} SELECT (SELECT count(*) FROM projects) AS total_projects, (SELECT count(*) FROM scans WHERE status = 'completed') AS total_scans, (SELECT count(*) FROM issues) AS total_issues")
for _name, _col in [("a_sev", "severity"), ("a_cat", "category"), ("a_owasp", "owasp_category")]:
    add(_name, lambda s, d, c=_col: R.distribution(D.issues(s, d), c, ["project_id"]),
        f"{_I}SELECT project_id, {_col}, count(*) AS count FROM issues WHERE {_col} IS NOT NULL GROUP BY 1, 2")
_PIVOT = ", ".join(f"count(*) FILTER (WHERE category <> 'DEPENDENCY' AND severity = '{x}') AS {x.lower()}_count" for x in D.SEVERITIES)
add("a_sevpivot", lambda s, d: R.scan_severities(D.issues(s, d)), f"{_I}SELECT project_id, scan_id, count(*) AS total_issues, {_PIVOT} FROM issues GROUP BY 1, 2")
add("a_langbreak", lambda s, d: R.language_breakdown(D.issues(s, d), ["project_id"]), f"{_I}SELECT project_id, {_LANG.format('file')} AS language, count(*) AS issues FROM issues GROUP BY 1, 2")
add("a_langfiles", lambda s, d: R.language_files(_every_file(s, d), ["project_id"]),
    f"WITH {_EVERY} SELECT project_id, {_LANG.format('path')} AS language, count(*) AS files FROM files GROUP BY 1, 2")
add("a_weight", lambda s, d: R.severity_score(D.issues(s, d), ["project_id", "file"]).select("project_id", "file", *long("score")),
    f"{_I}SELECT project_id, file, CAST(sum(CASE severity WHEN 'INFO' THEN 1 WHEN 'MINOR' THEN 2 WHEN 'MAJOR' THEN 5 WHEN 'CRITICAL' THEN 10 ELSE 20 END) AS BIGINT) AS score FROM issues GROUP BY 1, 2")


def _rule_case(rule_id: str) -> str:
    return line_sql(LINE_RULES[rule_id]).split("FROM (SELECT *, ", 1)[1].split(" AS message FROM lines", 1)[0]


_MAGIC_OK = "NOT contains(line, 'const') AND NOT contains(line, 'PORT') AND NOT regexp_matches(line, '^\\s*(//|\\*)')"
def _flat(column: str, key: str) -> F.Column:
    """An array of (key, count) structs as text, so that both engines compare one value."""
    return F.coalesce(F.array_join(F.transform(column, lambda x: F.concat_ws("=", x[key], x["count"].cast("string"))), ";"), F.lit("")).alias(column)


def _summary_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.project_summaries(D.projects(spark, sf), D.issues(spark, sf), D.scans(spark, sf))
    return rows.select("project_id", F.col("project.name").alias("name"), F.col("latest_scan.total_issues").alias("last_total"),
                       _flat("severity_distribution", "severity"), _flat("category_distribution", "category"),
                       _flat("owasp_distribution", "owasp_category"), _flat("top_files", "file"))


def _dist_sql(alias: str, column: str) -> str:
    return f"{alias} AS (SELECT project_id, string_agg(v || '=' || c, ';' ORDER BY v) AS x FROM (SELECT project_id, {column} AS v, count(*) AS c FROM issues WHERE {column} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"


_DISTS = ", ".join(_dist_sql(a, c) for a, c in [("ds", "severity"), ("dc", "category"), ("dw", "owasp_category")])
_LATEST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, scan_id DESC) AS r FROM scans) WHERE r = 1)"
add("a_summary", _summary_text,
    f"WITH {D.SQL_PROJECTS}, {D.SQL_SCANS}, {D.SQL_ISSUES}, {_DISTS}, {_LATEST}, tf AS (SELECT project_id, string_agg(file || '=' || c, ';' ORDER BY r) AS x FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY c DESC, file) AS r "
    "FROM (SELECT project_id, file, count(*) AS c FROM issues GROUP BY 1, 2)) WHERE r <= 10 GROUP BY 1) "
    "SELECT p.project_id, p.name, last.total_issues AS last_total, coalesce(ds.x, '') AS severity_distribution, coalesce(dc.x, '') AS category_distribution, coalesce(dw.x, '') AS owasp_distribution, coalesce(tf.x, '') AS top_files "
    "FROM projects p LEFT JOIN last ON last.project_id = p.project_id LEFT JOIN ds ON ds.project_id = p.project_id LEFT JOIN dc ON dc.project_id = p.project_id LEFT JOIN dw ON dw.project_id = p.project_id LEFT JOIN tf ON tf.project_id = p.project_id")


def _dash_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.project_dashboards(D.projects(spark, sf), D.issues(spark, sf), D.scans(spark, sf), D.metrics(spark, sf))
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ";"), F.lit("")).alias(c)
    return rows.select("project_id", F.col("project.language").alias("language"), _flat("severity_distribution", "severity"), _flat("top_rules", "rule_id"),
                       joined("scan_history", lambda x: x["scan_id"]), joined("complexity_hotspots", lambda x: F.concat_ws("=", x["file"], x["value"].cast("int").cast("string"))))


_TOP_SCANS = "hs AS (SELECT project_id, scan_id, r FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, scan_id) AS r FROM scans) WHERE r <= 20)"
add("a_dash", _dash_text,
    f"WITH {D.SQL_PROJECTS}, {D.SQL_SCANS}, {D.SQL_ISSUES}, {D.SQL_METRICS}, {_DISTS}, {_TOP_SCANS}, sh AS (SELECT project_id, string_agg(scan_id, ';' ORDER BY r) AS x FROM hs GROUP BY 1), "
    "tr AS (SELECT project_id, string_agg(rule_id || '=' || c, ';' ORDER BY c DESC, rule_id) AS x FROM (SELECT project_id, rule_id, count(*) AS c FROM issues GROUP BY 1, 2) GROUP BY 1), "
    "hot AS (SELECT project_id, string_agg(file || '=' || CAST(value AS INTEGER), ';' ORDER BY r) AS x FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY value DESC, file, metric_name) AS r FROM metrics WHERE metric_type = 'cyclomatic_complexity') WHERE r <= 20 GROUP BY 1) "
    "SELECT p.project_id, coalesce(p.language, 'unknown') AS language, coalesce(ds.x, '') AS severity_distribution, coalesce(tr.x, '') AS top_rules, coalesce(sh.x, '') AS scan_history, coalesce(hot.x, '') AS complexity_hotspots "
    "FROM projects p LEFT JOIN ds ON ds.project_id = p.project_id LEFT JOIN tr ON tr.project_id = p.project_id LEFT JOIN sh ON sh.project_id = p.project_id LEFT JOIN hot ON hot.project_id = p.project_id")
add("j_latest", lambda s, d: R.projects_with_latest_scan(D.projects(s, d), D.scans(s, d)).select("project_id", "name", "scan_id", "status", "total_issues"),
    f"WITH {D.SQL_PROJECTS}, {D.SQL_SCANS}, {_LATEST} SELECT p.project_id, p.name, scan_id, status, total_issues FROM projects p LEFT JOIN last ON last.project_id = p.project_id")
add("j_meta", lambda s, d: with_metadata(D.issues(s, d).select("issue_id", "rule_id"), rule_catalog(s)).select("issue_id", "rule_id", "rule_name", F.coalesce("severity", F.lit("")).alias("severity"), "category"),
    f"WITH {_catalog_values()}, {D.SQL_ISSUES} SELECT issue_id, c.rule_id, c.name AS rule_name, c.severity, c.category FROM issues i JOIN catalog c ON c.rule_id = i.rule_id")
add("j_langrule", lambda s, d: D.issues(s, d).withColumn("language", S.language_of(F.col("file"))).join(F.broadcast(rule_runs(rule_catalog(s))), ["rule_id", "language"], "left_semi").select("issue_id", "rule_id", "language"),
    f"WITH {_catalog_values()}, {D.SQL_ISSUES}, x AS (SELECT issue_id, rule_id, {_LANG.format('file')} AS language FROM issues) SELECT x.* FROM x JOIN catalog c ON c.rule_id = x.rule_id WHERE list_contains(string_split(c.languages, ', '), x.language)")
add("t_files", lambda s, d: R.top_files(D.issues(s, d)), f"{_I}SELECT file, count(*) AS issue_count FROM issues GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("t_rules", lambda s, d: R.top_rules(D.issues(s, d)), f"{_I}SELECT rule_id, rule_name, count(*) AS count FROM issues GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
add("t_hot", lambda s, d: R.hotspots(D.metrics(s, d)), f"WITH {D.SQL_METRICS} SELECT project_id, file, metric_name, value FROM metrics WHERE metric_type = 'cyclomatic_complexity' ORDER BY value DESC, project_id, file, metric_name LIMIT 20")
add("t_scans10", lambda s, d: R.recent_scans(D.scans(s, d)).select("scan_id", "project_id", "status"), f"{_S}SELECT scan_id, project_id, status FROM scans ORDER BY started_at DESC, scan_id LIMIT 10")
add("t_scans20", lambda s, d: R.project_scan_history(D.scans(s, d)).select("project_id", "scan_id", *long("place")), f"WITH {D.SQL_SCANS}, {_TOP_SCANS} SELECT project_id, scan_id, r AS place FROM hs")
add("t_dist", lambda s, d: R.chart_distribution(D.issues(s, d), "category"), f"{_I}SELECT replace(category, '_', ' ') AS name, count(*) AS value FROM issues GROUP BY 1")

# -- unions, sinks ----------------------------------------------------------------------------------------------


def _every_file(spark: SparkSession, sf: str, stream: bool = False) -> DataFrame:
    """The code corpus, and documents and pages read as JavaScript, SQL and C#."""
    files = D.corpus(spark, sf, stream=stream)
    for language in ("javascript", "sql", "csharp"):
        files = files.unionByName(D.prose(spark, sf, language, stream))
    return files


def _whole_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All kinds of findings from one scan of all files, manifests and advisories."""
    result = SC.scan(_every_file(spark, sf), D.manifests(spark, sf), D.advisories(spark, sf))
    return result.issues.select("project_id", "file", "line", "rule_id", "severity", "message")


def _single_kinds_sql() -> list[str]:
    kinds = [*LINE_RULES, *FILE_RULES, *FACT_RULES, "TAINT001"]
    return [f"SELECT project_id, file, CAST(line AS INTEGER) AS line, {q(r)} AS rule_id, message FROM ({ORACLE[r.lower()]})" for r in kinds]


def _whole_scan_sql() -> str:
    single = _single_kinds_sql()
    severities = f"WITH {_catalog_values()} "
    return (
        f"{severities}SELECT project_id, file, CAST(line AS INTEGER) AS line, f.rule_id, c.severity, message FROM ({' UNION ALL '.join(single)}) f JOIN catalog c ON c.rule_id = f.rule_id "
        f"UNION ALL SELECT project_id, file, 0, rule_id, severity, package || ': ' || summary FROM ({ORACLE['u_deps']})"
    )


add("u_all", _whole_scan, _whole_scan_sql())


def _scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a scan of everything, from its rollups."""
    return SC.summary(SC.scan(_every_file(spark, sf), D.manifests(spark, sf), D.advisories(spark, sf)))


_COUNTED = ", ".join(f"count(*) FILTER (WHERE rule_id NOT LIKE 'DEP%' AND severity = '{x}') AS {x.lower()}" for x in D.SEVERITIES)
_LEVELS = ", ".join(f"coalesce({x.lower()}, 0) AS {x.lower()}" for x in D.SEVERITIES)
add("a_scansum", _scan_summary,
    f"WITH {D.SQL_MANIFESTS}, {_EVERY}, {D.SQL_LINES}, {_WINDOWS}, found AS ({_whole_scan_sql()}), "
    "named AS (SELECT project_id FROM files UNION SELECT project_id FROM manifests), f AS (SELECT project_id, count(*) AS files_scanned FROM files GROUP BY 1), "
    "l AS (SELECT project_id, count(*) AS lines_scanned FROM lines GROUP BY 1), b AS (SELECT project_id, count(*) AS duplicated_blocks FROM dup GROUP BY 1), "
    f"i AS (SELECT project_id, count(*) FILTER (WHERE rule_id NOT LIKE 'DEP%') AS total_issues, count(*) FILTER (WHERE rule_id LIKE 'DEP%') AS dependency_vulnerabilities, {_COUNTED} FROM found GROUP BY 1) "
    "SELECT project_id, coalesce(files_scanned, 0) AS files_scanned, coalesce(lines_scanned, 0) AS lines_scanned, coalesce(total_issues, 0) AS total_issues, "
    f"coalesce(dependency_vulnerabilities, 0) AS dependency_vulnerabilities, coalesce(duplicated_blocks, 0) AS duplicated_blocks, {_LEVELS} "
    "FROM named LEFT JOIN f USING (project_id) LEFT JOIN l USING (project_id) LEFT JOIN b USING (project_id) LEFT JOIN i USING (project_id)")


def _stored(name: str, rows: Callable[[SparkSession, str], DataFrame], columns: list[str]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = _fresh(spark, name)
        W.write_table(rows(spark, sf), path)
        return W.read_table(spark, path).select(*columns)

    return run


add("k_issues", _stored("issues", D.issues, _ROW), f"{_I}SELECT {_COLS} FROM issues")
add("k_metrics", _stored("metrics", D.metrics, _MET), f"WITH {D.SQL_METRICS} SELECT {', '.join(_MET)} FROM metrics")
_SCAN = ["scan_id", "project_id", "status", "total_issues", "blocker_count", "critical_count", "files_scanned"]


def _scan_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs in one folder: one that ends, one that fails, and one that fails where an earlier run had ended."""
    target = _fresh(spark, "scans")
    files = D.scans(spark, sf).select("project_id", F.lit(None).cast("string").alias("text"))
    none = D.issues(spark, sf).filter(F.lit(False)).select("project_id")
    result = SC.Scan(files, D.issues(spark, sf), D.metrics(spark, sf).drop("ts"), none, none)

    def fails() -> SC.Scan:
        raise ValueError("no such corpus")

    for scan_id, work in (("scan-1", lambda: result), ("scan-2", fails), ("scan-3", lambda: result), ("scan-3", fails)):
        try:
            SC.run(spark, target, scan_id, work)
        except ValueError:
            pass
    rows = SC.scans_with_states(spark, target)
    return rows.select("scan_id", F.coalesce("project_id", F.lit("")).alias("project_id"), "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in _SCAN[3:]])


add("k_scan", _scan_runs,
    f"WITH {D.SQL_SCANS}, {D.SQL_ISSUES}, i AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE category <> 'DEPENDENCY' AND severity = 'BLOCKER') AS b, count(*) FILTER (WHERE category <> 'DEPENDENCY' AND severity = 'CRITICAL') AS c FROM issues GROUP BY 1) "
    "SELECT s.id AS scan_id, f.project_id, 'completed' AS status, coalesce(n, 0) AS total_issues, coalesce(b, 0) AS blocker_count, coalesce(c, 0) AS critical_count, files_scanned "
    "FROM (SELECT project_id, count(*) AS files_scanned FROM scans GROUP BY 1) f LEFT JOIN i USING (project_id), (VALUES ('scan-1'), ('scan-3')) s(id) "
    "UNION ALL SELECT id, '', 'failed', 0, 0, 0, 0 FROM (VALUES ('scan-2'), ('scan-3')) t(id)")


def _global_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    issues = D.issues(spark, sf)
    files = issues.groupBy("project_id", "file").agg(F.count(F.lit(1)).alias("issues"))
    rows = R.global_dashboard(D.projects(spark, sf), D.scans(spark, sf), R.rollup(issues), files)
    return rows.select(
        F.col("overview.total_projects").alias("total_projects"),
        F.col("overview.total_scans").alias("total_scans"), F.col("overview.total_issues").alias("total_issues"),
        _flat("severity_distribution", "severity"), _flat("category_distribution", "category"), _flat("owasp_distribution", "owasp_category"),
        F.array_join(F.transform("recent_scans", lambda x: F.concat_ws("=", x["id"], x["status"], x["total_issues"].cast("string"))), ";").alias("recent_scans"),
        F.array_join(F.transform("top_files_by_issues", lambda x: F.concat_ws("=", x["file"], x["issue_count"].cast("string"))), ";").alias("top_files"))


def _all_dist(column: str) -> str:
    return f"(SELECT string_agg(v || '=' || c, ';' ORDER BY v) FROM (SELECT {column} AS v, count(*) AS c FROM issues WHERE {column} IS NOT NULL GROUP BY 1)) AS "


add("a_global", _global_dashboard,
    f"WITH {D.SQL_PROJECTS}, {D.SQL_SCANS}, {D.SQL_ISSUES} SELECT (SELECT count(*) FROM projects) AS total_projects, (SELECT count(*) FROM scans WHERE status = 'completed') AS total_scans, "
    f"(SELECT count(*) FROM issues) AS total_issues, {_all_dist('severity')}severity_distribution, {_all_dist('category')}category_distribution, {_all_dist('owasp_category')}owasp_distribution, "
    "(SELECT string_agg(scan_id || '=' || status || '=' || total_issues, ';' ORDER BY started_at DESC, scan_id) FROM (SELECT * FROM scans ORDER BY started_at DESC, scan_id LIMIT 10)) AS recent_scans, "
    "(SELECT string_agg(file || '=' || c, ';' ORDER BY c DESC, file) FROM (SELECT file, count(*) AS c FROM issues GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS top_files")


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark, "csv")
    W.export_csv(D.issues(spark, sf), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select("project_id", *[F.coalesce(c, F.lit("")).alias(c) for c in W.EXPORT_CSV])


_EXPORT = "project_id, file, CAST(line AS VARCHAR) AS line, rule_id, coalesce(rule_name, '') AS rule_name, severity, category, message, coalesce(suggestion, '') AS suggestion, coalesce(owasp_category, '') AS owasp_category"
add("k_csv", _csv, f"{_I}SELECT {_EXPORT} FROM issues")


def _json(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark, "json")
    W.export_json(D.issues(spark, sf), D.projects(spark, sf), path)
    rows = spark.read.schema("project_id string, file string, line int, rule_id string, message string, code_snippet string").json(f"{path}/issues")
    totals = spark.read.schema("project struct<id:string,name:string>, total_issues bigint").json(f"{path}/header")
    return rows.join(totals.select(F.col("project.id").alias("project_id"), F.col("project.name").alias("name"), "total_issues"), "project_id")


add("k_json", _json,
    f"WITH {D.SQL_PROJECTS}, {D.SQL_ISSUES}, s AS (SELECT * FROM issues) SELECT s.project_id, file, line, rule_id, message, code_snippet, name, count(*) OVER (PARTITION BY s.project_id) AS total_issues FROM s JOIN projects USING (project_id)")


def _purge(spark: SparkSession, sf: str) -> DataFrame:
    paths = {"issues": _fresh(spark, "issues"), "scans": _fresh(spark, "scans")}
    W.write_table(D.issues(spark, sf), paths["issues"])
    W.write_table(D.scans(spark, sf), paths["scans"])
    W.purge(spark, paths, D.projects(spark, sf).filter("language = 'machinery'"))
    counts = [W.read_table(spark, p).groupBy("project_id").agg(F.count("*").alias("rows")).withColumn("table", F.lit(n)) for n, p in paths.items()]
    return counts[0].unionByName(counts[1])


add("k_purge", _purge,
    f"WITH {D.SQL_PROJECTS}, {D.SQL_SCANS}, {D.SQL_ISSUES}, gone AS (SELECT project_id FROM projects WHERE language = 'machinery') SELECT project_id, count(*) AS rows, 'issues' AS \"table\" FROM issues WHERE project_id NOT IN (SELECT project_id FROM gone) GROUP BY 1 "
    "UNION ALL SELECT project_id, count(*), 'scans' FROM scans WHERE project_id NOT IN (SELECT project_id FROM gone) GROUP BY 1")

# -- text kernels -----------------------------------------------------------------------------------------------


def _snippets(spark: SparkSession, sf: str) -> DataFrame:
    files = _texts(spark, sf).withColumn("language", F.lit("javascript"))
    return text_rule_hits(files, ["JSCS007"], snippets=True).select("project_id", "file", "line", "code_snippet")


_NEAR = "OVER (PARTITION BY project_id, path ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
add("u_snippet", _snippets,
    f"WITH {_SQL_TEXTS}, {D.SQL_LINES}, s AS (SELECT *, list(n || ': ' || line) {_NEAR} AS near, ({_rule_case('JSCS007')}) AS message FROM lines) "
    "SELECT project_id, path AS file, n AS line, array_to_string(list_transform(near, lambda x: CASE WHEN starts_with(x, n || ': ') THEN '>>> ' ELSE '    ' END || x), chr(10)) AS code_snippet "
    f"FROM s WHERE message IS NOT NULL AND {_MAGIC_OK}")
_SENTENCE = r"\.\s+[A-Z]"
add("u_lineof", lambda s, d: _texts(s, d).select("project_id", F.col("path").alias("file"), F.explode(T.match_lines(F.col("text"), T.uregex(_SENTENCE))).alias("line")),
    f"WITH {_SQL_TEXTS}, {match_line_sql('files', _SENTENCE)} SELECT project_id, path AS file, line FROM placed")
add("u_firstmsg", lambda s, d: S.explode_lines(_texts(s, d)).select("project_id", "path", "line_no", LINE_RULES["SEC003"].message(F.col("line")).alias("message")).filter("message is not null"),
    f"WITH {_SQL_TEXTS}, {D.SQL_LINES} SELECT project_id, path, n AS line_no, ({_rule_case('SEC003')}) AS message FROM lines WHERE ({_rule_case('SEC003')}) IS NOT NULL")
add("u_comment", lambda s, d: S.explode_lines(D.corpus(s, d)).filter(T.starts_trimmed(F.col("line"), ["//", "*", "--"])).select("project_id", "path", "line_no"),
    f"WITH {D.sql_corpus(None)}, files AS (SELECT project_id, path, text FROM corpus), {D.SQL_LINES} SELECT project_id, path, n AS line_no FROM lines WHERE regexp_matches(line, '^\\s*(//|\\*|--)')")
add("u_strip", lambda s, d: S.explode_lines(D.corpus(s, d)).select("project_id", "path", "line_no", T.strip(F.col("line")).alias("stripped")),
    f"WITH {D.sql_corpus(None)}, files AS (SELECT project_id, path, text FROM corpus), {D.SQL_LINES} SELECT project_id, path, n AS line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS stripped FROM lines")


def _neutral_sql(column: str) -> str:
    for term, other in prompts.NEUTRAL.items():
        for case in (str, str.upper, str.title):
            column = f"replace({column}, {q(case(term))}, {q(case(other))})"
    return column


add("u_sanitize", lambda s, d: D.issues(s, d).select("issue_id", prompts.neutral(F.col("message")).alias("message")),
    f"{_I}SELECT issue_id, {_neutral_sql('message')} AS message FROM issues")


def _prompt_sql() -> str:
    values = {"rule_id": "rule_id", "rule_name": _neutral_sql("rule_name"), "file": "file", "line": "line", "category": "category", "message": _neutral_sql("message"),
              "owasp_line": "coalesce('Standard : ' || split_part(owasp_category, '-', 1), '')", "code_snippet": "coalesce(code_snippet, '(not available)')"}
    parts, rest = [], prompts.PROMPT
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [q(before), value]
    return " || ".join([*parts, q(rest)])


add("u_prompt", lambda s, d: prompts.prompts(W.of_severity(D.issues(s, d), "CRITICAL")), f"{_I}SELECT issue_id, {_prompt_sql()} AS prompt FROM issues WHERE severity = 'CRITICAL'")

# -- streams and extension --------------------------------------------------------------------------------------


def _stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All files arrive as a stream and are scanned until all are done."""
    target = _fresh(spark, "stream")
    scan_stream.start_full_scan(_every_file(spark, sf, stream=True), target, target + "-checkpoint").awaitTermination()
    return scan_stream.current_issues(spark, target).select("project_id", "file", "line", "rule_id", "message")


add("st_scan", _stream_scan, " UNION ALL ".join(_single_kinds_sql()))
_HISTORY = (
    "WITH v AS (SELECT user_id, 'p' || json_extract_string(props, '$.k') AS project, ts FROM events), n AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS now FROM v), "
    "f AS (SELECT user_id, project, max(ts) AS ts FROM n WHERE ts > now - INTERVAL 300 SECOND GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, project) AS place FROM f) SELECT user_id, place, project FROM r WHERE place <= 20"
)
add("st_history", lambda s, d: history.history_lists(D.visits(s, d)).select("user_id", *long("place"), "project"), _HISTORY)


def _stream_history(spark: SparkSession, sf: str) -> DataFrame:
    """The same lists, kept as visits arrive."""
    target = _fresh(spark, "history")
    history.start_history(D.visits(spark, sf, stream=True), target, target + "-checkpoint").awaitTermination()
    return history.current_lists(spark, target).select("user_id", *long("place"), "project")


add("st_history_stream", _stream_history, _HISTORY)


def _user_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = RuleSet()
    rules.register_pattern(("USR001", "Shouting", "INFO", "CODE_SMELL", None, ["javascript"], "Two marks."),
                           LineRule("USR001", ("javascript",), [(r"\*\*\*|###", "Repeated marks.")], "Remove them.", ["***", "###"]))

    def wide(lines: DataFrame) -> DataFrame:
        rows = lines.filter(F.length("line") > 500)
        return rows.select("project_id", F.col("path").alias("file"), F.col("line_no").alias("line"), F.lit(0).alias("column"), F.lit("USR002").alias("rule_id"),
                           F.concat(F.lit("Line of "), F.length("line").cast("string"), F.lit(" characters.")).alias("message"), F.lit("Break it.").alias("suggestion"))

    rules.register(("USR002", "Wide line", "MINOR", "MAINTAINABILITY", None, ["javascript"], "Over 500 characters."), wide)
    hits = rules.hits(D.text_files(spark, sf, "javascript"))
    return with_metadata(hits, rules.catalog(spark)).select("project_id", "file", "line", "rule_id", "rule_name", "severity", "message")


add("x_rule", _user_rules,
    f"WITH {D.sql_files('javascript')}, {D.SQL_LINES} SELECT project_id, path AS file, n AS line, 'USR001' AS rule_id, 'Shouting' AS rule_name, 'INFO' AS severity, 'Repeated marks.' AS message FROM lines WHERE regexp_matches(line, '\\*\\*\\*|###') "
    "UNION ALL SELECT project_id, path, n, 'USR002', 'Wide line', 'MINOR', 'Line of ' || length(line) || ' characters.' FROM lines WHERE length(line) > 500")
