"""Detectors that look at one line, a bounded neighbourhood of lines, or one whole text.

A rule is data: ordered (pattern, message) pairs, a comment filter and a gate. The gate is a literal
alternation tested once per file; a rule whose gate is shut costs nothing more for that file, and files with
every gate shut leave the plan before their lines are looked at. A file stays one row until its hits are
known, and everything is narrow: no rule here needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import any_of, is_blank, let, match_lines, occurrences, running_sum, snippet, split_lines, starts_trimmed, strip, uregex
from siftmill.operators import line_patterns as P
from siftmill.schemas import HIT_COLUMNS


@dataclass(frozen=True)
class LineRule:
    """First matching pattern of a line wins; one hit per line."""

    rule_id: str
    languages: tuple[str, ...]
    patterns: list[tuple[str, str]]
    suggestion: str
    gate: list[str]
    comments: tuple[str, ...] = ()
    ignore_case: bool = False
    unless: tuple[str, ...] = ()

    def message(self, line: Column) -> Column:
        """The message of the first pattern found in ``line``, or NULL."""
        out = None
        for pattern, text in self.patterns:
            test = line.rlike(uregex(pattern, self.ignore_case))
            out = F.when(test, F.lit(text)) if out is None else out.when(test, F.lit(text))
        keep = F.lit(True)
        for literal in self.unless:
            keep = keep & ~line.contains(literal)
        if self.comments:
            keep = keep & ~starts_trimmed(line, list(self.comments))
        return F.when(keep, out) if (self.unless or self.comments) else out


class MagicNumberRule(LineRule):
    """Reports the first bare number of a line."""

    def message(self, line: Column) -> Column:
        number = F.regexp_extract(line, uregex(P.MAGIC_NUMBER), 0)
        keep = ~line.contains("const") & ~line.contains("PORT") & ~starts_trimmed(line, list(self.comments))
        text = F.concat(F.lit("Magic number "), number, F.lit(" — use a named constant."))
        return F.when(keep & line.rlike("[0-9]{3}") & (number != ""), text)


@dataclass(frozen=True)
class FileRule:
    """Computes ``array<struct<line,message>>`` from the text or the line array of one file."""

    rule_id: str
    languages: tuple[str, ...]
    hits: Callable[[Column, Column], Column]
    suggestion: str
    gate: list[str] = field(default_factory=list)


JS_NOTE = ("//", "*")
CS_NOTE = ("//",)


def _line_rules() -> list[LineRule]:
    js, sql, cs, py = ("javascript",), ("sql",), ("csharp",), ("python",)
    return [
        LineRule("SEC003", ("python", "javascript"), P.SEC003, P.SUGGEST["SEC003"],
                 ["passw", "pwd", "api_", "apikey", "secret", "token", "priv", "aws_access_key_id"]),
        LineRule("SEC011", py, P.SEC011, P.SUGGEST["SEC011"], ["verify", "cert_none", "protocol_", "check_hostname"]),
        LineRule("SEC013", py, P.SEC013, P.SUGGEST["SEC013"], ["log", "print"], ignore_case=True),
        LineRule("JSEC001", js, P.JSEC001, P.SUGGEST["JSEC001"],
                 ["html", "document.write", "eval", "function", "settimeout", "setinterval"], JS_NOTE),
        LineRule("JSEC002", js, P.JSEC002, P.SUGGEST["JSEC002"],
                 ["passw", "pwd", "api", "secret", "token", "aws_", "private_key", "db_pass"], JS_NOTE),
        LineRule("JSEC003", js, P.JSEC003, P.SUGGEST["JSEC003"], ["math.random"]),
        LineRule("JSEC004", js, P.JSEC004, P.SUGGEST["JSEC004"], ["[", "__proto__", "prototype"]),
        LineRule("JSEC005", js, P.JSEC005, P.SUGGEST["JSEC005"], ["fs", "path.", "__dirname"]),
        LineRule("JSEC006", js, P.JSEC006, P.SUGGEST["JSEC006"], ["jwt.", "verify", "ignoreexpiration"]),
        LineRule("JSEC007", js, P.JSEC007, P.SUGGEST["JSEC007"], [".find", ".update", ".deleteone", "$where"]),
        LineRule("JSEC008", js, P.JSEC008, P.SUGGEST["JSEC008"], ["access-control-allow", "origin", "cors"]),
        LineRule("JSEC009", js, P.JSEC009, P.SUGGEST["JSEC009"], ["console.", "debugger"], JS_NOTE),
        LineRule("JSEC010", js, P.JSEC010, P.SUGGEST["JSEC010"], ["/"]),
        LineRule("JSEC011", js, P.JSEC011, P.SUGGEST["JSEC011"], ["redirect", "location"]),
        LineRule("JSEC013", js, P.JSEC013, P.SUGGEST["JSEC013"], ["fetch", "axios", "http", "request.get"]),
        LineRule("SQL001", sql, P.SQL001, P.SUGGEST["SQL001"], ["exec"], ignore_case=True),
        LineRule("SQL002", sql, P.SQL002, P.SUGGEST["SQL002"], ["select"], ("--",), ignore_case=True),
        LineRule("SQL004", sql, P.SQL004, P.SUGGEST["SQL004"], ["passw", "pwd"]),
        LineRule("CS_SEC001", cs, P.CS_SEC001, P.SUGGEST["CS_SEC001"],
                 ["select", "insert", "update", "delete", "drop", "exec"], CS_NOTE, ignore_case=True),
        LineRule("CS_SEC002", cs, P.CS_SEC002, P.SUGGEST["CS_SEC002"],
                 ["passw", "pwd", "api", "secret", "token", "connectionstring", "aws_"], CS_NOTE),
        LineRule("CS_SEC003", cs, P.CS_SEC003, P.SUGGEST["CS_SEC003"],
                 ["md5", "sha1", "descrypto", "rc2", "tripledes"], CS_NOTE, ignore_case=True),
        LineRule("CS_SEC005", cs, P.CS_SEC005, P.SUGGEST["CS_SEC005"], [".write"], CS_NOTE, ignore_case=True),
        LineRule("CS_SEC006", cs, P.CS_SEC006, P.SUGGEST["CS_SEC006"], ["process.start"], CS_NOTE, ignore_case=True),
        LineRule("CS_SEC007", cs, P.CS_SEC007, P.SUGGEST["CS_SEC007"], ["formatter", "serializer"], CS_NOTE),
        LineRule("JSCS002", js, P.JSCS002, P.SUGGEST["JSCS002"], ["var"]),
        LineRule("JSCS003", js, P.JSCS003, P.SUGGEST["JSCS003"], ["=="], JS_NOTE),
        LineRule("JSCS005", js, P.JSCS005, P.SUGGEST["JSCS005"], ["console."], JS_NOTE),
        LineRule("JSCS006", js, P.JSCS006, P.SUGGEST["JSCS006"], [".then"], unless=(".catch",)),
        MagicNumberRule("JSCS007", js, [], P.SUGGEST["JSCS007"], list("23456789") + ["1", "0"], JS_NOTE),
    ]


_HIT = "array<struct<line:int,message:string>>"


def _hit(line: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(line.cast("int").alias("line"), text.alias("message"))


def _numbered(lines: Column, test: Callable[[Column, Column], Column], message: Callable[[Column, Column], Column]) -> Column:
    """Hits for the lines (1-based) that pass ``test``; each element sees the line and its number."""
    marked = F.transform(lines, lambda line, i: F.when(test(line, i + 1), _hit(i + 1, message(line, i + 1))))
    return F.filter(marked, lambda h: h.isNotNull())


def _routes_without_auth(text: Column, lines: Column) -> Column:
    route = uregex("|".join(P.ROUTES))
    auth = uregex("|".join(P.ROUTE_AUTH))

    def bare(line: Column, n: Column) -> Column:
        first = F.greatest(F.lit(1), n - 5)
        near = F.slice(lines, first, F.least(F.size(lines), n + 9) - first + 1)
        return line.rlike(route) & ~F.array_join(near, "\n").rlike(auth)

    return _numbered(lines, bare, lambda line, n: F.lit(P.MESSAGES["SEC012"]))


def _empty_csharp_catch(text: Column, lines: Column) -> Column:
    """A catch whose next line that isn't blank closes it; of all lines only those that aren't blank are paired up."""
    filled = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("x"))), lambda f: ~is_blank(f["x"]))
    following = F.slice(filled, F.lit(2), F.greatest(F.size(filled), F.lit(1)))
    pairs = F.zip_with(filled, following, lambda a, b: F.when(a["x"].rlike(uregex(P.CS_CATCH)) & (strip(b["x"]) == "}"), _hit(a["n"], P.MESSAGES["CS_SEC004"])))
    return F.filter(pairs, lambda h: h.isNotNull())


def _deep_braces(text: Column, lines: Column) -> Column:
    """Running brace depth over the file's own lines; comment lines neither count nor report."""
    note = lambda line: starts_trimmed(line, list(JS_NOTE))
    depths = running_sum(F.transform(lines, lambda x: F.when(note(x), 0).otherwise(occurrences(x, "{") - occurrences(x, "}"))))
    text = lambda depth: F.concat(F.lit("Code nested "), depth.cast("string"), F.lit(" levels deep (max 4)."))
    at = F.zip_with(lines, depths, lambda line, d: F.when((d > 4) & ~note(line), d))
    hits = F.transform(at, lambda d, i: F.when(d.isNotNull(), _hit(i + 1, text(d))))
    return F.filter(hits, lambda h: h.isNotNull())


def _long_functions(text: Column, lines: Column) -> Column:
    from siftmill.operators.js_facts import brace_index, braced_length, function_name

    def found(braces: Column, line: Column, i: Column) -> Column:
        length = braced_length(braces, i + 1, F.size(lines), unclosed=F.lit(1))
        text = lambda n: F.concat(
            F.lit("Function '"), function_name(line), F.lit("' is approximately "), n.cast("string"), F.lit(" lines long (max 50)."))
        return F.when(function_name(line) != "", let(length, lambda n: F.when(n > 50, _hit(i + 1, text(n)))))

    braces = brace_index(F.transform(lines, lambda x: occurrences(x, "{") - occurrences(x, "}")))
    return let(braces, lambda b: F.filter(F.transform(lines, lambda x, i: found(b, x, i)), lambda h: h.isNotNull()))


def _empty_js_catch(text: Column, lines: Column) -> Column:
    return F.transform(match_lines(text, uregex(P.JS_EMPTY_CATCH)), lambda n: _hit(n, P.MESSAGES["JSCS004"]))


def _missing_helmet(text: Column, lines: Column) -> Column:
    exposed = text.rlike(uregex(P.EXPRESS)) & ~text.rlike(uregex(P.HELMET))
    return F.when(exposed, F.array(_hit(F.lit(1), P.MESSAGES["JSEC012"])))


def _unbounded_changes(text: Column, lines: Column) -> Column:
    deletes = _numbered(
        lines,
        lambda line, n: line.rlike(uregex(P.SQL_DELETE_ALL, True)) & ~starts_trimmed(line, ["--"]),
        lambda line, n: F.lit(P.MESSAGES["SQL003_DELETE"]),
    )
    # The look-ahead captures up to the next ';' without consuming it, so every UPDATE head is seen.
    heads = uregex(P.SQL_UPDATE_HEAD, True)
    statements = F.regexp_extract_all(text, F.lit(heads + "(?=([^;]*))"), F.lit(1))
    numbers = match_lines(text, heads)
    updates = F.filter(
        F.transform(numbers, lambda n, k: F.when(~F.contains(F.upper(F.get(statements, k)), F.lit("WHERE")),
                                                 _hit(n, P.MESSAGES["SQL003_UPDATE"]))),
        lambda h: h.isNotNull(),
    )
    return F.concat(deletes, updates)


def _no_transaction(text: Column, lines: Column) -> Column:
    count = F.regexp_count(text, F.lit(uregex(P.SQL_DML, True)))
    text_ = F.concat(
        F.lit("Found "), count.cast("string"),
        F.lit(" DML statements with no transaction control (BEGIN/COMMIT/ROLLBACK)."),
    )
    return F.when((count >= 2) & ~text.rlike(uregex(P.SQL_TRANSACTION, True)), F.array(_hit(F.lit(1), text_)))


def _file_rules() -> list[FileRule]:
    js, sql, s = ("javascript",), ("sql",), P.SUGGEST
    return [
        FileRule("SEC012", ("python",), _routes_without_auth, s["SEC012"], ["@app.", "@router.", "@blueprint."]),
        FileRule("JSEC012", js, _missing_helmet, s["JSEC012"], ["express"]),
        FileRule("SQL003", sql, _unbounded_changes, s["SQL003"], ["delete", "update"]),
        FileRule("SQL005", sql, _no_transaction, s["SQL005"], ["insert", "update", "delete"]),
        FileRule("CS_SEC004", ("csharp",), _empty_csharp_catch, s["CS_SEC004"], ["catch"]),
        FileRule("JSCS001", js, _long_functions, s["JSCS001"], ["function", "=>"]),
        FileRule("JSCS004", js, _empty_js_catch, s["JSCS004"], ["catch"]),
        FileRule("JSCS008", js, _deep_braces, s["JSCS008"], ["{"]),
    ]


LINE_RULES = {r.rule_id: r for r in _line_rules()}
FILE_RULES = {r.rule_id: r for r in _file_rules()}
TEXT_RULE_IDS = sorted(LINE_RULES) + sorted(FILE_RULES)


def _gate(text: Column, rule: LineRule | FileRule) -> Column:
    return text.rlike(any_of(rule.gate)) if rule.gate else F.lit(True)


def _found(rule: LineRule | FileRule, text: Column, lines: Column) -> Column:
    """``array<struct<line,message>>`` of one rule over one file row."""
    if isinstance(rule, FileRule):
        return rule.hits(text, lines)
    marked = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("line"), rule.message(x).alias("message")))
    return F.filter(marked, lambda h: h["message"].isNotNull())


def _labelled(hits: Column, rule: LineRule | FileRule) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(h["line"].alias("line"), F.lit(rule.rule_id).alias("rule_id"), h["message"].alias("message"),
                           F.lit(rule.suggestion).alias("suggestion")),
    )


def rule_hits(files: DataFrame, language: str, rules: list[LineRule | FileRule], snippets: bool = False) -> DataFrame:
    """Hits of text rules over the files of one language, worked out inside the file row.

    Gates are tested first; a rule's patterns are tried only on files that open its gate, and files that open none
    are dropped. With ``snippets`` the surrounding lines are cut here too, so no later join has to move texts.
    """
    gates = [_gate(F.col("text"), r).alias(f"g{i}") for i, r in enumerate(rules)]
    rows = (
        files.filter(F.col("language") == language).select("project_id", "path", "text", *gates)
        .filter(_disjunction([F.col(f"g{i}") for i in range(len(rules))]))
        .withColumn("lines", split_lines(F.col("text")))
    )
    none = F.array().cast(_HIT)
    per_rule = [
        _labelled(F.coalesce(F.when(F.col(f"g{i}"), _found(r, F.col("text"), F.col("lines"))), none), r)
        for i, r in enumerate(rules)
    ]
    hits = F.concat(*per_rule)
    if snippets:
        hits = F.transform(hits, lambda h: F.struct(h["line"].alias("line"), h["rule_id"].alias("rule_id"), h["message"].alias("message"),
                                                    h["suggestion"].alias("suggestion"), snippet(F.col("lines"), h["line"]).alias("code_snippet")))
    extra = ["h.code_snippet"] if snippets else []
    return (
        rows.select("project_id", F.col("path").alias("file"), F.explode(hits).alias("h"))
        .select("project_id", "file", "h.line", F.lit(0).alias("column"), "h.rule_id", "h.message", "h.suggestion", *extra)
    )


def text_rule_hits(
    files: DataFrame, rule_ids: list[str] | None = None, parsed: DataFrame | None = None, snippets: bool = False
) -> DataFrame:
    """All hits of the text rules (or some of them), one branch per language.

    Hits in Python count in files that parse. ``parsed`` (project_id, file) names these where they are known, so that
    only hits meet them; otherwise files that raise a gate are parsed here.
    """
    wanted = TEXT_RULE_IDS if rule_ids is None else rule_ids
    every = [LINE_RULES.get(i) or FILE_RULES[i] for i in wanted]
    branches = []
    for language in ("python", "javascript", "sql", "csharp"):
        rules = [r for r in every if language in r.languages]
        if not rules:
            continue
        source = files
        if language == "python" and parsed is None:
            from siftmill.operators.facts import parses

            opened = _disjunction([_gate(F.col("text"), r) for r in rules])
            source = files.filter(F.col("language") == "python").filter(opened).filter(parses(F.col("text")))
        hits = rule_hits(source, language, rules, snippets)
        branches.append(hits.join(parsed, ["project_id", "file"], "left_semi") if language == "python" and parsed is not None else hits)
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out.select(*HIT_COLUMNS, *(["code_snippet"] if snippets else []))


def _disjunction(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def pattern_rule_hits(files: DataFrame, rules: list[LineRule | FileRule], snippets: bool = False) -> DataFrame:
    """Extension point: user rules that are data rows, run the same way as the built-in ones."""
    branches = [rule_hits(files, lang, [r for r in rules if lang in r.languages], snippets)
                for lang in sorted({lang for r in rules for lang in r.languages})]
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out
