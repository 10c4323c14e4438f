"""Detectors over syntax facts. Most rules look at one row: they are a column, the array of findings of that row.

Any number of them run in one pass over the facts. Each rule names the node types it reads, so that a single rule ships
only those rows from the parser. Rules that relate many nodes map the facts to hits and group by (project, file) or
finer: a group never exceeds one file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import may_name, strip, uregex
from siftmill.operators.facts import FUNCTION_TYPES, children_of
from siftmill.schemas import HIT_COLUMNS

# Names, word lists and limits of the rules.
SQL_WORDS = r"\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|UNION)\b"
SHELL_NAMES = ["system", "popen", "popen2", "popen3", "popen4"]
CODE_CALLS = ["eval", "exec", "compile", "__import__"]
SUBPROCESS_CALLS = ["subprocess.call", "subprocess.run", "subprocess.Popen", "subprocess.check_output"]
UNSAFE_LOADS = [
    "pickle.load", "pickle.loads", "marshal.load", "marshal.loads", "shelve.open", "cPickle.load", "cPickle.loads",
]
WEAK_HASHES = ["hashlib.md5", "hashlib.sha1"]
WEAK_RANDOM = ["random.random", "random.randint", "random.choice", "random.randrange"]
HTTP_CALLS = [
    "requests.get", "requests.post", "requests.put", "requests.delete", "requests.patch", "urllib.request.urlopen",
    "httpx.get", "httpx.post", "httpx.AsyncClient.get",
]
FILE_CALLS = ["open", "os.path.join", "os.path.abspath", "shutil.copy", "shutil.move"]
USER_INPUT = [
    "request.args", "request.form", "request.json", "request.data", "request.GET", "request.POST", "input", "sys.argv",
]
XML_CALLS = [
    "xml.etree.ElementTree.parse", "xml.etree.ElementTree.fromstring", "xml.dom.minidom.parse",
    "xml.dom.minidom.parseString", "lxml.etree.parse", "lxml.etree.fromstring",
]
AUTH_WORDS = r"\b(auth|permission|role|admin|token|login|user|access|allowed|authorized)\b"
BLOCKING = {
    "time.sleep": "Use await asyncio.sleep() instead.",
    "requests.get": "Use httpx.AsyncClient or aiohttp for async HTTP requests.",
    "requests.post": "Use httpx.AsyncClient or aiohttp for async HTTP requests.",
    "requests.put": "Use httpx.AsyncClient or aiohttp for async HTTP requests.",
    "requests.delete": "Use httpx.AsyncClient or aiohttp for async HTTP requests.",
    "requests.patch": "Use httpx.AsyncClient or aiohttp for async HTTP requests.",
    "requests.request": "Use httpx.AsyncClient or aiohttp for async HTTP requests.",
    "urllib.request.urlopen": "Use httpx.AsyncClient or aiohttp for async HTTP requests.",
    "subprocess.run": "Use asyncio.create_subprocess_exec() for async subprocess calls.",
    "subprocess.call": "Use asyncio.create_subprocess_exec() for async subprocess calls.",
    "subprocess.Popen": "Use asyncio.create_subprocess_exec() for async subprocess calls.",
    "os.system": "Use asyncio.create_subprocess_shell() for async shell commands.",
    "input": "Use async input alternatives; input() blocks the event loop.",
}
AWAITABLES = [
    "asyncio.sleep", "asyncio.gather", "asyncio.wait", "asyncio.wait_for", "asyncio.create_task", "asyncio.shield",
]
NESTING_TYPES = ["If", "For", "While", "With", "Try"]
DECISION_TYPES = ["If", "IfExp", "For", "While", "ExceptHandler", "Assert", "With"]
BODY_TYPES = ["FunctionDef", "AsyncFunctionDef", "For", "While", "If", "With", "Try", "Module"]
TERMINATORS = ["Return", "Raise", "Break", "Continue"]
LOOP_TYPES = ["For", "While"]


_FOUND = "array<struct<line:int,column:int,message:string,suggestion:string>>"


@dataclass(frozen=True)
class FactRule:
    """``detect`` gives the findings of a facts row or, where ``grouped``, maps the facts to hits."""

    rule_id: str
    node_types: tuple[str, ...]
    detect: Callable[..., Column | DataFrame]
    gate: tuple[str, ...]
    ancestors: bool = False
    children: bool = False
    in_strings: bool = False
    grouped: bool = False

    def run(self, facts: DataFrame) -> DataFrame:
        return self.detect(facts) if self.grouped else row_hits(facts, [self])


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _hits(rows: DataFrame, rule_id: str, message: Column | str, suggestion: Column | str) -> DataFrame:
    """Hits of a grouped rule, at the start of a line."""
    return rows.select(
        "project_id", F.col("path").alias("file"), F.col("lineno").cast("int").alias("line"), F.lit(0).alias("column"),
        F.lit(rule_id).alias("rule_id"), _text(message).alias("message"), _text(suggestion).alias("suggestion"),
    )


def _say(*parts: Column | str) -> Column:
    return F.concat(*[_text(p) for p in parts])


def _on_line(message: Column | str, suggestion: Column | str, line: Column | None = None, column: Column | None = None) -> Column:
    """A finding at the start of the node's line, or of ``line``."""
    return F.struct(
        (F.col("lineno") if line is None else line).cast("int").alias("line"), (F.lit(0) if column is None else column).cast("int").alias("column"),
        _text(message).alias("message"), _text(suggestion).alias("suggestion"),
    )


def _at(message: Column | str, suggestion: Column | str) -> Column:
    """A finding at the place of the node."""
    return _on_line(message, suggestion, column=F.col("col"))


def _if(test: Column, finding: Column) -> Column:
    """One finding where ``test`` holds."""
    return F.when(test, F.array(finding)).otherwise(F.array().cast(_FOUND))


def _for_each(test: Column, items: Column, finding: Callable[[Column], Column]) -> Column:
    """One finding per item where ``test`` holds."""
    return F.coalesce(F.when(test, F.transform(items, finding)), F.array().cast(_FOUND))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body reads it per item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _of(facts: DataFrame, *types: str) -> DataFrame:
    return facts.filter(F.col("node_type").isin(*types))


def _enclosing(types: list[str]) -> Column:
    """Ancestors of the given types, one item per enclosing node."""
    return F.filter("ancestors", lambda a: a["type"].isin(types))


def _parent() -> Column:
    return F.try_element_at("ancestors", F.lit(-1))


def _string_child(c: Column) -> Column:
    return (c["type"] == "Expr") & (c["vconst_kind"] == "str")


def sql_text() -> Column:
    words = uregex(SQL_WORDS, True)
    kind = F.col("node_type")
    left = F.exists("children", lambda c: (c["field"] == "left") & (c["const_kind"] == "str") & c["const_value"].rlike(words))
    receiver = F.exists("children", lambda c: (c["field"] == "func") & (c["type"] == "Attribute") & (c["name"] == "format")
                        & (c["vconst_kind"] == "str") & c["vconst_value"].rlike(words))
    return F.concat(
        _if((kind == "JoinedStr") & F.col("seg").rlike(words), _at("Potential SQL injection via f-string formatting.", "Use parameterized queries instead of string formatting.")),
        _if((kind == "BinOp") & (F.col("op") == "Mod") & left, _at("Potential SQL injection via % string formatting.", "Use parameterized queries instead of % formatting.")),
        _if((kind == "Call") & receiver, _at("Potential SQL injection via .format() string formatting.", "Use parameterized queries instead of .format().")),
    )


def command_calls() -> Column:
    name = F.col("dotted")
    shell = F.filter(
        "children",
        lambda c: (c["field"] == "keywords") & (c["name"] == "shell") & (c["vconst_kind"] == "bool") & (c["vconst_value"] == "True"),
    )
    return F.concat(
        _if(F.substring_index(name, ".", -1).isin(SHELL_NAMES),
            _at(_say("Dangerous function call: ", name, "() can lead to OS command injection."),
                "Use subprocess.run() with a list of arguments and shell=False.")),
        _if(name.isin(CODE_CALLS),
            _at(_say("Use of ", name, "() detected — potential code injection risk."),
                _say("Avoid ", name, "(). Use safer alternatives like ast.literal_eval() for eval."))),
        _for_each(name.isin(SUBPROCESS_CALLS), shell,
                  lambda c: _at(_say(name, "() called with shell=True — command injection risk."), "Use shell=False and pass arguments as a list.")),
    )


def unsafe_loads() -> Column:
    name = F.col("dotted")
    safe = F.exists("children", lambda c: (c["field"] == "keywords") & (c["name"] == "Loader")
                    & (c["vtype"] == "Attribute") & (c["vname"] == "SafeLoader"))
    return F.concat(
        _if(name.isin(UNSAFE_LOADS),
            _at(_say("Insecure deserialization via ", name, "()."),
                "Use JSON or other safe serialization formats. If pickle is required, validate the source.")),
        _if((name == "yaml.load") & ~safe,
            _at("yaml.load() without SafeLoader — potential arbitrary code execution.", "Use yaml.safe_load() or pass Loader=yaml.SafeLoader.")),
    )


def weak_crypto() -> Column:
    name = F.col("dotted")
    return F.concat(
        _if(name.isin(WEAK_HASHES),
            _at(_say("Weak hash algorithm: ", name, "() is not collision-resistant."),
                "Use hashlib.sha256() or hashlib.sha3_256() for security-critical hashing.")),
        _if(name.isin(WEAK_RANDOM),
            _at(_say(name, "() is not cryptographically secure."),
                "Use secrets module (secrets.token_hex(), secrets.randbelow()) for security-sensitive randomness.")),
    )


def variable_urls() -> Column:
    first = F.get(F.filter("children", lambda c: (c["field"] == "args") & (c["pos"] == 0)), F.lit(0))["type"]
    kind = F.when(first == "Name", "a variable URL").when(first == "JoinedStr", "f-string URL")
    return _if(F.col("dotted").isin(HTTP_CALLS) & kind.isNotNull(),
               _at(_say("Potential SSRF: ", F.col("dotted"), "() called with ", kind, "."), "Validate and whitelist URLs before making HTTP requests."))


def silent_handlers() -> Column:
    body = children_of("body")
    only = F.get(body, F.lit(0))
    silent = (F.size(body) == 1) & ((only["type"] == "Pass") | ((only["type"] == "Expr") & (only["vtype"] == "Constant")))
    return _if(silent, _at("Silent exception handler — exceptions are caught but not logged.",
                           "Log the exception with logging.exception() or logging.error() to maintain an audit trail."))


def debug_mode() -> Column:
    on = lambda c, kind, value: (c[kind] == "bool") & (c[value] == "True")
    keyword = F.filter("children", lambda c: (c["field"] == "keywords") & (c["name"] == "debug") & on(c, "vconst_kind", "vconst_value"))
    flag = F.filter("children", lambda c: (c["field"] == "targets") & (c["type"] == "Name") & (c["name"] == "DEBUG"))
    value = F.exists("children", lambda c: (c["field"] == "value") & on(c, "const_kind", "const_value"))
    return F.concat(
        _for_each(F.col("node_type") == "Call", keyword,
                  lambda c: _at("Debug mode is enabled — exposes sensitive information in production.", "Set debug=False for production deployments.")),
        _for_each((F.col("node_type") == "Assign") & value, flag,
                  lambda c: _at("DEBUG = True detected — should be False in production.",
                                "Use environment variables: DEBUG = os.getenv('DEBUG', 'False') == 'True'")),
    )


def user_paths() -> Column:
    def mentions(c: Column) -> Column:
        out = F.lit(False)
        for word in USER_INPUT:
            out = out | c["seg"].contains(word)
        return (c["field"] == "args") & out

    return _if(F.col("dotted").isin(FILE_CALLS) & F.exists("children", mentions),
               _at(_say("Potential path traversal in ", F.col("dotted"), "() with user-controlled input."),
                   "Validate paths with os.path.realpath() and ensure they stay within allowed directories."))


def xml_parsers() -> Column:
    return _if(F.col("dotted").isin(XML_CALLS),
               _at(_say("Unsafe XML parser ", F.col("dotted"), "() — may be vulnerable to XXE attacks."),
                   "Use defusedxml library: `import defusedxml.ElementTree as ET`."))


def check_then_open() -> Column:
    checked = F.exists("children", lambda c: (c["field"] == "test")
                       & (c["seg"].contains("os.path.exists") | c["seg"].contains("os.path.isfile")))
    body = F.array_join(F.transform(children_of("body"), lambda c: c["seg"]), "\n")
    return _if(checked & body.contains("open("),
               _on_line("TOCTOU race condition — file existence check followed by file operation.",
                        "Use try/except around the file operation instead of checking existence first."))


def long_functions() -> Column:
    length = F.col("end_lineno") - F.col("lineno") + 1
    return _if(length > 50, _on_line(_say("Function '", F.col("name"), "' is ", length.cast("string"), " lines long (max 50)."),
                                     "Break complex functions into smaller, focused functions."))


def many_parameters() -> Column:
    counted = F.filter("children", lambda c: c["field"].isin("args", "kwonlyargs"))
    first, owner = F.get(children_of("args"), F.lit(0))["name"], _parent()
    n = F.size(counted) - F.when(first.isin("self", "cls"), 1).otherwise(0)
    return _if(owner["type"].isin(FUNCTION_TYPES) & (n > 5),
               _on_line(_say("Function '", owner["name"], "' has ", n.cast("string"), " parameters (max 5)."),
                        "Use a data class or dictionary to group related parameters.", owner["lineno"]))


def function_complexity(facts: DataFrame, with_files: bool = False) -> DataFrame:
    """(project_id, path, func_id, name, lineno, complexity) per function, nested functions included.

    ``with_files`` adds one row without a name per file, so that files without functions show up.

    Every decision node is credited to each enclosing function. All nodes of a file leave the parser in one
    task, so the partial aggregate already folds them to one row per function before the shuffle.
    """
    weight = (
        F.when(F.col("node_type").isin(DECISION_TYPES), 1)
        .when(F.col("node_type") == "BoolOp", F.col("arity") - 1).otherwise(0)
    )
    groups = [*FUNCTION_TYPES, *(["Module"] if with_files else [])]
    own = F.when(
        F.col("node_type").isin(groups),
        F.array(F.struct(F.col("node_id").alias("id"), F.col("name").alias("name"), F.col("lineno").alias("lineno"), F.lit(0).alias("w"))),
    ).otherwise(F.array())
    outer = F.transform(
        F.filter(_enclosing(FUNCTION_TYPES), lambda a: F.lit(True) & (weight > 0)),
        lambda a: F.struct(a["id"].alias("id"), a["name"].alias("name"), a["lineno"].alias("lineno"), weight.alias("w")),
    )
    rows = _of(facts, *groups, *DECISION_TYPES, "BoolOp").select(
        "project_id", "path", F.explode(F.concat(own, outer)).alias("f")
    )
    return rows.groupBy("project_id", "path", F.col("f.id").alias("func_id"), F.col("f.name").alias("name"),
                        F.col("f.lineno").alias("lineno")).agg((F.sum("f.w") + 1).alias("complexity"))


def complex_functions(facts: DataFrame) -> DataFrame:
    rows = function_complexity(facts).filter("complexity > 10")
    return _hits(rows, "CS003",
                 _say("Function '", F.col("name"), "' has cyclomatic complexity ", F.col("complexity").cast("string"), " (max 10)."),
                 "Simplify the function by extracting conditions into helper functions or using early returns.")


def deep_nesting(facts: DataFrame) -> DataFrame:
    depth = F.size(_enclosing(NESTING_TYPES)) + 1
    rows = (
        _of(facts, *NESTING_TYPES).withColumn("depth", depth).filter("depth > 4")
        .groupBy("project_id", "path", "lineno").agg(F.min_by("depth", "dfs_id").alias("depth"))
    )
    return _hits(rows, "CS004", _say("Code is nested ", F.col("depth").cast("string"), " levels deep (max 4)."),
                 "Reduce nesting with early returns, guard clauses, or by extracting inner blocks to functions.")


def unused_imports(facts: DataFrame) -> DataFrame:
    place = F.struct(F.col("node_id").alias("at"), F.col("lineno").alias("lineno"))

    def bound(a: Column) -> Column:
        name = F.coalesce(F.when(a["asname"] != "", a["asname"]), a["name"])
        return F.struct(F.substring_index(name, ".", 1).alias("root"), name.alias("bound_as"), F.lit(False).alias("used"))

    read = F.struct(F.col("name").alias("root"), F.lit(None).cast("string").alias("bound_as"), F.lit(True).alias("used"))
    touched = F.when(F.col("node_type") == "Name", F.array(read)).otherwise(F.transform("children", bound))
    # One exchange: the imports and the used names of a file meet by root name.
    per_name = (
        _of(facts, "Import", "ImportFrom", "Name").select("project_id", "path", place.alias("place"), F.explode(touched).alias("t"))
        .select("project_id", "path", "place", "t.*")
        .groupBy("project_id", "path", "root")
        .agg(F.max("used").alias("used"), F.collect_list(F.when(F.col("bound_as").isNotNull(), F.struct("bound_as", "place"))).alias("names"))
        .filter(~F.col("used")).select("project_id", "path", F.explode("names").alias("n"))
        .groupBy("project_id", "path", F.col("n.bound_as").alias("name")).agg(F.max("n.place").alias("last"))
        .withColumn("lineno", F.col("last.lineno"))
    )
    return _hits(per_name, "CS005", _say("Import '", F.col("name"), "' appears to be unused."),
                 "Remove unused imports to keep the code clean.")


def global_statements() -> Column:
    return _if(F.lit(True), _on_line(_say("Global variable(s) used: ", F.col("name")),
                                     "Avoid global state. Pass variables as function parameters or use class attributes."))


def bare_handlers() -> Column:
    return _if(F.size(children_of("type")) == 0,
               _on_line("Bare except block catches all exceptions, including SystemExit and KeyboardInterrupt.",
                        "Catch specific exceptions: except ValueError, except Exception."))


def list_growth() -> Column:
    grows = F.exists("children", lambda c: (c["field"] == "value") & (c["type"] == "List"))
    return _for_each((F.col("op") == "Add") & grows, _enclosing(LOOP_TYPES),
                     lambda loop: _on_line("List concatenation inside loop — use .append() or .extend() instead.",
                                           "Replace `lst += [item]` with `lst.append(item)` for better performance."))


def mutable_defaults() -> Column:
    mutable = F.filter("children", lambda c: c["field"].isin("defaults", "kw_defaults") & c["type"].isin("List", "Dict", "Set"))
    owner = _parent()
    return _for_each(owner["type"].isin(FUNCTION_TYPES), mutable,
                     lambda c: _on_line(_say("Function '", owner["name"], "' has a mutable default argument."),
                                        "Use None as default and initialize inside the function: if arg is None: arg = []", owner["lineno"]))


def star_imports() -> Column:
    return _for_each(F.lit(True), F.filter("children", lambda c: c["name"] == "*"),
                     lambda c: _on_line(_say("Wildcard import: from ", F.coalesce("name", F.lit("None")), " import *"),
                                        "Import specific names to avoid namespace pollution and improve readability."))


def dead_code() -> Column:
    def dead(body: Column) -> Column:
        pairs = F.transform(body, lambda c, i: F.struct(c["type"].alias("kind"), F.get(body, i + 1).alias("after")))
        return F.filter(
            pairs,
            lambda p: p["kind"].isin(TERMINATORS) & p["after"].isNotNull() & (p["after"]["type"] != "Pass")
            & ~F.coalesce(_string_child(p["after"]), F.lit(False)),
        )

    ends = F.exists("children", lambda c: (c["field"] == "body") & c["type"].isin(TERMINATORS))
    return _for_each(ends, _with(children_of("body"), dead),
                     lambda p: _on_line(_say("Dead code — statement after ", F.lower(p["kind"]), " is unreachable."),
                                        "Remove unreachable code or restructure the logic.", p["after"]["lineno"]))


def missing_docstrings() -> Column:
    documented = F.coalesce(_string_child(F.get(children_of("body"), F.lit(0))), F.lit(False))
    is_class = F.col("node_type") == "ClassDef"
    return _if(~F.col("name").startswith("_") & ~documented, _on_line(
        _say(F.when(is_class, "Class '").otherwise("Public function '"), F.col("name"), "' is missing a docstring."),
        F.when(is_class, "Add a docstring describing the class's purpose and usage.")
        .otherwise("Add a docstring describing the function's purpose, parameters, and return value.")))


def many_returns(facts: DataFrame) -> DataFrame:
    rows = (
        _of(facts, "Return").select("project_id", "path", F.explode(_enclosing(FUNCTION_TYPES)).alias("f"))
        .groupBy("project_id", "path", F.col("f.id").alias("id"), F.col("f.name").alias("name"), F.col("f.lineno").alias("lineno"))
        .agg(F.count("*").alias("n")).filter("n > 4")
    )
    return _hits(rows, "MAINT003", _say("Function '", F.col("name"), "' has ", F.col("n").cast("string"), " return statements (max 4)."),
                 "Simplify control flow — consider a single return at the end or extract sub-functions.")


def repeated_literals(facts: DataFrame) -> DataFrame:
    rows = (
        _of(facts, "Constant").filter(F.col("const_kind") == "str").withColumn("value", strip(F.col("const_value")))
        .filter(F.length("value") >= 6).groupBy("project_id", "path", "value")
        .agg(F.count("*").alias("n"), F.min_by("lineno", "node_id").alias("lineno")).filter("n >= 3")
        .withColumn("short", F.substring("value", 1, 40))
    )
    return _hits(rows, "MAINT004",
                 _say("String literal '", F.col("short"), "' repeated ", F.col("n").cast("string"), " times — extract to a named constant."),
                 _say("Define a module-level constant: MY_CONSTANT = '", F.col("short"), "' and reference it."))


def security_asserts() -> Column:
    return _if(F.col("seg").rlike(uregex(AUTH_WORDS, True)),
               _on_line("assert used for security/auth check — disabled in optimized mode.",
                        "Replace with an explicit if/raise: if not condition: raise PermissionError(...)"))


def temp_names() -> Column:
    return _if(F.substring_index("dotted", ".", -1) == "mktemp",
               _on_line("tempfile.mktemp() is insecure — race condition between name generation and file creation.",
                        "Use tempfile.mkstemp() or tempfile.NamedTemporaryFile() instead."))


def _signature() -> Column:
    """The function of a function row or of an argument row: type, name and line; other owners are left out."""
    own = F.struct(F.col("node_type").alias("type"), F.col("name").alias("name"), F.col("lineno").alias("lineno"))
    outer = _parent()
    outer = F.struct(outer["type"].alias("type"), outer["name"].alias("name"), outer["lineno"].alias("lineno"))
    owner = F.when(F.col("node_type") == "arguments", outer).otherwise(own)
    return F.when(owner["type"].isin(FUNCTION_TYPES), owner)


def missing_annotations() -> Column:
    def bare(fields: list[str]) -> Column:
        return F.filter("children", lambda c: c["field"].isin(fields) & c["vtype"].isNull() & ~c["name"].isin("self", "cls"))

    # Reported in declaration-group order: plain, keyword-only, *args, **kwargs.
    names = F.transform(
        F.concat(*[bare([f]) for f in ("args", "kwonlyargs", "vararg", "kwarg")]), lambda c: c["name"]
    )
    owner, is_arguments = _signature(), F.col("node_type") == "arguments"
    public = ~owner["name"].startswith("_")
    return F.concat(
        _if(is_arguments & public & (F.size(names) > 0),
            _on_line(_say("Function '", owner["name"], "' has unannotated parameters: ", F.array_join(names, ", "), "."),
                     "Add type annotations: def func(x: int, y: str) -> bool:", owner["lineno"])),
        _if(~is_arguments & public & (F.size(children_of("returns")) == 0),
            _on_line(_say("Function '", owner["name"], "' is missing a return type annotation."),
                     "Add return type: def func(...) -> ReturnType: or -> None:", owner["lineno"])),
    )


def any_annotations() -> Column:
    loose = F.filter("children", lambda c: c["field"].isin("args", "kwonlyargs") & c["vtype"].isin("Name", "Attribute") & (c["vname"] == "Any"))
    result = F.exists("children", lambda c: (c["field"] == "returns") & c["type"].isin("Name", "Attribute") & (c["name"] == "Any"))
    owner, is_arguments = _signature(), F.col("node_type") == "arguments"
    return F.concat(
        _for_each(is_arguments & owner.isNotNull(), loose,
                  lambda c: _on_line(_say("Parameter '", c["name"], "' in '", owner["name"], "' annotated as Any — use a specific type."),
                                     "Replace Any with a concrete type or Union of specific types.", owner["lineno"])),
        _if(~is_arguments & owner.isNotNull() & result,
            _on_line(_say("Return type of '", owner["name"], "' is Any — use a specific type."),
                     "Replace Any with a concrete return type.", owner["lineno"])),
    )


def implicit_optionals() -> Column:
    def names(v: Column) -> Column:
        def flagged(c: Column, i: Column) -> Column:
            default = F.get(v["defaults"], i - (F.size(v["plain"]) - F.size(v["defaults"])))
            optional = ((c["vtype"] == "Subscript") & (c["vname"] == "Optional")) | c["vnone"] | (c["vconst_kind"] == "none")
            return F.when((default["const_kind"] == "none") & c["vtype"].isNotNull() & ~F.coalesce(optional, F.lit(False)), c["name"])

        return F.filter(F.transform(v["plain"], flagged), lambda n: n.isNotNull())

    given = F.struct(F.concat(children_of("posonlyargs"), children_of("args")).alias("plain"), children_of("defaults").alias("defaults"))
    owner = _parent()
    return _for_each(owner["type"].isin(FUNCTION_TYPES), _with(given, names),
                     lambda p: _on_line(_say("Parameter '", p, "' defaults to None but is not annotated as Optional."),
                                        _say("Change annotation to Optional[T] or T | None: ", p, ": Optional[YourType] = None"), owner["lineno"]))


def blocking_calls() -> Column:
    advice = F.create_map(*[F.lit(x) for pair in BLOCKING.items() for x in pair])
    return _for_each(F.col("dotted").isin(list(BLOCKING)), _enclosing(["AsyncFunctionDef"]),
                     lambda f: _on_line(_say("Blocking call '", F.col("dotted"), "()' inside async function '", f["name"], "' — stalls the event loop."),
                                        F.element_at(advice, F.col("dotted"))))


def forgotten_awaits() -> Column:
    called = F.get(F.filter("children", lambda c: (c["field"] == "value") & (c["type"] == "Call")), F.lit(0))["dotted"]
    return _for_each(called.isin(AWAITABLES), _enclosing(["AsyncFunctionDef"]),
                     lambda f: _on_line(_say("'", called, "()' called without await — coroutine is never executed."),
                                        _say("Add await: await ", called, "(...)")))


def blocking_opens() -> Column:
    return _for_each(F.col("strict") == "open", _enclosing(["AsyncFunctionDef"]),
                     lambda f: _on_line(_say("Synchronous open() inside async function '", f["name"], "' blocks the event loop."),
                                        "Use aiofiles: async with aiofiles.open(...) as f:"))


def zero_sleeps() -> Column:
    first = F.get(F.filter("children", lambda c: (c["field"] == "args") & (c["pos"] == 0)), F.lit(0))
    zero = (first["const_kind"].isin("int", "float") & (first["const_value"].try_cast("double") == 0)) | (
        (first["const_kind"] == "bool") & (first["const_value"] == "False")
    )
    return _for_each((F.col("strict") == "asyncio.sleep") & (F.col("parent_type") == "Await") & zero, _enclosing(LOOP_TYPES),
                     lambda loop: _on_line("asyncio.sleep(0) in a loop — consider a proper async queue or event instead.",
                                           "Use asyncio.Queue or asyncio.Event for producer/consumer patterns.", _parent()["lineno"]))


_F = tuple(FUNCTION_TYPES)
FACT_RULES = {
    r.rule_id: r
    for r in [
        FactRule("SEC001", ("JoinedStr", "BinOp", "Call"), sql_text, ("select", "insert", "update", "delete", "drop", "create", "alter", "exec", "union"), children=True, in_strings=True),
        FactRule("SEC002", ("Call",), command_calls, ("system", "popen", "eval", "exec", "compile", "__import__", "subprocess"), children=True),
        FactRule("SEC004", ("Call",), unsafe_loads, ("pickle", "marshal", "shelve", "yaml"), children=True),
        FactRule("SEC005", ("Call",), weak_crypto, ("hashlib", "random")),
        FactRule("SEC006", ("Call",), variable_urls, ("requests", "urllib", "httpx"), children=True),
        FactRule("SEC007", ("ExceptHandler",), silent_handlers, ("except",), children=True),
        FactRule("SEC008", ("Call", "Assign"), debug_mode, ("debug",), children=True),
        FactRule("SEC009", ("Call",), user_paths, ("open", "join", "abspath", "shutil"), children=True),
        FactRule("SEC010", ("Call",), xml_parsers, ("xml",)),
        FactRule("SEC014", ("If",), check_then_open, ("os.path",), children=True),
        FactRule("CS001", _F, long_functions, ("def",)),
        FactRule("CS002", ("arguments",), many_parameters, ("def",), ancestors=True, children=True),
        FactRule("CS003", (*_F, *DECISION_TYPES, "BoolOp"), complex_functions, ("def",), ancestors=True, grouped=True),
        FactRule("CS004", tuple(NESTING_TYPES), deep_nesting, ("if", "for", "while", "with", "try"), ancestors=True, grouped=True),
        FactRule("CS005", ("Import", "ImportFrom", "Name"), unused_imports, ("import",), children=True, grouped=True),
        FactRule("CS006", ("Global",), global_statements, ("global",)),
        FactRule("CS007", ("ExceptHandler",), bare_handlers, ("except",), children=True),
        FactRule("PERF001", ("AugAssign",), list_growth, ("+=",), ancestors=True, children=True),
        FactRule("PERF002", ("arguments",), mutable_defaults, ("def",), ancestors=True, children=True),
        FactRule("PERF003", ("ImportFrom",), star_imports, ("import",), children=True),
        FactRule("MAINT001", tuple(BODY_TYPES), dead_code, ("return", "raise", "break", "continue"), children=True),
        FactRule("MAINT002", (*_F, "ClassDef"), missing_docstrings, ("def", "class"), children=True),
        FactRule("MAINT003", ("Return",), many_returns, ("return",), ancestors=True, grouped=True),
        FactRule("MAINT004", ("Constant",), repeated_literals, ('"', "'"), grouped=True),
        FactRule("MAINT005", ("Assert",), security_asserts, ("assert",)),
        FactRule("MAINT006", ("Call",), temp_names, ("mktemp",)),
        FactRule("TYPE001", ("arguments", *_F), missing_annotations, ("def",), ancestors=True, children=True),
        FactRule("TYPE002", ("arguments", *_F), any_annotations, ("any",), ancestors=True, children=True),
        FactRule("TYPE003", ("arguments",), implicit_optionals, ("none",), ancestors=True, children=True),
        FactRule("ASYNC001", ("Call",), blocking_calls, ("async",), ancestors=True),
        FactRule("ASYNC002", ("Expr",), forgotten_awaits, ("async",), ancestors=True, children=True),
        FactRule("ASYNC003", ("Call",), blocking_opens, ("async",), ancestors=True),
        FactRule("ASYNC004", ("Call",), zero_sleeps, ("await",), ancestors=True, children=True),
    ]
}


def rule_facts(files: DataFrame, rules: list[FactRule], enclosing: list[str] | None = None) -> DataFrame:
    """Facts limited to what the given rules read, from files that can concern one of them at all.

    The gates are literal words tested on the text ahead of parsing: a rule on its own parses few files. ``enclosing`` names
    the types of ancestors that the plan reads, where it doesn't read them all.
    """
    from siftmill.operators.facts import syntax_facts

    types = sorted({t for r in rules for t in r.node_types})
    opened = F.lit(False)
    for r in rules:
        opened = opened | may_name(F.col("text"), list(r.gate), r.in_strings)
    return syntax_facts(files.filter(opened), types, enclosing or any(r.ancestors for r in rules), any(r.children for r in rules))


def row_hits(facts: DataFrame, rules: list[FactRule]) -> DataFrame:
    """Hits of rules over single rows, all in one pass over the facts."""
    kind = F.col("node_type")

    def found(r: FactRule) -> Column:
        named = F.transform(r.detect(), lambda f: F.struct(F.lit(r.rule_id).alias("rule_id"), f.alias("f")))
        return F.coalesce(F.when(kind.isin(*r.node_types), named), F.array().cast(f"array<struct<rule_id:string,f:{_FOUND[6:-1]}>>"))

    rows = _of(facts, *sorted({t for r in rules for t in r.node_types})).select(
        "project_id", F.col("path").alias("file"), F.explode(F.concat(*[found(r) for r in rules])).alias("r"))
    return rows.select("project_id", "file", "r.f.line", "r.f.column", "r.rule_id", "r.f.message", "r.f.suggestion").select(*HIT_COLUMNS)


def fact_rule_hits(facts: DataFrame, rule_ids: list[str] | None = None) -> DataFrame:
    """All hits of the fact rules over one facts table: one pass for the rules over single rows, one per grouped rule."""
    wanted = [FACT_RULES[i] for i in (sorted(FACT_RULES) if rule_ids is None else rule_ids)]
    single = [r for r in wanted if not r.grouped]
    parts = [row_hits(facts, single)] if single else []
    parts += [r.run(facts).select(*HIT_COLUMNS) for r in wanted if r.grouped]
    return reduce(DataFrame.unionByName, parts)
