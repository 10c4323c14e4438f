"""The rule catalogue: metadata of every finding kind, kept as data and joined to hits by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.schemas import OWASP

PY, JS, SQL, CS = "python", "javascript", "sql", "csharp"

# Id, name, severity, category, standard label, languages, description.
RULES = [
    ("SEC001", "SQL Injection", "CRITICAL", "SECURITY", "A03", [PY], "Detects string formatting/concatenation used in SQL queries."),
    ("SEC002", "OS Command Injection", "CRITICAL", "SECURITY", "A03", [PY], "Detects use of os.system, subprocess with shell=True, or eval/exec."),
    ("SEC003", "Hardcoded Secrets", "CRITICAL", "SECURITY", "A07", [PY, JS], "Detects hardcoded passwords, API keys, tokens, and secret keys."),
    ("SEC004", "Insecure Deserialization", "CRITICAL", "SECURITY", "A08", [PY], "Detects use of pickle, marshal, yaml.load(unsafe), and shelve."),
    ("SEC005", "Weak Cryptography", "MAJOR", "SECURITY", "A02", [PY], "Detects use of weak hashing algorithms (MD5, SHA1) and insecure random."),
    ("SEC006", "Server-Side Request Forgery (SSRF)", "MAJOR", "SECURITY", "A10", [PY], "Detects HTTP requests where the URL may be user-controlled."),
    ("SEC007", "Missing Security Logging", "MINOR", "SECURITY", "A09", [PY], "Detects except blocks that catch SecurityError or auth-related exceptions silently."),
    ("SEC008", "Debug Mode Enabled", "MAJOR", "SECURITY", "A05", [PY], "Detects Flask/Django debug mode enabled in production."),
    ("SEC009", "Path Traversal", "CRITICAL", "SECURITY", "A01", [PY], "Detects file operations with user-controlled paths."),
    ("SEC010", "XML External Entity (XXE)", "CRITICAL", "SECURITY", "A05", [PY], "Detects unsafe XML parsing that may allow XXE attacks."),
    ("SEC011", "Insecure TLS/SSL Configuration", "CRITICAL", "SECURITY", "A02", [PY], "Detects disabled SSL verification and weak TLS settings."),
    ("SEC012", "Missing Authentication Decorator", "MAJOR", "SECURITY", "A01", [PY], "Flask/FastAPI routes without authentication decorators may be publicly accessible."),
    ("SEC013", "Sensitive Data in Logs", "MAJOR", "SECURITY", "A09", [PY], "Detects logging of potentially sensitive data like passwords or tokens."),
    ("SEC014", "TOCTOU Race Condition", "MAJOR", "SECURITY", "A04", [PY], "Detects time-of-check/time-of-use patterns with file existence checks."),
    ("JSEC001", "Cross-Site Scripting (XSS)", "CRITICAL", "SECURITY", "A03", [JS], "Detects dangerous innerHTML, document.write, and eval usage with variables."),
    ("JSEC002", "Hardcoded Secrets (JS)", "CRITICAL", "SECURITY", "A07", [JS], "Detects hardcoded API keys, tokens, and passwords in JavaScript/TypeScript."),
    ("JSEC003", "Insecure Randomness", "MAJOR", "SECURITY", "A02", [JS], "Math.random() is not cryptographically secure."),
    ("JSEC004", "Prototype Pollution", "CRITICAL", "SECURITY", "A03", [JS], "Detects patterns that may allow prototype pollution attacks."),
    ("JSEC005", "Path Traversal (JS)", "CRITICAL", "SECURITY", "A01", [JS], "Detects file path operations with user-controlled input."),
    ("JSEC006", "Insecure JWT Usage", "CRITICAL", "SECURITY", "A07", [JS], "Detects JWT verification bypasses and weak configurations."),
    ("JSEC007", "NoSQL Injection", "CRITICAL", "SECURITY", "A03", [JS], "Detects MongoDB/NoSQL queries built with user-controlled input."),
    ("JSEC008", "Insecure CORS Configuration", "MAJOR", "SECURITY", "A05", [JS], "Detects overly permissive CORS settings."),
    ("JSEC009", "Debug Code in Production", "MINOR", "SECURITY", "A09", [JS], "Detects console.log, debugger statements, and TODO security notes."),
    ("JSEC010", "ReDoS — Catastrophic Backtracking", "MAJOR", "SECURITY", "A04", [JS], "Detects regex patterns vulnerable to catastrophic backtracking."),
    ("JSEC011", "Open Redirect", "MAJOR", "SECURITY", "A01", [JS], "Detects redirects using user-controlled URLs."),
    ("JSEC012", "Missing Security Headers (Helmet)", "MAJOR", "SECURITY", "A05", [JS], "Express apps should use helmet to set security headers."),
    ("JSEC013", "Server-Side Request Forgery (JS)", "MAJOR", "SECURITY", "A10", [JS], "Detects HTTP requests with user-controlled URLs."),
    ("SQL001", "Dynamic SQL Construction", "CRITICAL", "SECURITY", "A03", [SQL], "Detects EXEC/EXECUTE with string concatenation — SQL injection risk."),
    ("SQL002", "SELECT * Usage", "MINOR", "PERFORMANCE", None, [SQL], "SELECT * retrieves all columns, hurting performance and maintainability."),
    ("SQL003", "DELETE/UPDATE Without WHERE", "BLOCKER", "SECURITY", "A04", [SQL], "DELETE or UPDATE without a WHERE clause affects all rows."),
    ("SQL004", "Hardcoded Credentials in SQL", "CRITICAL", "SECURITY", "A07", [SQL], "Detects hardcoded passwords or connection strings in SQL files."),
    ("SQL005", "Missing Transaction Control", "MAJOR", "MAINTAINABILITY", None, [SQL], "Multiple DML statements without explicit transaction control."),
    ("CS_SEC001", "C# SQL Injection", "CRITICAL", "SECURITY", "A03", [CS], "Detects string concatenation used to build SQL queries in C#."),
    ("CS_SEC002", "C# Hardcoded Secrets", "CRITICAL", "SECURITY", "A07", [CS], "Detects hardcoded passwords, API keys, and connection strings in C# code."),
    ("CS_SEC003", "C# Weak Cryptography", "MAJOR", "SECURITY", "A02", [CS], "Detects use of MD5, SHA1, DES, or RC2 in C# code."),
    ("CS_SEC004", "C# Empty Catch Block", "MAJOR", "CODE_SMELL", "A09", [CS], "Detects empty catch blocks that silently swallow exceptions."),
    ("CS_SEC005", "C# Debug/Trace Code Left In", "MINOR", "CODE_SMELL", None, [CS], 'Detects Console.WriteLine, Debug.WriteLine, or [Conditional("DEBUG")] in production code.'),
    ("CS_SEC006", "C# Command Injection", "CRITICAL", "SECURITY", "A03", [CS], "Detects Process.Start with user-controlled arguments."),
    ("CS_SEC007", "C# Insecure Deserialization", "CRITICAL", "SECURITY", "A08", [CS], "Detects use of BinaryFormatter or JavaScriptSerializer which are insecure."),
    ("CS001", "Function Too Long", "MINOR", "CODE_SMELL", None, [PY], "Functions should not exceed 50 lines."),
    ("CS002", "Too Many Parameters", "MINOR", "CODE_SMELL", None, [PY], "Functions should not have more than 5 parameters."),
    ("CS003", "High Cyclomatic Complexity", "MAJOR", "COMPLEXITY", None, [PY], "Functions with cyclomatic complexity > 10 are hard to test and maintain."),
    ("CS004", "Deep Nesting", "MINOR", "CODE_SMELL", None, [PY], "Code blocks nested more than 4 levels deep are hard to read."),
    ("CS005", "Unused Import", "INFO", "CODE_SMELL", None, [PY], "Detects imports that are not used in the module."),
    ("CS006", "Global Variable Usage", "MINOR", "CODE_SMELL", None, [PY], "Detects use of global variables."),
    ("CS007", "Bare/Empty Except", "MAJOR", "CODE_SMELL", None, [PY], "Detects bare except: blocks that catch all exceptions."),
    ("JSCS001", "Function Too Long (JS)", "MINOR", "CODE_SMELL", None, [JS], "Functions exceeding 50 lines are hard to maintain."),
    ("JSCS002", "var Declaration", "MINOR", "CODE_SMELL", None, [JS], "var has function scope and hoisting issues — use const/let."),
    ("JSCS003", "Loose Equality (==)", "MINOR", "CODE_SMELL", None, [JS], "Using == instead of === can cause unexpected type coercion."),
    ("JSCS004", "Empty Catch Block (JS)", "MAJOR", "CODE_SMELL", None, [JS], "Empty catch blocks swallow errors silently."),
    ("JSCS005", "Console Statement", "INFO", "CODE_SMELL", None, [JS], "console.log and similar statements should not be in production code."),
    ("JSCS006", "Unhandled Promise", "MAJOR", "CODE_SMELL", None, [JS], "Promises without .catch() or try/await can cause unhandled rejections."),
    ("JSCS007", "Magic Number", "INFO", "MAINTAINABILITY", None, [JS], "Unexplained numeric literals reduce code readability."),
    ("JSCS008", "Deep Nesting (JS)", "MINOR", "CODE_SMELL", None, [JS], "Code nested more than 4 levels deep is hard to read."),
    ("PERF001", "Inefficient Pattern in Loop", "MINOR", "PERFORMANCE", None, [PY], "Detects patterns like repeated list concatenation inside loops."),
    ("PERF002", "Mutable Default Argument", "MAJOR", "CODE_SMELL", None, [PY], "Detects mutable default arguments (list, dict, set) in function signatures."),
    ("PERF003", "Star Import", "MINOR", "CODE_SMELL", None, [PY], "Detects wildcard imports (from module import *) which pollute the namespace."),
    ("MAINT001", "Dead Code After Return/Raise", "MAJOR", "MAINTAINABILITY", None, [PY], "Statements after return/raise/break/continue are never executed."),
    ("MAINT002", "Missing Docstring", "MINOR", "MAINTAINABILITY", None, [PY], "Public functions, classes, and modules should have docstrings."),
    ("MAINT003", "Too Many Return Statements", "MINOR", "MAINTAINABILITY", None, [PY], "Functions with more than 4 return statements are hard to follow."),
    ("MAINT004", "Duplicate String Literal", "MINOR", "MAINTAINABILITY", None, [PY], "The same string literal repeated 3+ times should be a named constant."),
    ("MAINT005", "Assert Used for Security Check", "CRITICAL", "MAINTAINABILITY", None, [PY], "assert statements are stripped in optimized mode (-O) and must not be used for security/validation."),
    ("MAINT006", "Insecure Temporary File", "MAJOR", "MAINTAINABILITY", None, [PY], "tempfile.mktemp() is vulnerable to race conditions — use mkstemp() or NamedTemporaryFile()."),
    ("TYPE001", "Missing Type Annotations", "MINOR", "MAINTAINABILITY", None, [PY], "Public functions should have type annotations on parameters and return type."),
    ("TYPE002", "Overuse of Any Type", "MINOR", "MAINTAINABILITY", None, [PY], "Using typing.Any disables type checking — use specific types instead."),
    ("TYPE003", "Implicit Optional Parameter", "MINOR", "MAINTAINABILITY", None, [PY], "Parameters with default=None should be annotated as Optional[T] or T | None."),
    ("ASYNC001", "Blocking Call in Async Function", "CRITICAL", "PERFORMANCE", None, [PY], "Synchronous blocking calls inside async functions stall the event loop."),
    ("ASYNC002", "Missing Await on Coroutine", "CRITICAL", "CODE_SMELL", None, [PY], "Calling a coroutine without await creates a coroutine object that is never executed."),
    ("ASYNC003", "Sync open() in Async Function", "MAJOR", "PERFORMANCE", None, [PY], "Using synchronous open() for file I/O inside async functions blocks the event loop."),
    ("ASYNC004", "asyncio.sleep(0) Misuse", "MINOR", "PERFORMANCE", None, [PY], "asyncio.sleep(0) is a yield point — using it in a tight loop is a code smell."),
    ("TAINT001", "Taint Flow Detected", "CRITICAL", "SECURITY", "A03", [PY], "Untrusted data reaches a security-sensitive call."),
    ("DEP001", "Vulnerable Dependency", None, "DEPENDENCY", "A06", [], "A declared package version has a known advisory."),
    ("DEP002", "Unused Dependency", "MINOR", "DEPENDENCY", None, [], "A declared package is never imported."),
    ("DEP003", "Undeclared Dependency", "MAJOR", "DEPENDENCY", None, [], "An imported package is not declared."),
]

SCHEMA = (
    "rule_id string, rule_name string, severity string, category string, owasp_category string, "
    "languages array<string>, description string"
)


def rule_catalog(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """All finding kinds, plus user rules given as rows of the same shape. A few dozen rows, safe to broadcast."""
    rows = [(i, n, s, c, OWASP.get(o, o) if o else None, langs, d) for i, n, s, c, o, langs, d in RULES + (extra or [])]
    return spark.createDataFrame(rows, SCHEMA)


def rules_summary(catalog: DataFrame) -> DataFrame:
    """The catalogue as listed to users: languages joined, absent label as ''."""
    return catalog.select(
        "rule_id", F.col("rule_name").alias("name"), "description", F.coalesce("severity", F.lit("")).alias("severity"),
        "category", F.coalesce("owasp_category", F.lit("")).alias("owasp_category"),
        F.array_join("languages", ", ").alias("languages"),
    )


def with_metadata(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach name, severity, category and label to hits."""
    meta = catalog.select("rule_id", "rule_name", "severity", "category", "owasp_category")
    return hits.join(F.broadcast(meta), "rule_id")


def rule_runs(catalog: DataFrame) -> DataFrame:
    """(rule_id, language) pairs a rule runs for."""
    return catalog.select("rule_id", F.explode("languages").alias("language"))
