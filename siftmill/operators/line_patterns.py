"""Fixed values of the text detectors: patterns in match order, messages and suggestions."""

SEC003 = [
    (r"""(?i)(password|passwd|pwd)\s*=\s*["'][^"']+["']""", "Hardcoded password detected"),
    (r"""(?i)(api_key|apikey|api_secret)\s*=\s*["'][^"']+["']""", "Hardcoded API key detected"),
    (r"""(?i)(secret_key|secretkey|secret)\s*=\s*["'][^"']+["']""", "Hardcoded secret key detected"),
    (r"""(?i)(token|auth_token|access_token)\s*=\s*["'][^"']+["']""", "Hardcoded token detected"),
    (r"""(?i)(private_key|priv_key)\s*=\s*["'][^"']+["']""", "Hardcoded private key detected"),
    (r"""(?i)(aws_access_key_id|aws_secret_access_key)\s*=\s*["'][^"']+["']""", "Hardcoded AWS credential"),
    (r"""(?i)(db_password|database_password)\s*=\s*["'][^"']+["']""", "Hardcoded database password"),
]
SEC011 = [
    (r"verify\s*=\s*False", "SSL certificate verification disabled — man-in-the-middle attack risk."),
    (r"ssl\.CERT_NONE", "SSL certificate validation set to CERT_NONE — man-in-the-middle attack risk."),
    (r"ssl\.PROTOCOL_SSLv2|ssl\.PROTOCOL_SSLv3|ssl\.PROTOCOL_TLSv1\b",
     "Deprecated/insecure SSL/TLS protocol version — man-in-the-middle attack risk."),
    (r"check_hostname\s*=\s*False", "SSL hostname check disabled — man-in-the-middle attack risk."),
    (r"VERIFY_NONE", "SSL verification disabled — man-in-the-middle attack risk."),
]
SEC013 = [
    (r"(?:logging|logger|log)\.\w+\s*\([^)]*(?:password|passwd|token|secret|key|credential)",
     "Potentially sensitive data being logged."),
    (r"print\s*\([^)]*(?:password|passwd|token|secret|api_key)", "Potentially sensitive data being logged."),
]
ROUTES = [
    r"@app\.(?:route|get|post|put|delete|patch)\s*\(",
    r"@router\.(?:get|post|put|delete|patch)\s*\(",
    r"@blueprint\.(?:route|get|post|put|delete|patch)\s*\(",
]
ROUTE_AUTH = [
    r"@(?:login_required|require_auth|jwt_required|requires_auth|auth\.login_required|Depends\(get_current_user\))",
    r"Depends\s*\(",
    r"@permission_required",
]

JSEC001 = [
    (r"""\.innerHTML\s*=\s*(?!['"]\s*['"])""", "innerHTML assigned with dynamic value — XSS risk"),
    (r"""\.outerHTML\s*=\s*(?!['"]\s*['"])""", "outerHTML assigned with dynamic value — XSS risk"),
    (r"document\.write\s*\(", "document.write() can lead to XSS"),
    (r"document\.writeln\s*\(", "document.writeln() can lead to XSS"),
    (r"\beval\s*\(", "eval() executes arbitrary code — code injection risk"),
    (r"new\s+Function\s*\(", "new Function() executes arbitrary code — code injection risk"),
    (r"""setTimeout\s*\(\s*[`'"]""", "setTimeout with string argument executes arbitrary code"),
    (r"""setInterval\s*\(\s*[`'"]""", "setInterval with string argument executes arbitrary code"),
    (r"dangerouslySetInnerHTML", "React dangerouslySetInnerHTML — XSS risk if unsanitized"),
]
JSEC002 = [
    (r"""(?i)(password|passwd|pwd)\s*[:=]\s*["'][^"']{4,}["']""", "Hardcoded password detected in source code."),
    (r"""(?i)(api_key|apiKey|api_secret|apiSecret)\s*[:=]\s*["'][^"']{8,}["']""", "Hardcoded API key detected in source code."),
    (r"""(?i)(secret|secretKey|secret_key)\s*[:=]\s*["'][^"']{8,}["']""", "Hardcoded secret detected in source code."),
    (r"""(?i)(token|authToken|auth_token|accessToken|access_token)\s*[:=]\s*["'][^"']{8,}["']""", "Hardcoded token detected in source code."),
    (r"""(?i)(aws_access_key|aws_secret)\s*[:=]\s*["'][^"']+["']""", "Hardcoded AWS credential detected in source code."),
    (r"""(?i)private_key\s*[:=]\s*["'][^"']{8,}["']""", "Hardcoded private key detected in source code."),
    (r"""(?i)(db_pass|database_password|dbpassword)\s*[:=]\s*["'][^"']+["']""", "Hardcoded DB password detected in source code."),
]
JSEC003 = [(r"\bMath\.random\s*\(", "Math.random() is not cryptographically secure.")]
_POLLUTION = "Potential prototype pollution — __proto__ or prototype manipulation detected."
JSEC004 = [
    (r"""\[['"__proto__'"]\]""", _POLLUTION),
    (r"__proto__\s*[=:]", _POLLUTION),
    (r"Object\.assign\s*\(\s*\w+\.prototype", _POLLUTION),
    (r"constructor\s*\.\s*prototype\s*\[", _POLLUTION),
]
_TRAVERSAL = "Potential path traversal — file operation with user-controlled path."
JSEC005 = [
    (r"""(?:fs|require\(['"]fs['"]\))\s*\.\s*(?:readFile|writeFile|readFileSync|writeFileSync|unlink|rmdir)\s*\(\s*(?:req\.|params\.|query\.|body\.)""", _TRAVERSAL),
    (r"path\.join\s*\([^)]*(?:req\.|params\.|query\.|body\.)", _TRAVERSAL),
    (r"path\.resolve\s*\([^)]*(?:req\.|params\.|query\.|body\.)", _TRAVERSAL),
    (r"""__dirname\s*\+\s*[^"']+(?:req\.|params\.|query\.)""", _TRAVERSAL),
]
JSEC006 = [
    (r"jwt\.verify\s*\([^)]*algorithms\s*:\s*\[[^\]]*none", "JWT 'none' algorithm — authentication bypass"),
    (r"jwt\.decode\s*\((?!.*verify)", "jwt.decode() without verification — token not validated"),
    (r"verify\s*:\s*false", "JWT verification disabled"),
    (r"ignoreExpiration\s*:\s*true", "JWT expiration check disabled"),
]
_NOSQL = "Potential NoSQL injection — query built with user-controlled input."
JSEC007 = [
    (r"\.find\s*\(\s*(?:req\.|params\.|query\.|body\.)", _NOSQL),
    (r"\.findOne\s*\(\s*(?:req\.|params\.|query\.|body\.)", _NOSQL),
    (r"\.update\s*\(\s*(?:req\.|params\.|query\.|body\.)", _NOSQL),
    (r"\.deleteOne\s*\(\s*(?:req\.|params\.|query\.|body\.)", _NOSQL),
    (r"\$where\s*:\s*(?:req\.|params\.|query\.|body\.)", _NOSQL),
]
JSEC008 = [
    (r"""Access-Control-Allow-Origin['"\s]*:\s*['"]?\*""", "Wildcard CORS origin allows any domain"),
    (r"""origin\s*:\s*['"]?\*['"]?""", "CORS origin set to wildcard '*'"),
    (r"cors\s*\(\s*\)", "cors() called without configuration — defaults to wildcard"),
    (r"""Access-Control-Allow-Credentials['"\s]*:\s*['"]?true""", "CORS credentials allowed — verify origin is not wildcard"),
]
JSEC009 = [
    (r"\bconsole\.(log|debug|info|warn|error)\s*\(", "console statement leaks information — remove before production deployment."),
    (r"\bdebugger\b", "debugger statement left in code — remove before production deployment."),
]
JSEC010 = [
    (r"(?:new\s+RegExp|/)[^/]*(?:\+|\*|\{[0-9,]+\})[^/]*(?:\+|\*|\{[0-9,]+\})[^/]*/[gimsuy]*",
     "Potentially vulnerable regex — nested quantifiers may cause catastrophic backtracking (ReDoS)."),
]
_REDIRECT = "Potential open redirect — redirect target may be user-controlled."
JSEC011 = [
    (r"res\.redirect\s*\(\s*(?:req\.|params\.|query\.|body\.)", _REDIRECT),
    (r"window\.location\s*=\s*(?:req\.|params\.|query\.|body\.|[a-zA-Z_$]\w*(?:Url|URL|Redirect|redirect))", _REDIRECT),
    (r"location\.href\s*=\s*(?:req\.|params\.|query\.|body\.)", _REDIRECT),
]
EXPRESS = r"""(?:require\(['"]express['"]\)|from\s+['"]express['"])"""
HELMET = r"""(?:require\(['"]helmet['"]\)|from\s+['"]helmet['"]|app\.use\s*\(\s*helmet)"""
_SSRF = "Potential SSRF — HTTP request with user-controlled URL."
JSEC013 = [
    (r"(?:fetch|axios\.get|axios\.post|http\.get|https\.get|request\.get)\s*\(\s*(?:req\.|params\.|query\.|body\.|`[^`]*\$\{)", _SSRF),
    (r"(?:fetch|axios)\s*\(\s*(?:req\.|params\.|query\.|body\.)", _SSRF),
]

SQL001 = [(r"\bEXEC(UTE)?\s*\(", "Dynamic SQL via EXEC() detected — potential SQL injection.")]
SQL002 = [(r"\bSELECT\s+\*", "SELECT * used — explicitly list required columns instead.")]
SQL_DELETE_ALL = r"\bDELETE\s+FROM\s+\w+\s*;"
SQL_UPDATE_HEAD = r"\bUPDATE\s+\w+\s+SET\b"
SQL004 = [(r"""(?i)(password|pwd|passwd)\s*=\s*['"][^'"]+['"]""", "Hardcoded credential detected in SQL file.")]
SQL_DML = r"\b(INSERT|UPDATE|DELETE)\b"
SQL_TRANSACTION = r"\b(BEGIN|COMMIT|ROLLBACK|TRANSACTION)\b"

_CS_SQL = "Potential SQL injection via string concatenation/interpolation."
CS_SEC001 = [
    (r"""("|\+)\s*(SELECT|INSERT|UPDATE|DELETE|DROP|EXEC)\b.*(\+|")""", _CS_SQL),
    (r"string\.(Format|Concat)\s*\(.*\b(SELECT|INSERT|UPDATE|DELETE)\b", _CS_SQL),
    (r"""\$"[^"]*\b(SELECT|INSERT|UPDATE|DELETE|DROP)\b""", _CS_SQL),
]
_CS_SECRET = "Hardcoded secret/credential detected in C# code."
CS_SEC002 = [
    (r"""(?i)(password|passwd|pwd)\s*=\s*"[^"]+\"""", _CS_SECRET),
    (r"""(?i)(apikey|api_key|secret|token)\s*=\s*"[^"]+\"""", _CS_SECRET),
    (r"""(?i)connectionstring\s*=\s*"[^"]*password=[^"]+\"""", _CS_SECRET),
    (r"""(?i)(aws_access_key|aws_secret)\s*=\s*"[^"]+\"""", _CS_SECRET),
]
CS_SEC003 = [
    (r"\b(MD5|SHA1|DESCryptoServiceProvider|RC2CryptoServiceProvider|TripleDES)\b|new\s+(MD5CryptoServiceProvider|SHA1Managed)\s*\(",
     "Weak cryptographic algorithm detected (MD5/SHA1/DES/RC2)."),
]
CS_CATCH = r"\bcatch\b\s*(\([^)]*\))?\s*\{"
CS_SEC005 = [
    (r"\b(Console\.Write(Line)?|Debug\.Write(Line)?|Trace\.Write(Line)?)\s*\(",
     "Debug/Console output statement found — should not be in production code."),
]
CS_SEC006 = [
    (r"Process\.Start\s*\(",
     "Process.Start() detected — potential command injection if arguments are user-controlled."),
]
CS_SEC007 = [
    (r"\b(BinaryFormatter|JavaScriptSerializer|LosFormatter|ObjectStateFormatter)\b",
     "Insecure deserializer detected — vulnerable to remote code execution."),
]

JSCS002 = [(r"^\s*var\s+\w+", "Use of 'var' — prefer 'const' or 'let' for block scoping.")]
JSCS003 = [(r"(?<![=!<>])={2}(?!=)", "Loose equality (==) used — may cause unexpected type coercion.")]
JS_EMPTY_CATCH = r"catch\s*\([^)]*\)\s*\{\s*\}"
JSCS005 = [
    (r"\bconsole\.(log|debug|info)\s*\(", "console statement found — remove before production deployment."),
]
JSCS006 = [
    (r"\.then\s*\([^)]*\)\s*(?!\.catch)", "Promise .then() without .catch() — unhandled rejection risk."),
]
MAGIC_NUMBER = r"(?<![.\w])(?!0x)([2-9]\d{2,}|\d{4,})(?![\w.])"

# JavaScript structure, in match order.
JS_FUNCTIONS = [
    r"(?:async\s+)?function\s+(\w+)\s*\(",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(?.*?\)?\s*=>",
    r"(\w+)\s*:\s*(?:async\s+)?function\s*\(",
]
JS_CLASS = r"class\s+(\w+)"
JS_IMPORT = r"^\s*(import|require)\b"
JS_CALL = r"(\w+(?:\.\w+)*)\s*\("
JS_CALL_KEYWORDS = ["if", "for", "while", "switch", "catch", "function", "return", "class"]
JS_VARIABLE = r"(?:const|let|var)\s+(\w+)\s*="
JS_METRIC_FUNCTIONS = [
    r"(?:async\s+)?function\s+(\w+)\s*\(",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function",
    r"(\w+)\s*\([^)]*\)\s*\{",
]
JS_METRIC_KEYWORDS = ["if", "for", "while", "switch", "catch", "class"]
JS_DECISIONS = [
    r"\bif\s*\(",
    r"\belse\s+if\s*\(",
    r"\bfor\s*\(",
    r"\bwhile\s*\(",
    r"\bcase\s+",
    r"\bcatch\s*\(",
    r"\?\s*[^:]+\s*:",
    r"&&",
    r"\|\|",
]

MESSAGES = {
    "SEC012": "Route defined without visible authentication decorator.",
    "JSEC012": "Express app detected without helmet — security headers not set.",
    "SQL003_DELETE": "DELETE FROM without WHERE clause — will delete all rows.",
    "SQL003_UPDATE": "UPDATE without WHERE clause — will update all rows.",
    "CS_SEC004": "Empty catch block — exception is silently swallowed.",
    "JSCS004": "Empty catch block — errors are silently swallowed.",
}

SUGGEST = {
    "SEC003": "Use environment variables or a secrets manager instead of hardcoding secrets.",
    "SEC011": "Always verify SSL certificates. Use verify=True and keep TLS version >= 1.2.",
    "SEC012": "Add authentication: @login_required, @jwt_required, or FastAPI Depends(get_current_user).",
    "SEC013": "Never log passwords, tokens, or secrets. Mask or redact sensitive fields.",
    "JSEC001": "Sanitize user input with DOMPurify or use textContent instead of innerHTML.",
    "JSEC002": "Use environment variables (process.env.SECRET) or a secrets manager.",
    "JSEC003": "Use crypto.getRandomValues() or the Web Crypto API for security-sensitive randomness.",
    "JSEC004": "Validate and sanitize object keys. Use Object.create(null) for safe maps.",
    "JSEC005": "Validate and sanitize file paths. Use path.resolve() and verify the result stays within allowed directories.",
    "JSEC006": "Always verify JWT signatures with a strong algorithm (RS256/ES256). Never use 'none' algorithm.",
    "JSEC007": "Sanitize and validate all query inputs. Use mongoose schema validation.",
    "JSEC008": "Restrict CORS to specific trusted origins. Never combine wildcard origin with credentials.",
    "JSEC009": "Remove debug statements. Use a proper logging library with log levels.",
    "JSEC010": "Simplify the regex or use a safe regex library. Test with tools like safe-regex.",
    "JSEC011": "Validate redirect URLs against an allowlist of trusted domains.",
    "JSEC012": "Add `const helmet = require('helmet'); app.use(helmet());` to set security headers.",
    "JSEC013": "Validate and whitelist URLs. Block requests to internal IP ranges (169.254.x.x, 10.x.x.x, etc.).",
    "SQL001": "Use sp_executesql with parameters instead of EXEC with concatenated strings.",
    "SQL002": "Replace SELECT * with explicit column names to improve performance and clarity.",
    "SQL003": "Add a WHERE clause to limit the rows affected.",
    "SQL004": "Use environment variables or a secrets manager for credentials.",
    "SQL005": "Wrap multiple DML statements in a transaction to ensure atomicity.",
    "CS_SEC001": "Use parameterized queries (SqlParameter) or an ORM like Entity Framework.",
    "CS_SEC002": "Use environment variables, IConfiguration, or Azure Key Vault for secrets.",
    "CS_SEC003": "Use SHA256, SHA512, or AES (AesCryptoServiceProvider) instead.",
    "CS_SEC004": "Log the exception or handle it explicitly. Never silently ignore exceptions.",
    "CS_SEC005": "Use a proper logging framework (ILogger, Serilog, NLog) instead of Console/Debug output.",
    "CS_SEC006": "Validate and sanitize all inputs before passing to Process.Start(). Avoid shell execution.",
    "CS_SEC007": "Use System.Text.Json or Newtonsoft.Json with TypeNameHandling.None instead.",
    "JSCS001": "Break complex functions into smaller, focused functions.",
    "JSCS002": "Replace 'var' with 'const' (if not reassigned) or 'let'.",
    "JSCS003": "Use strict equality (===) to avoid type coercion bugs.",
    "JSCS004": "Log the error or handle it appropriately. Never silently ignore exceptions.",
    "JSCS005": "Use a proper logging library (winston, pino) with configurable log levels.",
    "JSCS006": "Add .catch() handler or use async/await with try/catch.",
    "JSCS007": "Extract magic numbers into named constants for readability.",
    "JSCS008": "Reduce nesting with early returns, guard clauses, or extracted functions.",
}
