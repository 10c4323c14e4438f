"""Batch table of review prompts for findings. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Neutral wording, in the order it is applied, and the prompt text.
NEUTRAL = {
    "injection": "unsanitized input",
    "sql injection": "unsanitized query input",
    "xss": "unescaped output",
    "cross-site scripting": "unescaped output",
    "command injection": "unsanitized command input",
    "code injection": "unsanitized code input",
    "ldap injection": "unsanitized directory input",
}
PROMPT = """\
You are a senior software engineer reviewing code quality findings.
A static analysis tool flagged the following issue:

Rule     : {rule_id} — {rule_name}
File     : {file}:{line}
Category : {category}
Message  : {message}
{owasp_line}
Code snippet:
{code_snippet}

Provide a concise, actionable recommendation to fix this issue.
- 2–4 sentences max.
- Include a corrected code snippet if helpful.
- Focus only on the fix, do not repeat the problem description.
"""


def neutral(text: Column) -> Column:
    """Replace each term as written, in capitals and in title case, one term after the other."""
    for term, other in NEUTRAL.items():
        for case in (str, str.upper, str.title):
            text = F.replace(text, F.lit(case(term)), F.lit(case(other)))
    return text


def prompts(issues: DataFrame) -> DataFrame:
    """(issue_id, prompt) for every issue given."""
    label = F.coalesce(F.concat(F.lit("Standard : "), F.substring_index("owasp_category", "-", 1)), F.lit(""))
    values = {
        "rule_id": F.col("rule_id"), "rule_name": neutral(F.col("rule_name")), "file": F.col("file"), "line": F.col("line").cast("string"),
        "category": F.col("category"), "message": neutral(F.col("message")), "owasp_line": label,
        "code_snippet": F.coalesce(F.when(F.col("code_snippet") != "", F.col("code_snippet")), F.lit("(not available)")),
    }
    parts, rest = [], PROMPT
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), F.coalesce(value, F.lit(""))]
    return issues.select("issue_id", F.concat(*parts, F.lit(rest)).alias("prompt"))
