"""Text kernels as Column expressions: line splitting, stripping, snippets, offsets, token volume."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of Python's str.splitlines, as a Java character class.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_ENDS_WITH_BREAK = r"(?s).*[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_BLANK = r"[\s\x1C-\x1F]"


def uregex(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with Unicode-aware classes, as in Python's ``re`` on text."""
    flags = "(?iU)" if ignore_case else "(?U)"
    if pattern.startswith("(?i)"):
        return "(?iU)" + pattern[4:]
    return flags + pattern


def any_of(words: list[str]) -> str:
    """A literal alternation, used as a cheap file-level gate in front of the expensive patterns."""
    return "(?iu)" + "|".join(re.escape(w) for w in words)


def may_name(text: Column, words: list[str], in_strings: bool = False) -> Column:
    """False only where no identifier (or, ``in_strings``, no literal) of a Python text can spell one of ``words``.

    Identifiers outside ASCII are folded by the parser; literals may hold escapes or be joined from adjacent ones.
    Texts where that can happen pass.
    """
    joined = r"""|\\|["'](?:\s++|#[^\n]*+\n)*+[a-zA-Z]{0,2}["']""" if in_strings else ""
    return text.rlike(any_of(words) + r"|[^\x00-\x7F]" + joined)


def split_lines(text: Column) -> Column:
    """``array<string>`` of lines; the break after the last line opens no new one, empty text has no lines."""
    parts = F.split(text, LINE_BREAK, -1)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(text.rlike(f"^{_ENDS_WITH_BREAK}$"), F.slice(parts, F.lit(1), F.size(parts) - 1))
        .otherwise(parts)
    )


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def starts_trimmed(line: Column, prefixes: list[str]) -> Column:
    """True when the stripped line starts with one of ``prefixes``; a single anchored match, no copy of the line."""
    alternatives = "|".join(re.escape(p) for p in prefixes)
    return line.rlike(f"(?U)^{_BLANK}*(?:{alternatives})")


def is_blank(line: Column) -> Column:
    return line.rlike(f"(?U)^{_BLANK}*$")


def occurrences(text: Column, char: str) -> Column:
    """Number of times a single character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def snippet(lines: Column, line_no: Column, context: int = 2) -> Column:
    """The lines around ``line_no``, numbered, the line itself marked. Out-of-range parts are left out."""
    first = F.greatest(F.lit(1), line_no - context)
    last = F.least(F.size(lines), line_no + context)
    window = F.slice(lines, first, F.greatest(F.lit(0), last - first + 1))
    marked = F.transform(
        window,
        lambda text, i: F.concat(
            F.when(i + first == line_no, F.lit(">>> ")).otherwise(F.lit("    ")),
            (i + first).cast("string"),
            F.lit(": "),
            text,
        ),
    )
    return F.array_join(marked, "\n")


def match_lines(text: Column, pattern: str) -> Column:
    """Line number (newlines before the match, plus one) of every match of ``pattern`` in a whole text.

    A mark is set before each match and counted per line, so the work is linear in the text.
    """
    mark, other = "\x01", "\x02"
    marked = F.regexp_replace(F.replace(text, F.lit(mark), F.lit(other)), F.lit(pattern), F.lit(mark + "$0"))
    return F.flatten(
        F.transform(F.split(marked, "\n", -1), lambda line, i: F.array_repeat(i + 1, occurrences(line, mark)))
    )


def token_volume(text: Column) -> Column:
    """N * log2(n) over identifier and single-symbol tokens, at least 1."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)[a-zA-Z_]\w*|[^\s\w]"), F.lit(0))
    total, kinds = F.size(tokens), F.size(F.array_distinct(tokens))
    return F.greatest(F.lit(1.0), total * F.log2(F.greatest(kinds, F.lit(1)).cast("double")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sum(values: Column) -> Column:
    """Sums of an integer array up to each element.

    Appending copies an array, so sums run inside blocks of about the root of its length, then over the blocks.
    """
    none = F.array().cast("array<int>")

    def within(block: Column) -> Column:
        state = F.struct(F.lit(0).alias("sum"), none.alias("all"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"] + x).alias("all"))
        return F.aggregate(block, state, step, lambda acc: acc["all"])

    def cut(given: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(given))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(F.size(given), F.lit(1)), width)
        blocks = F.transform(starts, lambda s: within(F.slice(given, s, width)))
        return let(blocks, lambda b: let(within(F.transform(b, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0)))), lambda ends: F.flatten(
            F.transform(b, lambda x, k: F.transform(x, lambda v: v + F.when(k > 0, F.get(ends, k - 1)).otherwise(0))))))

    return let(values, cut)
