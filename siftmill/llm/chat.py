"""Chat formatting whose output can be read back: render, reparse, compare, and escape what conflicts.

Template: each turn is ``### <role>: <text></turn>`` and a line end.
A conversation is rendered plainly first; if the parser doesn't give back exactly its turns, or a text holds a control
string, its turns are rendered again with escapes. ``escape`` leaves no control string and no backslash of its own behind, so
the second form always comes back; a conversation for which even that failed would raise an error.

Null texts and roles are empty; turns sort by number (nulls first), then role, then text; repeated rows are turns of
their own; rows with a null conv_id are one conversation; an empty table gives no rows. Other columns are not read. A
conversation is the unit of the result, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", "</turn>\n"
#: Escapes in order; undone in reverse. A backslash is always written as one of these.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
#: In roles the separator is escaped too.
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))
#: Role whose texts the loss mask covers.
LEARNED = "assistant"


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(text, pairs)


def unescape(text: Column, pairs=ESCAPES) -> Column:
    """Undo ``escape``: control strings first, the backslash last, when no other backslash can arise."""
    return _replaced(text, [(new, old) for old, new in reversed(pairs)])


def render(turns: Column, escaped: bool) -> Column:
    """``turns`` (array of role, text) as one string."""

    def one(t: Column) -> Column:
        return F.concat(F.lit(HEAD), escape(t["role"], ROLE_ESCAPES) if escaped else t["role"], F.lit(SEP), escape(t["text"]) if escaped else t["text"], F.lit(END))

    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """Turns of a rendered string: role, text, and ``start`` and ``length`` of the text as it is written (code points, from 0).

    Deterministic: a turn ends at the first end mark; its role ends at the first separator.
    """
    chunks = F.split(rendered, "\\Q" + END + "\\E")
    chunks = F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0)))

    def one(c: Column) -> Column:
        at = F.locate(SEP, c)
        role, text = F.substring(c, F.lit(len(HEAD) + 1), at - len(HEAD) - 1), F.substring(c, at + len(SEP), F.length(c))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"), (at + len(SEP) - 1).alias("lead"), F.length(text).alias("length"), F.length(c).alias("size"))

    def place(done: Column, t: Column) -> Column:
        return F.struct((done["at"] + t["size"] + len(END)).alias("at"), F.array_append(done["turns"], F.struct(t["role"].alias("role"), t["text"].alias("text"), (done["at"] + t["lead"]).alias("start"), t["length"].alias("length"))).alias("turns"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,text:string,start:int,length:int>>").alias("turns"))
    return F.aggregate(F.transform(chunks, one), none, place, lambda done: done["turns"])


def _pairs(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped, and ``turns`` as parsed from ``formatted``; spans of learned turns are the loss mask."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source")).withColumn("source", _pairs(F.col("source")))
    plain = whole.withColumn("formatted", render(F.col("source"), False)).withColumn("turns", parse(F.col("formatted")))
    control = F.exists("source", lambda t: t["text"].contains(HEAD.strip()) | t["text"].contains(END.strip()) | t["role"].contains(HEAD.strip()))
    plain = plain.withColumn("escaped", control | ~_pairs(F.col("turns")).eqNullSafe(F.col("source")))
    again = plain.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("formatted")))
    again = again.withColumn("turns", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("turns")))
    same = _pairs(F.col("turns")).eqNullSafe(F.col("source"))
    checked = again.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation did not come back from its rendered form")).cast("string")))
    return checked.select("conv_id", "formatted", "escaped", "turns")


def loss_text(formatted: Column, turns: Column) -> Column:
    """What the loss mask covers in ``formatted``, each learned text once, in order, unescaped."""
    learned = F.filter(turns, lambda t: t["role"] == LEARNED)
    return F.array_join(F.transform(learned, lambda t: unescape(F.substring(formatted, t["start"] + 1, t["length"]))), "")
