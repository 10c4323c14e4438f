"""Untrusted-data flow: which sink calls receive data from a source through assignments.

Leaf expressions are tied to the assignments and calls they feed by walking up their own ancestor chain (narrow).
The rows of one file are then brought together, sorted by their breadth-first node number, and folded as they stream by, with
the set of tainted names as state: one shuffle by file, no group held in memory, no driver loop. The fold is the one
Python step (Arrow batches of slim rows): SQL has no set that grows in place, and copying it per event is quadratic.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.text import may_name
from siftmill.operators.facts import syntax_facts
from siftmill.schemas import HIT_COLUMNS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Sources, and sinks with their labels in match order.
SOURCES = [
    "request.args", "request.form", "request.data", "request.json", "request.values", "request.files",
    "request.cookies", "request.headers", "request.GET", "request.POST", "request.body", "input", "os.environ",
    "os.getenv", "os.environ.get", "open", "read", "readline", "readlines", "sys.argv", "sys.stdin",
]
SINKS = {
    "cursor.execute": "SQL Injection",
    "execute": "SQL Injection",
    "executemany": "SQL Injection",
    "raw": "SQL Injection (Django ORM raw query)",
    "os.system": "OS Command Injection",
    "os.popen": "OS Command Injection",
    "subprocess.call": "OS Command Injection",
    "subprocess.run": "OS Command Injection",
    "subprocess.Popen": "OS Command Injection",
    "eval": "Code Injection via eval()",
    "exec": "Code Injection via exec()",
    "compile": "Code Injection via compile()",
    "pickle.loads": "Unsafe Deserialization",
    "pickle.load": "Unsafe Deserialization",
    "yaml.load": "Unsafe YAML Deserialization",
    "marshal.loads": "Unsafe Deserialization",
    "render_template_string": "Server-Side Template Injection",
    "Template": "Server-Side Template Injection",
    "requests.get": "Potential SSRF",
    "requests.post": "Potential SSRF",
    "urllib.request.urlopen": "Potential SSRF",
    "httpx.get": "Potential SSRF",
    "write": "Arbitrary File Write",
}
EXTENDED_SOURCES = [f"{s}.get" for s in SOURCES if s.startswith("request.")]

# Words one of which is in every file with a source, and in every file with a sink.
SOURCE_WORDS = ["request", "input", "environ", "getenv", "open", "read", "argv", "stdin"]
SINK_WORDS = [
    "execute", "raw", "system", "popen", "subprocess", "eval", "exec", "compile", "pickle", "yaml", "marshal",
    "render_template_string", "template", "request", "urllib", "httpx", "write",
]

LEAF_TYPES = ["Name", "Attribute", "Call", "Subscript"]
NODE_TYPES = [*LEAF_TYPES, "Assign", "AugAssign"]
#: Node types whose children the flow reads: what they assign to.
CHANGES = ["Assign", "AugAssign"]
_CARRY = ["BinOp.left", "BinOp.right", "JoinedStr.values", "FormattedValue.value"]
_VALUE = ["Assign.value", "AugAssign.value"]
#: Edges to its parent by which a leaf feeds anything; the ancestors of other leaves are not read.
FEEDS = [*_CARRY, *_VALUE, "Call.args", "keyword.value"]


#: Columns of the facts that the flow reads.
READ = ["project_id", "path", "node_id", "node_type", "lineno", "col", "name", "strict", "base", "parent_type", "parent_field",
        "ancestors.id", "ancestors.edge", "children.field", "children.strict"]


def flow_facts(files: DataFrame) -> DataFrame:
    """Facts of which the flow is made, and no others: leaves that feed something, calls and changes, as much of each as is read."""
    return syntax_facts(files, NODE_TYPES, children=CHANGES, chained={t: FEEDS for t in LEAF_TYPES},
                        edges={t: FEEDS for t in LEAF_TYPES if t != "Call"}, columns=READ)


def is_source(name: Column, sources: list[str] | None = None) -> Column:
    """The dotted name ends with a source; the match is not anchored at a dot."""
    test = F.lit(False)
    for source in sources or SOURCES:
        test = test | name.endswith(source)
    return F.coalesce(test, F.lit(False))


def may_flow(text: Column) -> Column:
    """False only for texts that cannot hold both a source and a sink; a test ahead of parsing."""
    return may_name(text, SOURCE_WORDS) & may_name(text, SINK_WORDS)


def sink_label(name: Column) -> Column:
    """Label of the first sink that equals the name or its dotted tail; NULL when none does."""
    out = None
    for sink, label in SINKS.items():
        test = (name == sink) | name.endswith("." + sink)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def source_nodes(facts: DataFrame) -> DataFrame:
    """Attributes and calls whose own name is a source."""
    return facts.filter(F.col("node_type").isin("Attribute", "Call") & is_source(F.col("strict"))).select(
        "project_id", F.col("path").alias("file"), F.col("lineno").alias("line"), "node_type", F.col("strict").alias("name")
    )


def sink_calls(facts: DataFrame) -> DataFrame:
    return (
        facts.filter(F.col("node_type") == "Call").withColumn("label", sink_label(F.col("strict")))
        .filter(F.col("label").isNotNull())
        .select("project_id", F.col("path").alias("file"), "node_id", F.col("lineno").alias("line"),
                F.col("col").alias("column"), F.col("strict").alias("name"), "label")
    )


def _fed_events(chain: Column) -> Column:
    """Events fed by a leaf: ``array<struct<id,channel>>``, from its ancestors walked upwards.

    Data is carried through calls' positional arguments, binary operations and f-strings; an assignment value or a
    keyword argument ends the walk, anything else breaks it.
    """
    kinds = "array<struct<id:int,channel:string>>"
    start = F.struct(F.lit("carry").alias("mode"), F.array().cast(kinds).alias("fed"))

    def step(acc: Column, a: Column) -> Column:
        carry, edge = acc["mode"] == "carry", a["edge"]
        channel = (
            F.when(carry & (edge == "Call.args"), "args").when(carry & edge.isin(_VALUE), "value")
            .when((acc["mode"] == "keyword") & (edge == "Call.keywords"), "keywords")
        )
        mode = (
            F.when(carry & edge.isin([*_CARRY, "Call.args"]), "carry").when(carry & (edge == "keyword.value"), "keyword")
            .otherwise("done")
        )
        event = F.struct(a["id"].alias("id"), channel.alias("channel"))
        fed = F.when(channel.isNotNull(), F.array_append(acc["fed"], event)).otherwise(acc["fed"])
        return F.when(acc["mode"] == "done", acc).otherwise(F.struct(mode.alias("mode"), fed.alias("fed")))

    return F.aggregate(F.reverse(chain), start, step, lambda acc: acc["fed"])


_ROW = (
    "struct<event_id:int,channel:string,direct:boolean,var:string,kind:string,targets:array<string>,line:int,"
    "column:int,name:string,label:string>"
)


def _row(event: Column, channel: Column | None = None, direct: Column | None = None, var: Column | None = None, **own: Column) -> Column:
    none = F.lit(None)
    fields = {"event_id": event, "channel": channel, "direct": direct if direct is not None else F.lit(False), "var": var}
    fields |= {name: own.get(name) for name in ("kind", "targets", "line", "column", "name", "label")}
    return F.struct(*[(none if c is None else c).alias(n) for n, c in fields.items()]).cast(_ROW)


def flow_rows(facts: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """One pass over the facts: what leaves bring to events (channel set), and the events themselves (kind set)."""
    parent = F.concat_ws(".", "parent_type", "parent_field")
    kind, strict = F.col("node_type"), F.col("strict")
    var = (
        F.when(kind == "Name", F.col("name")).when(kind.isin("Attribute", "Subscript"), F.col("base"))
        .when((kind == "Call") & ~strict.contains("."), strict)
    )
    direct = kind.isin("Attribute", "Call") & is_source(strict, sources)
    feeds = kind.isin(LEAF_TYPES) & parent.isin(FEEDS) & (direct | var.isNotNull())
    fed = F.transform(_fed_events(F.col("ancestors")), lambda e: _row(e["id"], e["channel"], direct, var))
    named = F.transform(
        F.filter("children", lambda c: c["field"].isin("targets", "target") & c["strict"].isNotNull()), lambda c: c["strict"]
    )
    change = _row(F.col("node_id"), kind=F.lower(kind), targets=named, line=F.col("lineno"))
    sink = _row(F.col("node_id"), kind=F.lit("sink"), line=F.col("lineno"), column=F.col("col"), name=strict, label=sink_label(strict))
    none = F.array().cast(f"array<{_ROW}>")
    rows = F.concat(
        F.when(feeds, fed).otherwise(none),
        F.when(kind.isin("Assign", "AugAssign"), F.array(change)).when((kind == "Call") & sink_label(strict).isNotNull(), F.array(sink)).otherwise(none),
    )
    return facts.filter(kind.isin(NODE_TYPES)).select("project_id", "path", F.explode(rows).alias("r")).select("project_id", "path", "r.*")


def carried(facts: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(project_id, path, event_id, channel, direct, var): what each leaf brings to the event it feeds."""
    return flow_rows(facts, sources).filter(F.col("channel").isNotNull()).select("project_id", "path", "event_id", "channel", "direct", "var")


_FLOW = "project_id string, path string, event_id int, kind string, targets array<string>, line int, column int, name string, label string, by_value boolean, by_keyword boolean"


class _File:
    """The tainted names of one file, and what the event at hand has read so far."""

    def __init__(self) -> None:
        self.tainted: set[str] = set()
        self.event: int | None = None
        self.by_value = self.by_keyword = False


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcome of each event, from rows that come file by file and, in a file, by event: what it reads first, then itself.

    Each row looks at its own names only, so work is linear in what a file reads and assigns, however many names are tainted.
    """
    at, state = None, _File()
    for batch in batches:
        keep, values, keywords = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("project_id", "path", "event_id", "kind", "direct", "var", "channel", "targets")]
        for i, (project, path, event, kind, direct, var, channel, targets) in enumerate(zip(*columns, strict=True)):
            if (project, path) != at:
                at, state = (project, path), _File()
            if event != state.event:
                state.event, state.by_value, state.by_keyword = event, False, False
            if kind is None:
                if direct or var in state.tainted:
                    if channel == "keywords":
                        state.by_keyword = True
                    else:
                        state.by_value = True
                continue
            if kind != "sink" and state.by_value:
                state.tainted.update(targets or ())
            elif kind == "assign":
                state.tainted.difference_update(targets or ())
            keep.append(i)
            values.append(state.by_value)
            keywords.append(state.by_keyword)
        if keep:
            rows = batch.select(["project_id", "path", "event_id", "kind", "targets", "line", "column", "name", "label"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(values), pa.array(keywords)], names=[*rows.schema.names, "by_value", "by_keyword"])


def flow(facts: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Outcome per event: (…, kind, tainted by value or positional argument, tainted by keyword).

    One exchange by file and one sort; the fold streams over the rows, so no file is ever held as a list.
    """
    order = ["project_id", "path", "event_id", F.col("kind").asc_nulls_first()]
    rows = flow_rows(facts, sources).repartition("project_id", "path").sortWithinPartitions(*order)
    return rows.mapInArrow(_fold, _FLOW).withColumnRenamed("path", "file")


def tainted_definitions(facts: DataFrame) -> DataFrame:
    """Every assigned name with its taint right after the assignment."""
    rows = flow(facts).filter(F.col("kind") != "sink")
    return rows.select("project_id", "file", "line", "kind", F.explode("targets").alias("name"), F.col("by_value").alias("tainted"))


def taint_hits(facts: DataFrame, extended_sources: bool = False) -> DataFrame:
    """At most two hits per sink call: one for positional arguments, one for keyword arguments."""
    sources = [*SOURCES, *EXTENDED_SOURCES] if extended_sources else None
    rows = flow(facts, sources).filter((F.col("kind") == "sink") & (F.col("by_value") | F.col("by_keyword")))
    via = F.explode(F.filter(F.array(F.when(F.col("by_value"), ""), F.when(F.col("by_keyword"), " via keyword arg")), lambda v: v.isNotNull()))
    return rows.withColumn("via", via).select(
        "project_id", "file", "line", "column", F.lit("TAINT001").alias("rule_id"),
        F.concat(F.lit("Tainted data flows into "), F.col("name"), F.lit("()"), F.col("via"), F.lit(" — "), F.col("label")).alias("message"),
        F.concat(F.lit("Sanitize or validate the input before passing to "), F.col("name"), F.lit("().")).alias("suggestion"),
    ).select(*HIT_COLUMNS)


def definition_of_use(facts: DataFrame) -> DataFrame:
    """As-of join of each read of a name with the latest earlier assignment to it in the same file."""
    place = lambda var, is_def: F.struct(var.alias("var"), F.lit(is_def).alias("is_def"))
    touched = F.when(F.col("var").isNotNull(), F.array(place(F.col("var"), 0))).otherwise(
        F.transform(F.coalesce("targets", F.array().cast("array<string>")), lambda t: place(t, 1)))
    rows = flow_rows(facts).select("project_id", "path", "event_id", F.explode(touched).alias("t")).select(
        "project_id", "path", "event_id", "t.var", "t.is_def").repartition("project_id", "path", "var").distinct()
    # At one step a read comes before the write: an assignment reads the state it replaces.
    order = Window.partitionBy("project_id", "path", "var").orderBy("event_id", "is_def").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("latest", F.last(F.when(F.col("is_def") == 1, F.col("event_id")), ignorenulls=True).over(order)).filter("is_def = 0")
        .select("project_id", F.col("path").alias("file"), F.col("var").alias("name"), F.col("event_id").alias("use_id"),
                F.col("latest").alias("def_id"))
    )
