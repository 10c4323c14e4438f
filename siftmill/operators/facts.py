"""Syntax facts: Python text to one row per syntax node, with its parents and children on the row.

This is the only Python worker step. It parses with the standard library and writes down what the tree says;
it decides nothing. A row carries its chain of ancestors and the facts of its direct children, so detectors
that relate nodes are filters over single rows and need no self-join. The row types and the nested columns
that a plan needs are passed in, so a query that looks at calls only never ships other nodes to the JVM.
"""

from __future__ import annotations

import ast
import symtable
import sys
import warnings
from collections.abc import Iterable, Iterator, Mapping
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TEXT = pa.string()
_INT = pa.int32()
_CHILD_FIELDS = [
    ("field", _TEXT), ("pos", _INT), ("type", _TEXT), ("name", _TEXT), ("asname", _TEXT), ("dotted", _TEXT),
    ("strict", _TEXT), ("const_kind", _TEXT), ("const_value", _TEXT), ("lineno", _INT), ("seg", _TEXT),
    ("vtype", _TEXT), ("vname", _TEXT), ("vdotted", _TEXT), ("vconst_kind", _TEXT), ("vconst_value", _TEXT),
    ("vnone", pa.bool_()),
]
_ANCESTOR_FIELDS = [("id", _INT), ("type", _TEXT), ("name", _TEXT), ("lineno", _INT), ("edge", _TEXT)]
_SCALARS = [
    ("project_id", _TEXT), ("path", _TEXT), ("node_id", _INT), ("dfs_id", _INT), ("node_type", _TEXT),
    ("lineno", _INT), ("col", _INT), ("end_lineno", _INT), ("name", _TEXT), ("level", _INT), ("dotted", _TEXT),
    ("strict", _TEXT), ("base", _TEXT), ("op", _TEXT), ("arity", _INT), ("const_kind", _TEXT),
    ("const_value", _TEXT), ("seg", _TEXT), ("parent_type", _TEXT), ("parent_field", _TEXT),
]
_ARROW = pa.schema(
    [pa.field(n, t) for n, t in _SCALARS]
    + [pa.field("ancestors", pa.list_(pa.struct(_ANCESTOR_FIELDS))),
       pa.field("children", pa.list_(pa.struct(_CHILD_FIELDS)))]
)
SCHEMA = (
    "project_id string, path string, node_id int, dfs_id int, node_type string, lineno int, col int, "
    "end_lineno int, name string, level int, dotted string, strict string, base string, op string, arity int, "
    "const_kind string, const_value string, seg string, parent_type string, parent_field string, "
    "ancestors array<struct<id:int,type:string,name:string,lineno:int,edge:string>>, "
    "children array<struct<field:string,pos:int,type:string,name:string,asname:string,dotted:string,strict:string,"
    "const_kind:string,const_value:string,lineno:int,seg:string,vtype:string,vname:string,vdotted:string,"
    "vconst_kind:string,vconst_value:string,vnone:boolean>>"
)

_BRANCHES: dict[type, tuple[str, ...]] = {}
_NAMES: dict[type, tuple[str, ...]] = {}
_INNER: dict[type, tuple[str, ...]] = {}
_WITH_MORE = (ast.ImportFrom, ast.AugAssign, ast.BinOp, ast.BoolOp, ast.UnaryOp, ast.JoinedStr, ast.Assert)
_CHAINS = (ast.Call, ast.Attribute, ast.Name)
_PARENTS = (ast.stmt, ast.ExceptHandler, ast.Call, ast.BinOp, ast.Await, ast.arguments, ast.Module)
_KINDS = {str: "str", bool: "bool", int: "int", float: "float", bytes: "bytes", complex: "complex", type(None): "none"}


#: Node type of the one row that stands for a file whose nesting is beyond the parser of this Python.
TOO_DEEP = "TooDeep"


def parse(text: str) -> ast.Module | None:
    """The tree, or None for text that is not valid Python; RecursionError and MemoryError are the caller's to report."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text)
        except (SyntaxError, ValueError):
            return None


#: Texts below this cannot nest as deep as a tree may (about 10,000 levels, each a character at least).
_SHALLOW = 9_000


def _parses(text: str) -> bool:
    """What ``parse`` says, mostly without the tree: names are looked up in it where it lies in the parser, no node comes to Python.

    That look-up accepts nothing that is not valid and refuses some that is ('return' outside a function): then the tree decides.
    """
    try:
        if len(text) < _SHALLOW:
            try:
                symtable.symtable(text, "<unknown>", "exec")
                return True
            except (SyntaxError, ValueError):
                pass
        return parse(text) is not None
    except (RecursionError, MemoryError):
        return False


@F.pandas_udf(T.BooleanType())
def parses(text: pd.Series) -> pd.Series:
    """True for text that is valid Python."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return text.map(_parses)


def _chain(node: ast.AST) -> tuple[str, bool]:
    """Dotted text of a name or attribute chain, and whether its root is a plain name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    rooted = isinstance(node, ast.Name)
    if rooted:
        parts.append(node.id)
    return ".".join(reversed(parts)), rooted


def _callee(node: ast.AST) -> tuple[str | None, str | None]:
    """(loose, strict) dotted names: of the target for a call, of the node itself for names and attributes."""
    target = node.func if isinstance(node, ast.Call) else node
    if not isinstance(target, (ast.Name, ast.Attribute)):
        return ("" if isinstance(node, ast.Call) else None), None
    text, rooted = _chain(target)
    return text, text if rooted else None


def _has(kind: type, wanted: tuple[str, ...], known: dict[type, tuple[str, ...]]) -> tuple[str, ...]:
    """Which of the wanted fields a node class has, in their order; looked up once per class."""
    found = known.get(kind)
    if found is None:
        found = known[kind] = tuple(f for f in wanted if f in kind._fields)
    return found


def _name(node: ast.AST) -> str | None:
    while type(node) is ast.Subscript:
        node = node.value
    for attribute in _has(type(node), ("name", "id", "attr", "arg", "module", "names"), _NAMES):
        value = getattr(node, attribute, None)
        if type(value) is str:
            return value
        if attribute == "names" and value and type(value[0]) is str:
            return ", ".join(value)
    return None


def _const(node: ast.AST | None) -> tuple[str | None, str | None]:
    if not isinstance(node, ast.Constant):
        return None, None
    kind = _KINDS.get(type(node.value), "other")
    if kind in ("bytes", "other"):
        return kind, None
    try:
        # a lone surrogate is valid in a literal but not in a table
        return kind, str(node.value).encode("utf-8", "backslashreplace").decode()
    except ValueError:  # an integer of more digits than Python writes in decimal
        return kind, hex(node.value)


def _is_none(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and node.value is None


class _Segments:
    """Source text of a node by its byte offsets."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._lines: list[bytes] | None = None
        self._plain: list[str] | None = None

    def line(self, node: ast.AST) -> str:
        if self._plain is None:
            self._plain = self.text.splitlines()
        return self._plain[node.lineno - 1] if node.lineno <= len(self._plain) else ""

    def of(self, node: ast.AST) -> str | None:
        if getattr(node, "end_lineno", None) is None:
            return None
        if self._lines is None:
            unified = self.text.replace("\r\n", "\n").replace("\r", "\n")
            self._lines = [line + b"\n" for line in unified.encode("utf-8", "surrogatepass").split(b"\n")]
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self._lines[first][node.col_offset:node.end_col_offset].decode("utf-8", "replace")
        block = [self._lines[first][node.col_offset:], *self._lines[first + 1:last], self._lines[last][:node.end_col_offset]]
        return b"".join(block).decode("utf-8", "replace")


def _inner(node: ast.AST) -> ast.AST | None:
    """The annotation of a node, else its value, where that is a node."""
    for field in _has(type(node), ("annotation", "value"), _INNER):
        value = getattr(node, field, None)
        if value:
            return value if isinstance(value, ast.AST) else None
    return None


def _child(node: ast.AST, field: str, pos: int, parent: type, segments: _Segments) -> tuple:
    kind = type(node)
    if kind is ast.Name and parent is not ast.Call and parent is not ast.If:
        return field, pos, "Name", node.id, None, node.id, node.id, None, None, node.lineno, None, None, None, None, None, None, False
    loose, strict = _callee(node) if kind in _CHAINS else (None, None)
    const_kind, const_value = _const(node) if kind is ast.Constant else (None, None)
    quoted = (parent is ast.Call and field == "args") or (parent is ast.If and field in ("test", "body"))
    inner = _inner(node)
    head = (
        field, pos, kind.__name__, _name(node), getattr(node, "asname", None) if kind is ast.alias else None, loose, strict,
        const_kind, const_value, getattr(node, "lineno", None), segments.of(node) if quoted else None,
    )
    if inner is None:
        return *head, None, None, None, None, None, False
    vkind, vvalue = _const(inner)
    return (
        *head, type(inner).__name__, _name(inner), _callee(inner)[0] if type(inner) in _CHAINS else None, vkind, vvalue,
        type(inner) is ast.BinOp and type(inner.op) is ast.BitOr and (_is_none(inner.left) or _is_none(inner.right)),
    )


def _branches(kind: type) -> tuple[str, ...]:
    """Fields of a node class that can hold nodes other than contexts and operators."""
    found = _BRANCHES.get(kind)
    if found is None:
        plain = ("ctx", "op", "ops", "id", "attr", "kind", "type_comment", "level", "module", "asname", "is_async", "conversion", "simple")
        found = () if issubclass(kind, (ast.Constant, ast.Name, ast.alias)) else tuple(f for f in kind._fields if f not in plain)
        _BRANCHES[kind] = found
    return found


def _nodes(tree: ast.Module) -> list[tuple[ast.AST, int, str, int]]:
    """(node, parent index, field, position) in breadth-first order."""
    order: list[tuple[ast.AST, int, str, int]] = [(tree, -1, "", 0)]
    add, known, node_type = order.append, _BRANCHES, ast.AST
    for index, (node, _, _, _) in enumerate(order):
        fields = known.get(type(node))
        for field in _branches(type(node)) if fields is None else fields:
            value = getattr(node, field, None)
            if type(value) is list:
                for i, item in enumerate(value):
                    if isinstance(item, node_type):
                        add((item, index, field, i))
            elif isinstance(value, node_type):
                add((value, index, field, 0))
    return order


def _preorder(order: list[tuple[ast.AST, int, str, int]]) -> list[int]:
    """Depth-first ranks: a node comes right after its parent and all that lies under its earlier siblings."""
    parents = [parent for _, parent, _, _ in order]
    sizes, rank, after = [1] * len(order), [0] * len(order), [1] * len(order)
    for index in range(len(order) - 1, 0, -1):
        sizes[parents[index]] += sizes[index]
    for index in range(1, len(order)):
        parent = parents[index]
        at = rank[index] = after[parent]
        after[parent], after[index] = at + sizes[index], at + 1
    return rank


def _details(node: ast.AST, segments: _Segments) -> tuple:
    """(name, level, dotted, strict, base, op, arity, const_kind, const_value, seg) of a node."""
    kind = type(node)
    if kind is ast.Name:
        return node.id, None, node.id, node.id, None, None, None, None, None, None
    if kind is ast.Constant:
        return (None,) * 7 + (*_const(node), None)
    if kind is ast.Call:
        return None, None, *_callee(node), None, None, None, None, None, None
    if kind in (ast.Attribute, ast.Subscript, ast.Starred):
        value = node.value
        while isinstance(value, ast.Starred):
            value = value.value
        base = _callee(value)[1] if isinstance(value, (ast.Name, ast.Attribute)) else None
        dotted = _callee(node) if kind is ast.Attribute else (None, None)
        return _name(node), None, *dotted, base, None, None, None, None, None
    if kind not in _WITH_MORE:
        return _name(node), None, None, None, None, None, None, None, None, None
    operator = getattr(node, "op", None)
    seg = segments.of(node) if kind is ast.JoinedStr else segments.line(node) if kind is ast.Assert else None
    return (
        _name(node), getattr(node, "level", None), None, None, None, type(operator).__name__ if operator is not None else None,
        len(node.values) if kind is ast.BoolOp else None, None, None, seg,
    )


def _structs(values: list[tuple], fields: list, wanted: frozenset[str] | None = None) -> pa.StructArray:
    columns = list(zip(*values)) if values else [[] for _ in fields]
    kept = [(c, n, t) for c, (n, t) in zip(columns, fields) if wanted is None or n in wanted]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, _, t in kept], fields=[pa.field(n, t) for _, n, t in kept])


#: Fields of a child that its own name tells.
_PLAIN_CHILD = frozenset({"field", "pos", "type", "dotted", "strict"})
#: Scalars that a node's place tells, without a look at what it says.
_PLAIN = frozenset({"project_id", "path", "node_id", "dfs_id", "node_type", "lineno", "col", "end_lineno", "parent_type", "parent_field"})


class _Read:
    """Which columns of the facts a plan reads; None: all. Nested ones by dotted names."""

    def __init__(self, columns: Iterable[str] | None) -> None:
        names = None if columns is None else set(columns)
        inner = lambda prefix: None if names is None else frozenset(n.split(".", 1)[1] for n in names if n.startswith(prefix + "."))
        self.scalars = [n for n, _ in _SCALARS if names is None or n in names]
        self.ancestors, self.children = inner("ancestors"), inner("children")
        known = {n for n, _ in _SCALARS} | {f"ancestors.{n}" for n, _ in _ANCESTOR_FIELDS} | {f"children.{n}" for n, _ in _CHILD_FIELDS}
        if names is not None and not names <= known:
            raise ValueError(f"no such columns: {sorted(names - known)}")
        if len(self.scalars) < 2:
            raise ValueError("columns need two scalars at least, such as project_id and path")
        places = [i for i, (n, _) in enumerate(_SCALARS) if n in self.scalars]
        self.pick = itemgetter(*places)
        self.ranks = "dfs_id" in self.scalars
        self.details = not _PLAIN.issuperset(self.scalars)
        self.plain_children = self.children is not None and self.children <= _PLAIN_CHILD
        self.nested = [n for n, fields in (("ancestors", self.ancestors), ("children", self.children)) if fields is None or fields]
        self.schema = SCHEMA if names is None else ", ".join(self._ddl())

    def _ddl(self) -> Iterator[str]:
        types = {_TEXT: "string", _INT: "int", pa.bool_(): "boolean"}
        yield from (f"{n} {types[t]}" for n, t in _SCALARS if n in self.scalars)
        for name, fields, wanted in (("ancestors", _ANCESTOR_FIELDS, self.ancestors), ("children", _CHILD_FIELDS, self.children)):
            if name in self.nested:
                yield f"{name} array<struct<{','.join(f'{n}:{types[t]}' for n, t in fields if n in wanted)}>>"


class _Batch:
    """Rows collected for one Arrow batch: scalars by row, the nested columns flat with their ends.

    Ancestors are links that nodes share: each is kept once, and chains are the places of their links.
    """

    def __init__(self, read: _Read) -> None:
        self.read = read
        self.rows: list[tuple] = []
        self.links: list[tuple] = []
        self.chains: list[int] = []
        self.chain_ends = [0]
        self.kids: list[tuple] = []
        self.kid_ends = [0]

    def arrow(self) -> pa.RecordBatch:
        read, types = self.read, dict(_SCALARS)
        columns = {n: pa.array(c, types[n]) for n, c in zip(read.scalars, zip(*self.rows))}
        if "ancestors" in read.nested:
            chains = _structs(self.links, _ANCESTOR_FIELDS, read.ancestors).take(pa.array(self.chains, _INT))
            columns["ancestors"] = pa.ListArray.from_arrays(pa.array(self.chain_ends, _INT), chains)
        if "children" in read.nested:
            columns["children"] = pa.ListArray.from_arrays(pa.array(self.kid_ends, _INT), _structs(self.kids, _CHILD_FIELDS, read.children))
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)) if len(columns) < len(_ARROW) else pa.RecordBatch.from_arrays(list(columns.values()), schema=_ARROW)


#: Node types whose rows carry their ancestors, each with the edges to its parent for which it does; None: at any edge.
Chained = Mapping[str, frozenset[str] | None]


def _add_file(out: _Batch, project: str, path: str, text: str, types: frozenset[str] | None, ancestors: frozenset[str] | None, children: frozenset[str] | None, chained: Chained | None, edges: Chained | None = None) -> None:
    read = out.read
    try:
        tree = parse(text)
    except (RecursionError, MemoryError):
        known = {"project_id": project, "path": path, "node_id": 0, "node_type": TOO_DEEP}
        out.rows.append(tuple(known.get(n) for n in read.scalars))
        out.chain_ends.append(len(out.chains))
        out.kid_ends.append(len(out.kids))
        return
    if tree is None:
        return
    order = _nodes(tree)
    kinds = [type(n).__name__ for n, _, _, _ in order]
    emitted = range(len(order)) if types is None else [i for i, k in enumerate(kinds) if k in types]
    if edges:
        emitted = [i for i in emitted if (own := edges.get(kinds[i])) is None or f"{kinds[order[i][1]]}.{order[i][2]}" in own]
    if not emitted:
        return
    segments = _Segments(text)
    with_ancestors = (ancestors is None or bool(ancestors)) and "ancestors" in read.nested
    ranks = _preorder(order) if read.ranks and (ancestors is None or ancestors) else None
    below: dict[int, list[int]] = {}
    if (children is None or children) and "children" in read.nested:
        parents = {i for i in emitted if (children is None or kinds[i] in children) and isinstance(order[i][0], _PARENTS)}
        for index, (_, parent, _, _) in enumerate(order):
            if parent in parents:
                below.setdefault(parent, []).append(index)
    # Chains of ancestors are shared by the children in one field: that of the parent plus one link.
    above: dict[tuple[int, str], list[int]] = {(-1, ""): []}

    def chain(index: int, field: str) -> list[int]:
        todo, at = [], (index, field)
        while at not in above:
            todo.append(at)
            at = order[at[0]][1:3]
        known = above[at]
        for at in reversed(todo):  # from the root down
            node = order[at[0]][0]
            if ancestors is not None and kinds[at[0]] not in ancestors:
                above[at] = known
                continue
            known = above[at] = [*known, len(out.links)]
            out.links.append((at[0], kinds[at[0]], _name(node), getattr(node, "lineno", None), f"{kinds[at[0]]}.{at[1]}"))
        return known

    add, chains, chain_ends, kids, kid_ends = out.rows.append, out.chains, out.chain_ends, out.kids, out.kid_ends
    whole = len(read.scalars) == len(_SCALARS)
    pick = read.pick
    for index in emitted:
        node, parent, field, _ = order[index]
        kind = kinds[index]
        own = _details(node, segments) if read.details else _NOTHING
        row = (
            project, path, index, ranks[index] if ranks else None, kind, getattr(node, "lineno", None),
            getattr(node, "col_offset", None), getattr(node, "end_lineno", None),
        ) + own + (kinds[parent] if parent >= 0 else None, field or None)
        add(row if whole else pick(row))
        if with_ancestors and (chained is None or (kind in chained and (
                (links := chained[kind]) is None or f"{kinds[parent]}.{field}" in links))):
            known = above.get((parent, field))
            chains += chain(parent, field) if known is None else known
        chain_ends.append(len(chains))
        if index in below:
            if read.plain_children:
                for c in below[index]:
                    child, _, name, pos = order[c]
                    loose, strict = _callee(child) if type(child) in _CHAINS else (None, None)
                    kids.append((name, pos, kinds[c], None, None, loose, strict, *_NO_MORE))
            else:
                owner = type(node)
                kids += [_child(order[c][0], order[c][2], order[c][3], owner, segments) for c in below[index]]
        kid_ends.append(len(kids))


_NOTHING = (None,) * 10
_NO_MORE = (None,) * (len(_CHILD_FIELDS) - 7)


def _emit(
    batch: pa.RecordBatch, types: frozenset[str] | None, ancestors: frozenset[str] | None, children: frozenset[str] | None, chained: Chained | None = None,
    edges: Chained | None = None, read: _Read | None = None,
) -> Iterator[pa.RecordBatch]:
    read = read or _Read(None)
    out = _Batch(read)
    for project, path, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
        _add_file(out, project, path, text, types, ancestors, children, chained, edges)
        if len(out.rows) >= 20000:
            yield out.arrow()
            out = _Batch(read)
    if out.rows:
        yield out.arrow()


def syntax_facts(
    files: DataFrame, node_types: Iterable[str] | None = None, ancestors: bool | Iterable[str] = True, children: bool | Iterable[str] = True,
    chained: Mapping[str, Iterable[str] | None] | None = None, edges: Mapping[str, Iterable[str]] | None = None, columns: Iterable[str] | None = None,
) -> DataFrame:
    """One row per syntax node of every Python file that parses; files that do not parse give no rows.

    ``ancestors`` may name the types of enclosing nodes that a plan reads, ``children`` the node types that come with theirs,
    ``chained`` those that come with their ancestors, each with the edges to its parent (``Call.args``) for which it does, or None for all.
    ``edges`` names node types that have rows at the given edges only, ``columns`` the columns that there are, nested ones by dotted names.
    """
    types = frozenset(node_types) if node_types is not None else None
    chosen = lambda x: (None if x else frozenset()) if isinstance(x, bool) else frozenset(x)
    enclosing, parents = chosen(ancestors), chosen(children)
    links = None if chained is None else {t: None if e is None else frozenset(e) for t, e in chained.items()}
    placed = None if edges is None else {t: frozenset(e) for t, e in edges.items()}
    read = _Read(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _emit(batch, types, enclosing, parents, links, placed, read)

    python = files.filter(F.col("language") == "python").select("project_id", "path", "text")
    return python.mapInArrow(run, read.schema)


FUNCTION_TYPES = ["FunctionDef", "AsyncFunctionDef"]


def definitions(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("node_type").isin(FUNCTION_TYPES)).select(
        "project_id", F.col("path").alias("file"), F.col("lineno").alias("line"), "end_lineno", "node_type", "name"
    )


def classes(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("node_type") == "ClassDef").select(
        "project_id", F.col("path").alias("file"), F.col("lineno").alias("line"), "end_lineno", "name"
    )


def imports(facts: DataFrame) -> DataFrame:
    """One row per imported name: module for ``from`` imports, dotted name otherwise."""
    rows = facts.filter(F.col("node_type").isin("Import", "ImportFrom")).select(
        "project_id", F.col("path").alias("file"), F.col("lineno").alias("line"), "node_type",
        F.col("name").alias("module"), "level", F.explode("children").alias("alias"),
    )
    return rows.select("project_id", "file", "line", "node_type", "module", "level",
                       F.col("alias.name").alias("name"), F.col("alias.asname").alias("asname"))


def calls(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("node_type") == "Call").select(
        "project_id", F.col("path").alias("file"), F.col("lineno").alias("line"), F.col("col").alias("column"),
        F.col("dotted").alias("name"),
    )


#: Columns of the facts that ``descendants`` reads.
OWNED = ["project_id", "path", "node_id", "node_type", "ancestors.id", "ancestors.type", "ancestors.name", "ancestors.lineno"]


def descendants(facts: DataFrame, of_types: list[str]) -> DataFrame:
    """Each node with every enclosing node of the given types: (owner_id, owner_name, owner_line, node …)."""
    owners = F.filter("ancestors", lambda a: a["type"].isin(of_types))
    return facts.select(
        "project_id", F.col("path").alias("file"), "node_id", "node_type", F.explode(owners).alias("owner")
    ).select("project_id", "file", F.col("owner.id").alias("owner_id"), F.col("owner.name").alias("owner_name"),
             F.col("owner.lineno").alias("owner_line"), "node_id", "node_type")


def children_of(field: str) -> Column:
    return F.filter("children", lambda c: c["field"] == field)
