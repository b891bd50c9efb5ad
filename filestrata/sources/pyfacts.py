"""The syntax-tree pass: each Python file is parsed once, on the executors, into plain facts.

Nothing here knows a report's rules. Signatures, complexity, tests, entry points and the rest
are derived from these facts by DataFrame expressions in ``operators.symbols``.
"""
from __future__ import annotations

import ast
import gc
from collections.abc import Iterator, Sequence
from itertools import chain
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import paths, text
from ..schemas import FACTS
from ..session import spread

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_PLACED = frozenset([ast.Import, ast.ImportFrom, ast.ClassDef, *_DEFS])
_BRANCHES = frozenset([ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith, ast.ExceptHandler])
# A boolean expression weighs two: the expression and its operator are both decisions.
_DECISIONS = {ast.If: 1, ast.For: 1, ast.While: 1, ast.Try: 1, ast.BoolOp: 2, ast.With: 1}
# Operators and contexts, and fields that hold a plain value in every node but a bare name's.
_LEAF_FIELDS = frozenset(["ctx", "op", "ops", "id", "attr", "arg", "name", "asname", "kind", "module", "level", "type_comment"])
# Files whose facts a task holds as Python values at a time.
_SLICE = 256


class _Held(dict):
    """How to get the fields of each kind of node that can hold other nodes, last first, and whether these are several."""

    def __missing__(self, kind: type) -> tuple:
        names = [] if kind in (ast.Constant, ast.Import, ast.ImportFrom) else [name for name in reversed(kind._fields) if name not in _LEAF_FIELDS]
        self[kind] = attrgetter(*names) if names else None, len(names) > 1
        return self[kind]


class _Visits(dict):
    """How the walk takes values of each type: 0 not at all, 1 for what it holds, 2 with its place too, as statements can be in it."""

    def __missing__(self, kind: type) -> int:
        blocks = (ast.mod, ast.stmt, ast.excepthandler, ast.match_case)
        # No fact starts in a bare name or an imported one.
        skipped = not issubclass(kind, ast.AST) or kind in (ast.Name, ast.alias)
        self[kind] = 0 if skipped else 2 if issubclass(kind, blocks) else 1
        return self[kind]


_HELD = _Held()
_VISITS = _Visits()


def _plain(value: str | None) -> str | None:
    """Text that can leave Python: a lone surrogate from an escape becomes '?'."""
    return value if value is None or value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


def _dotted(node: ast.AST) -> str | None:
    """``a.b.c`` for attributes of a name, and for a name itself; nothing for a chain that starts elsewhere."""
    if type(node) is ast.Name:
        return node.id
    tail: list[str] = []
    while type(node) is ast.Attribute:
        tail.append(node.attr)
        node = node.value
    return ".".join([node.id, *tail[::-1]]) if type(node) is ast.Name else None


def _chain(node: ast.AST, fallback) -> str | None:
    """``a.b.c`` for names and attributes; ``fallback`` names whatever the chain starts from."""
    tail: list[str] = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    head = node.id if isinstance(node, ast.Name) else fallback(node)
    return ".".join(([head] if head else []) + tail[::-1]) or None


def _named(node: ast.AST | None) -> str | None:
    return None if node is None else _dotted(node) or _plain(_chain(node, ast.unparse))


def _text(node: ast.AST | None) -> str | None:
    return _plain(node.value) if type(node) is ast.Constant and type(node.value) is str else None


def _written(node: ast.AST | None) -> str | None:
    """The node's source; names and their attributes need no unparser."""
    return None if node is None else _dotted(node) or _plain(ast.unparse(node))


def _is_main_guard(node: ast.AST) -> bool:
    """Asked of an ``if`` by its module and by its function, so the node keeps the answer."""
    if type(node) is not ast.If:
        return False
    if not hasattr(node, "main_guard"):
        node.main_guard = _mentions(node.test, "__name__", "__main__")
    return node.main_guard


def _mentions(node: ast.AST, *words: str) -> bool:
    """Whether names and texts in the expression hold all of the words."""
    if type(node) is ast.Name:
        return all(word in node.id for word in words)
    found: list[str] = []
    stack = [node]
    while stack:
        inner = stack.pop()
        held = inner.value if type(inner) is ast.Constant else getattr(inner, "id", None) or getattr(inner, "attr", None) or getattr(inner, "arg", None)
        if isinstance(held, bytes):
            held = held.decode("latin-1")
        if isinstance(held, str):
            found.append(held)
        get, several = _HELD[type(inner)]
        if get is not None:
            for value in get(inner) if several else (get(inner),):
                stack.extend(item for item in (value if type(value) is list else (value,)) if isinstance(item, ast.AST))
    return all(any(word in held for held in found) for word in words)


def _doc(node: ast.AST) -> str | None:
    return _plain(ast.get_docstring(node)) if node.body and type(node.body[0]) is ast.Expr else None


# Records are tuples in the order of ``schemas.FACTS``.

def _args(spec: ast.arguments) -> list[tuple]:
    groups = (
        ("posonly", spec.posonlyargs), ("plain", spec.args),
        ("vararg", (spec.vararg,) if spec.vararg else ()), ("kwonly", spec.kwonlyargs),
        ("kwarg", (spec.kwarg,) if spec.kwarg else ()),
    )
    return [(slot, arg.arg, _written(arg.annotation), _named(arg.annotation)) for slot, members in groups for arg in members]


def facts(source: str) -> dict:
    """All facts of one file; only ``parse_ok`` is set when it does not parse."""
    try:
        return _collect(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"parse_ok": False}


def _import(node: ast.Import | ast.ImportFrom) -> tuple:
    return (node.module or "") if type(node) is ast.ImportFrom else None, [alias.name for alias in node.names]


def _class(node: ast.ClassDef, owners: tuple[str, ...]) -> tuple:
    return (
        node.name, ".".join((*owners, node.name)), node.lineno, _doc(node),
        [_written(b) for b in node.bases], [_named(b) for b in node.bases], [_named(d) or "" for d in node.decorator_list],
        [n.name for n in node.body if isinstance(n, _DEFS)], [n.name for n in node.body if type(n) is ast.FunctionDef],
    )


def _function(node, owners: tuple[str, ...], branches: list[int]) -> tuple:
    """``branches`` has one count, which the walk goes on raising."""
    return (
        node.name, ".".join((*owners, node.name)), type(node) is ast.AsyncFunctionDef, node.lineno, _doc(node),
        _args(node.args), _written(node.returns), [_named(d) or "" for d in node.decorator_list], branches,
        any([_is_main_guard(n) for n in node.body if type(n) is ast.If]),
    )


def _call(node: ast.Call) -> tuple:
    target = dotted = _dotted(node.func)
    if dotted is None:
        target, dotted = _named(node.func), _chain(node.func, lambda _: None)
    return (
        target, dotted, _text(node.args[0]) if node.args else None,
        [(k.arg, _text(k.value)) for k in node.keywords if k.arg],
    )


def _collect(tree: ast.Module) -> dict:
    """One pass in source order; each statement knows its depth, its classes and the branches of its functions."""
    imports: list[tuple] = []
    classes: list[tuple] = []
    functions: list[tuple] = []
    calls: list[tuple] = []
    subscripts: list[tuple] = []
    strings: list[str] = []
    seen = decisions = 0
    main_guard = False
    visits, held = _VISITS, _HELD
    # Statements and what can hold them come with their place, expressions bare.
    stack: list = [(tree, 0, (), ())]
    pop, push = stack.pop, stack.append
    while stack:
        node = pop()
        kind = type(node)
        if kind is not tuple:
            if kind is ast.Constant:
                if type(node.value) is str:
                    strings.append(_plain(node.value))
                continue
            if kind is ast.Call:
                calls.append(_call(node))
            elif kind is ast.Subscript:
                subscripts.append((_named(node.value), _text(node.slice)))
            elif kind is ast.BoolOp:
                decisions += _DECISIONS[kind]
            # Children in source order.
            get, several = held[kind]
            if get is not None:
                for value in get(node) if several else (get(node),):
                    if type(value) is list:
                        for item in reversed(value):
                            if visits[type(item)]:
                                push(item)
                    elif visits[type(value)]:
                        push(value)
            continue
        node, depth, owners, around = node
        kind = type(node)
        seen += 1
        if kind in _DECISIONS:
            decisions += _DECISIONS[kind]
        if kind in _BRANCHES:
            for branches in around:
                branches[0] += 1
            if kind is ast.If and not main_guard:
                main_guard = _is_main_guard(node)
        elif kind in _PLACED:
            where = depth, seen, depth == 1
            if kind is ast.ClassDef:
                classes.append(where + _class(node, owners))
                owners = (*owners, node.name)
            elif kind in _DEFS:
                around = (*around, [0])
                functions.append(where + _function(node, owners, around[-1]))
            else:
                imports.append(where + _import(node))
        get, several = held[kind]
        if get is None:
            continue
        below = depth + 1
        for value in get(node) if several else (get(node),):
            for item in reversed(value) if type(value) is list else (value,):
                visit = visits[type(item)]
                if visit == 1:
                    push(item)
                elif visit:
                    push((item, below, owners, around))
    return {
        "parse_ok": True, "doc": _doc(tree), "decisions": decisions, "main_guard": main_guard,
        "imports": imports, "classes": classes, "functions": [(*f[:11], f[11][0], f[12]) for f in functions],
        "calls": calls, "subscripts": subscripts, "strings": strings,
    }


def _column(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Nested plain values as Arrow, leaf by leaf: far faster than converting records. Only lists and leaves can be missing."""
    if pa.types.is_struct(kind):
        columns = zip(*values) if values else [()] * kind.num_fields
        return pa.StructArray.from_arrays([_column(column, f.type) for column, f in zip(columns, kind)], fields=list(kind))
    if not pa.types.is_list(kind):
        return pa.array(values, type=kind)
    offsets, end = [], 0
    for v in values:
        offsets.append(None if v is None else end)
        end += len(v or ())
    items = _column(list(chain.from_iterable(v for v in values if v)), kind.value_type)
    found = pa.ListArray.from_arrays(pa.array([*offsets, end], pa.int32()), items)
    return found.cast(kind)


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of every Python file with text, as (project_id, path, todo_count, headings, facts).

    Other files never reach Python, and the text itself does not come back: the two columns that
    need it are computed beside the parse. Parsing costs far more than moving the text, so files
    are spread by key first: no task is left with one input split's share of large files. Freeze
    the result where several views are taken.
    """
    path, content = F.col("path"), F.col("content")
    sources = files.filter((paths.suffix(path) == ".py") & content.isNotNull()).select(
        "project_id", "path", text.comment_markers(content).alias("todo_count"),
        text.headings(content, 10, indented=True).alias("headings"), "content")
    schema = T.StructType([*sources.drop("content").schema.fields, T.StructField("facts", FACTS)])
    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = list(arrow.field("facts").type)
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                # Syntax trees and facts hold no cycles, and the collector would walk them over and over.
                gc.disable()
                try:
                    rows = [facts(source) for source in batch.column("content").to_pylist()]
                    found = pa.StructArray.from_arrays([_column([row.get(f.name) for row in rows], f.type) for f in fields], fields=fields)
                    rows.clear()
                finally:
                    gc.enable()
                kept = [batch.column(name).cast(arrow.field(name).type) for name in arrow.names[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, found], schema=arrow)

    return spread(sources, "project_id", "path").mapInArrow(parse, schema)
