"""Deeply nested semi-structured records into related flat tables.

The schema graph is read off the data in one distributed pass: which element occurs below which, and whether it is an
object, an array or a scalar; an object below an object of its own name is the same element again. Shared inlining then
decides: the roots and every element that repeats, is shared by several parents or takes part in a cycle become tables;
every other descendant is inlined into its nearest ancestor that has one. All tables are filled in one pass: each text is
parsed once, and one walk along the graph emits the rows of every table wanted, in Arrow batches. A row carries the record
key, the positions in its ancestors that have tables (its foreign key: all but the last position is the key of the parent
row), the path of its parent, and its inlined columns as text.

Defined results: null, blank or invalid JSON gives no row; JSON that is itself a JSON string is opened, however often it was
wrapped; strings further inside are text; an element in place of its array has position 1; a null element keeps its position
and gives no row; a record that occurs twice gives rows for each key; missing keys give null columns; of a repeated key the
last counts; numbers keep their spelling; nesting may be of any depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths that a schema may have; beyond it keys are data, and inlining them as columns is wrong.
MOST_PATHS = 10_000


class Number(str):
    """A number as it is spelled."""


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=Number)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null))')
_NAMED = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """The value of JSON text without recursion, for nesting that the usual parser refuses; ValueError if it is no JSON."""
    held: list = []
    at, value, done = 0, None, False
    key: list[str | None] = []
    # What may come next: a value, a key, a colon, a comma or an end; `first` allows an end where a value or key is due.
    due, first = "value", False
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            if done and not text[at:].strip(" \t\n\r"):
                return value
            raise ValueError("no JSON")
        if done:
            raise ValueError("more than one value")
        at = m.end()
        mark, quote, plain = m.groups()
        if mark == ":" and due == "colon":
            due, first = "value", False
            continue
        if mark == "," and due == "comma":
            due, first = ("key" if isinstance(held[-1], dict) else "value"), False
            continue
        if mark in ("[", "{") and due == "value":
            held.append([] if mark == "[" else {})
            key.append(None)
            due, first = ("value" if mark == "[" else "key"), True
            continue
        if mark in ("]", "}") and (due == "comma" or first) and held and isinstance(held[-1], dict) == (mark == "}"):
            made = held.pop()
            key.pop()
        elif quote and due in ("value", "key"):
            first = False
            made, at = json.decoder.scanstring(text, at)
            if due == "key":
                key[-1], due = made, "colon"
                continue
        elif plain and due == "value":
            made = _NAMED[plain] if plain in _NAMED else Number(plain)
        else:
            raise ValueError("no JSON")
        if not held:
            value, done = made, True
            continue
        if isinstance(held[-1], dict):
            held[-1][key[-1]] = made
        else:
            held[-1].append(made)
        due, first = "comma", False


def opened(text: str | None):
    """The value of JSON text, opened as long as it is a string that holds JSON; None if there is none."""
    value = text
    while isinstance(value, str) and not isinstance(value, Number):
        try:
            try:
                value = _DECODER.decode(value)
            except RecursionError:
                value = parse_deep(value)
        except ValueError:
            return None if value is text else value
    return value


def _has_object(value) -> bool:
    return isinstance(value, dict) or isinstance(value, list) and any(isinstance(v, dict) for v in value)


def _kind(value) -> str:
    return "OBJECT" if isinstance(value, dict) else "ARRAY" if isinstance(value, list) else "NULL" if value is None else "SCALAR"


class _Seen:
    """An element met in the data: its path, the elements of its name above it, and how often it was of which kind."""

    def __init__(self, path: str, name: str, above: dict[str, _Seen]) -> None:
        self.path, self.above, self.below = path, above | {name: self}, {}
        self.kinds: dict[str, int] = {}

    def child(self, name: str, value) -> _Seen:
        if name in self.above and _has_object(value):
            same = self.above[name]
            same.kinds["RECURSIVE"] = same.kinds.get("RECURSIVE", 0) + 1
            return same
        if name not in self.below:
            self.below[name] = _Seen(f"{self.path}.{name}", name, self.above)
        return self.below[name]

    def count(self, value) -> None:
        stack = [(self, value, False)]
        while stack:
            seen, v, inside = stack.pop()
            kind = _kind(v) + ("_IN_ARRAY" if inside else "")
            seen.kinds[kind] = seen.kinds.get(kind, 0) + 1
            if isinstance(v, dict):
                stack += [(seen.child(k, x), x, False) for k, x in v.items()]
            elif isinstance(v, list):
                stack += [(seen, x, True) for x in v]


def schema_paths(records: DataFrame, fields: list[str]) -> DataFrame:
    """(path, kind, n) over all records; counted in each partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = {f: _Seen(f, f, {}) for f in fields}
        for batch in batches:
            for f in fields:
                for text in batch.column(f).to_pylist():
                    if text and (value := opened(text)) is not None:
                        roots[f].count(value)
        rows, stack = [], list(roots.values())
        while stack:
            seen = stack.pop()
            rows += [(seen.path, k, n) for k, n in seen.kinds.items()]
            stack += seen.below.values()
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["path", "kind", "n"])

    found = records.select(*fields).mapInArrow(count, "path string, kind string, n bigint")
    return found.groupBy("path", "kind").agg(F.sum("n").alias("n"))


@dataclass
class Node:
    """An element of the schema graph."""

    name: str
    path: str
    repeated: bool = False
    shared: bool = False
    recursive: bool = False
    object: bool = False
    scalar: bool = False
    bare: bool = False
    children: dict[str, Node] = field(default_factory=dict)
    #: The nodes of the path by name, this one included: an object below an object of its own name is the same element.
    above: dict[str, Node] = field(default_factory=dict)
    #: The number of its table; -1 if it is inlined.
    table: int = -1

    @property
    def own_table(self) -> bool:
        return self.repeated or self.shared or self.recursive


def schema_graph(paths: list[tuple[str, str]], repeated: Iterable[str] = ()) -> dict[str, Node]:
    """Nodes by path. An element is repeated if it is an array anywhere or stated to be; shared if objects of its name occur
    below several parents; recursive if objects of its name occur below it."""
    nodes: dict[str, Node] = {}
    for path in sorted({p for p, _ in paths} | set(repeated)):
        up, _, name = path.rpartition(".")
        node = nodes.setdefault(path, Node(name, path))
        node.above = (nodes[up].above if up in nodes else {}) | {name: node}
        if up in nodes:
            nodes[up].children[name] = node
    for path, kind in paths:
        node, inside = nodes[path], kind.endswith("_IN_ARRAY")
        node.repeated |= inside or kind == "ARRAY"
        node.object |= kind.startswith("OBJECT")
        node.scalar |= kind.startswith("SCALAR")
        node.bare |= kind == "SCALAR"
        node.recursive |= kind == "RECURSIVE"
    parents: dict[str, set[str]] = {}
    for node in nodes.values():
        node.repeated |= node.path in repeated
        if node.object and "." in node.path:
            parents.setdefault(node.name, set()).add(node.path.split(".")[-2])
    for node in nodes.values():
        node.shared = node.object and len(parents.get(node.name, ())) > 1
    return nodes


@dataclass
class FlatTable:
    """A table of the inlined schema: its name, the elements whose rows it holds, how many positions a row has (0 if that varies),
    and the columns inlined into it with their paths below the element."""

    name: str
    paths: list[str]
    depth: int
    columns: dict[str, tuple[str, ...]]
    shared: bool


def inline(nodes: dict[str, Node], roots: list[str]) -> list[FlatTable]:
    """The tables of shared inlining, parents before children; numbers the nodes that have one."""
    tables: list[FlatTable] = []
    by_name: dict[str, int] = {}

    def columns(node: Node, prefix: str, path: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
        out: dict[str, tuple[str, ...]] = {}
        for c in node.children.values():
            name, sub = f"{prefix}{c.name}", (*path, c.name)
            if c.own_table:
                # A value that may stand in place of the repeated or shared element is also kept here.
                out |= {name: sub} if c.bare else {}
                continue
            if c.scalar or not c.children:
                out[name] = sub
            out |= columns(c, f"{name}_", sub)
        return out

    def walk(node: Node, depth: int, varies: bool) -> None:
        if node.own_table or node.path in roots:
            depth += 1
            varies = varies or node.recursive
            name = node.name if node.shared else node.path.replace(".", "_")
            own = columns(node, "", ())
            if node.shared and name in by_name:
                t = tables[by_name[name]]
                t.columns = own | t.columns
                t.paths.append(node.path)
                t.depth = 0 if varies or not t.depth else max(t.depth, depth)
            else:
                while name in {t.name for t in tables}:
                    name += "_own"
                tables.append(FlatTable(name, [node.path], 0 if varies else depth, own, node.shared))
                if node.shared:
                    by_name[node.name] = len(tables) - 1
            node.table = by_name[node.name] if node.shared else len(tables) - 1
        for c in node.children.values():
            walk(c, depth, varies)

    for r in roots:
        if r in nodes:
            walk(nodes[r], 0, False)
    return tables


def _text(value) -> str | None:
    """A value as text: strings and numbers as they are, objects and arrays as JSON."""
    if value is None or isinstance(value, str):
        return value
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, tuple):
            out.append(v[0])
        elif isinstance(v, dict):
            stack.append(("}",))
            for i, (k, x) in enumerate(reversed(v.items())):
                stack += [x, (json.dumps(k, ensure_ascii=False) + ": ",), *([(", ",)] if i < len(v) - 1 else [])]
            out.append("{")
        elif isinstance(v, list):
            stack.append(("]",))
            for i, x in enumerate(reversed(v)):
                stack += [x, *([(", ",)] if i < len(v) - 1 else [])]
            out.append("[")
        else:
            out.append(v if isinstance(v, Number) else json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _at(value, path: tuple[str, ...]) -> str | None:
    for name in path:
        if not isinstance(value, dict) or name not in value:
            return None
        value = value[name]
    return _text(value)


def emitted(node: Node, value, wanted: dict[int, list[tuple[str, ...]]]) -> Iterator[tuple]:
    """(table, path, parent, positions, kind, value, columns) of the rows below an element, in no order."""
    stack: list[tuple[Node, object, tuple[int, ...], str]] = [(node, value, (), "")]
    while stack:
        node, value, pos, up = stack.pop()
        if node.table < 0:
            if isinstance(value, dict):
                for name, v in value.items():
                    if v is not None:
                        same = node.above.get(name) if _has_object(v) else None
                        below = same or node.children.get(name)
                        if below is not None:
                            stack.append((below, v, pos, node.path))
            continue
        columns = wanted.get(node.table)
        for i, one in enumerate(value if isinstance(value, list) else (value,), 1):
            if one is None:
                continue
            here = (*pos, i)
            if isinstance(one, dict):
                if columns is not None:
                    yield node.table, node.path, up, here, "OBJECT", None, [_at(one, c) for c in columns]
                for name, v in one.items():
                    if isinstance(v, (dict, list)) or v is not None and name in node.children and node.children[name].table >= 0:
                        same = node.above.get(name) if _has_object(v) else None
                        below = same or node.children.get(name)
                        if below is not None:
                            stack.append((below, v, here, node.path))
            elif columns is not None:
                kind = "ARRAY" if isinstance(one, list) else "NUMBER" if isinstance(one, Number) else "STRING" if isinstance(one, str) else "BOOLEAN"
                yield node.table, node.path, up, here, kind, _text(one), [None] * len(columns)


def filled(records: DataFrame, key: str, nodes: dict[str, Node], fields: list[str], wanted: dict[int, list[tuple[str, ...]]]) -> DataFrame:
    """(key, table_, path_, parent_, pos, kind_, value_, cols): the rows of the tables wanted, with the columns wanted of each."""
    kind = records.schema[key].dataType
    roots = {f: nodes[f] for f in fields if f in nodes}
    types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.list_(pa.string())]
    names = ["table_", "path_", "parent_", "pos", "kind_", "value_", "cols"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for f, node in roots.items():
                for i, text in enumerate(batch.column(f).to_pylist()):
                    if text and (value := opened(text)) is not None:
                        had = len(rows)
                        rows += emitted(node, value, wanted)
                        of += [i] * (len(rows) - had)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of, pa.int64())), *arrays], names=["key", *names])

    schema = f"key {kind.simpleString()}, table_ int, path_ string, parent_ string, pos array<int>, kind_ string, value_ string, cols array<string>"
    return records.select(F.col(key).alias("key"), *roots).mapInArrow(fill, schema)


def graph_of(records: DataFrame, fields: list[str], repeated: Iterable[str] = ()) -> tuple[dict[str, Node], list[FlatTable]]:
    """The schema graph of the JSON fields and the tables that shared inlining makes of it."""
    found = schema_paths(records, fields).limit(MOST_PATHS + 1).collect()
    if len(found) > MOST_PATHS:
        raise ValueError(f"more than {MOST_PATHS} paths: keys are data here")
    nodes = schema_graph([(r["path"], r["kind"]) for r in found], repeated)
    return nodes, inline(nodes, fields)


def flat_tables(records: DataFrame, key: str, fields: list[str], repeated: Iterable[str] = ()) -> dict[str, DataFrame]:
    """The related flat tables of the JSON fields, by name.

    The key of a row is (key, positions), p1 .. pn, or pos where their number varies (recursive elements and what is below them);
    without the last position it is the key of the parent's row. kind_ is what a row's element is and value_ its text if it is no
    object. Elements in `repeated` have tables even if they are nowhere arrays. An element shared by several parents has one table,
    named as the element, a recursive one as well; their parent_ is the path of a row's parent. The tables can be filled at once with filled()."""
    nodes, tables = graph_of(records, fields, repeated)
    out: dict[str, DataFrame] = {}
    for k, t in enumerate(tables):
        rows = filled(records, key, nodes, fields, {k: list(t.columns.values())})
        at = [F.get("pos", F.lit(i)).alias(f"p{i + 1}") for i in range(t.depth)] or [F.col("pos")]
        parent = [F.col("parent_")] if t.shared or not t.depth else []
        columns = [F.get("cols", F.lit(i)).alias(c) for i, c in enumerate(t.columns)]
        out[t.name] = rows.select(F.col("key").alias(key), *at, *parent, "kind_", "value_", *columns)
    return out


def table_rows(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(table_name, key, path, parent, pos, kind, value, cells): every row of every flat table with its inlined columns, from one
    walk; pos without its last number is the pos of the parent's row, cells holds (name, value) of each column of the table."""
    nodes, tables = graph_of(records, fields)
    rows = filled(records, key, nodes, fields, {k: list(t.columns.values()) for k, t in enumerate(tables)})
    named = records.sparkSession.createDataFrame([(k, t.name, list(t.columns)) for k, t in enumerate(tables)], "table_ int, table_name string, names array<string>")
    cell = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    cells = F.zip_with("names", "cols", cell)
    placed = rows.join(F.broadcast(named), "table_")
    return placed.select("table_name", F.col("key").alias(key), F.col("path_").alias("path"), F.col("parent_").alias("parent"), "pos", F.col("kind_").alias("kind"), F.col("value_").alias("value"), cells.alias("cells"))


#: The child objects of a correction record: name, path, reference among the columns, whether a bare text counts.
CHILDREN = (
    ("edit", "edits", "id", False),
    ("alternative", "edits.alternatives", None, False),
    ("vote", "edits.alternatives.votes", None, False),
    ("review", "metadata.reviews", "reviewer", False),
    ("step", "metadata.reviews.steps", None, False),
    ("trigger", "expectations.input_must_trigger", "rule_id", True),
    ("span", "expectations.input_must_trigger.spans", None, False),
)


def child_objects(records: DataFrame, key: str = "rec_no") -> DataFrame:
    """(key, child, p1, p2, p3, ref): one row a child object of a correction record, from the flat tables; unused positions are 0."""
    fields = ["edits", "metadata", "expectations"]
    # Only edits may be an array at its root, opened or still a JSON string.
    single = lambda f: F.when(~F.col(f).rlike(r'^(?:\s|"|\\[nrt]?)*+\['), F.col(f)).alias(f)
    records = records.select(F.col(key).alias(key), "edits", single("metadata"), single("expectations"))
    nodes, _ = graph_of(records, fields, [path for _, path, _, _ in CHILDREN])
    wanted: dict[int, list[tuple[str, ...]]] = {}
    child = ref = bare = first = F.lit(None)
    for name, path, column, text in CHILDREN:
        if path not in nodes or nodes[path].table < 0:
            continue
        columns = wanted.setdefault(nodes[path].table, [])
        if column and (column,) not in columns:
            columns.append((column,))
        here = F.col("path_") == path
        named = F.when(F.col("kind_") == "OBJECT", F.get("cols", F.lit(columns.index((column,))))).otherwise(F.col("value_")) if column else F.lit(None)
        child, ref, bare = F.when(here, name).otherwise(child), F.when(here, named).otherwise(ref), F.when(here, F.lit(text)).otherwise(bare)
        # The roots of metadata and expectations have tables too, whose position is no part of the child's.
        first = F.when(here, F.lit(0 if path.startswith("edits") else 1)).otherwise(first)
    rows = filled(records, key, nodes, fields, wanted).withColumns({"child": child, "ref": ref, "bare": bare, "first": first})
    rows = rows.filter(F.col("child").isNotNull() & ((F.col("kind_") == "OBJECT") | F.col("bare") & (F.col("kind_") == "STRING")))
    at = [F.coalesce(F.get("pos", F.col("first") + i), F.lit(0)).cast("int").alias(f"p{i + 1}") for i in range(3)]
    return rows.select(F.col("key").alias(key), "child", *at, F.coalesce(F.col("ref").cast("string"), F.lit("")).alias("ref"))
