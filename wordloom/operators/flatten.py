"""Deeply nested JSON records to flat tables, by columnar shredding.

A record is laid over a schema and every leaf path becomes a column of
(repetition level, definition level, value) entries:

* the repetition level says which repeated ancestor an entry begins anew
  (0: a new record), so counting the entries at each level numbers the elements;
* the definition level says how many of the optional or repeated ancestors are
  present, so it tells null, missing and empty apart at every depth.

A flat table belongs to one repeated ancestor (or to the record itself).  Its rows,
and their keys into every ancestor, come from the level sequences alone.

Producers differ: a byte order mark, the record or a part of it as a JSON string, a
wrapper object around the record, one object where a list belongs, and other
spellings of a name (``weight-details``, ``weightDetails``) are all understood.  A lone
object counts as a list of one; null elements keep their place.  Strings and wrappers may
be nested at any depth, and a list of records gives a row each, numbered by ``record_no``.
A body that is null, empty, broken off or without a record has ``complete`` false and no
entries.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRAPPERS = ("report", "payload")


@dataclass
class Node:
    """A field of the schema: a leaf, an object or a list, with its levels."""

    name: str
    path: str
    kind: T.DataType
    repetition: int
    definition: int
    repeated: bool
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> Iterator[Node]:
        if not self.children:
            yield self
        for child in self.children:
            yield from child.leaves()


def schema_tree(schema: T.StructType, path: str = "", repetition: int = 0, definition: int = 0) -> list[Node]:
    """Nodes of a schema; every field is optional, lists may hold nulls."""
    nodes = []
    for f in schema.fields:
        kind, repeated = f.dataType, isinstance(f.dataType, T.ArrayType)
        here = f"{path}.{f.name}" if path else f.name
        # present; for a list also: holds an element; and that element is not null
        level = definition + (3 if repeated else 1)
        rep = repetition + repeated
        if repeated:
            kind = kind.elementType
        node = Node(f.name, here, kind, rep, level, repeated)
        if isinstance(kind, T.StructType):
            node.children = schema_tree(kind, here, rep, level)
        nodes.append(node)
    return nodes


@lru_cache(maxsize=4096)
def _plain(name: str) -> str:
    """snake_case of a field name."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").lower()


_BLANK = "\ufeff \t\r\n"


def _opened(value: object) -> object:
    """A string that holds a JSON object, list or string, as that, however often it is
    written so: each time it gets shorter."""
    while isinstance(value, str) and value.lstrip(_BLANK)[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value.lstrip(_BLANK))
        except (ValueError, RecursionError):
            break
    return value


def parse_records(body: str | None, nodes: list[Node], wrappers: tuple[str, ...] = WRAPPERS) -> list[dict]:
    """The records of a body in order, out of their lists and wrappers; none if it is not
    complete.  What is neither record nor wrapper, in a list, is passed over."""
    if not body:
        return []
    try:
        todo = [json.loads(body.lstrip(_BLANK))]
    except (ValueError, RecursionError):
        return []
    known = {n.name for n in nodes}
    found = []
    while todo:
        value = _opened(todo.pop())
        if isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            named = {_plain(k): v for k, v in value.items()}
            inner = [v for k, v in named.items() if k in wrappers]
            if known & named.keys() or len(inner) != 1:
                found.append(named)
            else:
                todo.append(inner[0])
    return found


def parse_record(body: str | None, nodes: list[Node], wrappers: tuple[str, ...] = WRAPPERS) -> dict | None:
    """The first record of a body; None if it is not complete."""
    return next(iter(parse_records(body, nodes, wrappers)), None)


def _leaf(value: object, kind: T.DataType) -> object:
    """A JSON scalar as the leaf's type; what does not fit is null."""
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        number = float(value)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return number
        whole = int(value) if not isinstance(value, float) else int(number)
        return whole if -(2**63) <= whole < 2**63 else None
    except (ValueError, OverflowError):
        return None


Columns = dict[str, tuple[list[int], list[int], list]]


def shred(record: dict, nodes: list[Node], out: Columns, rep: int = 0, definition: int = 0) -> None:
    """Append the entries of one record (or object) to the leaf columns."""
    named = {_plain(k): v for k, v in record.items()}
    for node in nodes:
        value = named.get(node.name)
        if value is not None and (node.children or node.repeated):
            value = _opened(value)
        if not node.repeated:
            if value is None or (node.children and not isinstance(value, dict)):
                _absent(node, out, rep, definition)
            elif node.children:
                shred(value, node.children, out, rep, node.definition)
            else:
                _entry(node, out, rep, node.definition, _leaf(value, node.kind))
            continue
        if value is None or (node.children and not isinstance(value, (dict, list))):
            _absent(node, out, rep, definition)
            continue
        items = value if isinstance(value, list) else [value]
        if not items:
            _absent(node, out, rep, definition + 1)
        for i, item in enumerate(items):
            r = rep if i == 0 else node.repetition
            item = _opened(item) if node.children else item
            if item is None or (node.children and not isinstance(item, dict)):
                _absent(node, out, r, definition + 2)
            elif node.children:
                shred(item, node.children, out, r, node.definition)
            else:
                _entry(node, out, r, node.definition, _leaf(item, node.kind))


def _entry(node: Node, out: Columns, rep: int, definition: int, value: object) -> None:
    reps, defs, values = out[node.path]
    reps.append(rep)
    defs.append(definition)
    values.append(value)


def _absent(node: Node, out: Columns, rep: int, definition: int) -> None:
    for leaf in node.leaves():
        _entry(leaf, out, rep, definition, None)


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int64(), "double": pa.float64(), "float": pa.float64()}


def _leaf_type(node: Node) -> T.DataType:
    name = node.kind.simpleString()
    return T.StringType() if name not in _ARROW else T.LongType() if name == "int" else T.DoubleType() if name == "float" else node.kind


def _pruned(nodes: list[Node], wanted: set[str]) -> list[Node]:
    """The nodes that lead to the wanted leaves."""
    out = []
    for n in nodes:
        if n.children:
            if below := _pruned(n.children, wanted):
                out.append(replace(n, children=below))
        elif n.path in wanted:
            out.append(n)
    return out


def shred_json(rows: DataFrame, schema: T.StructType, *, body: str = "body", keep: list[str] | None = None, wrappers: tuple[str, ...] = WRAPPERS, only: str | None = None) -> DataFrame:
    """One row per record, or per body without one: the columns ``keep``, ``complete``,
    ``record_no`` (place of the record in its body, null without one), and one struct column
    per leaf path (dots as ``__``) with the arrays r, d (levels) and v (values).

    ``only``: an ancestor whose :func:`table` is all that is wanted; other leaves are not
    made.  By default all columns are kept but the body and any named like an output."""
    keep = keep if keep is not None else [c for c in rows.columns if c not in (body, "complete", "record_no")]
    nodes = schema_tree(schema)
    chosen = nodes if only is None else _pruned(nodes, {n.path for n in _columns(schema, only)[1]})
    leaves = [leaf for n in chosen for leaf in n.leaves()]
    src = rows.select(*keep, F.col(body).cast("string").alias("__body"))

    def column(leaf: Node) -> T.StructType:
        return T.StructType([T.StructField("r", T.ArrayType(T.ByteType())), T.StructField("d", T.ArrayType(T.ByteType())), T.StructField("v", T.ArrayType(_leaf_type(leaf)))])

    out = T.StructType([*(src.schema[c] for c in keep), T.StructField("complete", T.BooleanType()), T.StructField("record_no", T.IntegerType()), *(T.StructField(leaf.path.replace(".", "__"), column(leaf)) for leaf in leaves)])
    kinds = {leaf.path: _ARROW[_leaf_type(leaf).simpleString()] for leaf in leaves}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                flat: Columns = {leaf.path: ([], [], []) for leaf in leaves}
                owner, place = [], []
                counts = {leaf.path: [0] for leaf in leaves}
                for row, text in enumerate(part.column(len(keep)).to_pylist()):
                    for number, record in enumerate(parse_records(text, nodes, wrappers) or [None]):
                        owner.append(row)
                        place.append(None if record is None else number)
                        if record is not None:
                            shred(record, chosen, flat)
                        for path, c in counts.items():
                            c.append(len(flat[path][0]))
                arrays = []
                for leaf in leaves:
                    r, d, v = flat[leaf.path]
                    offsets = pa.array(counts[leaf.path], pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(r, pa.int8())), pa.ListArray.from_arrays(offsets, pa.array(d, pa.int8())), pa.ListArray.from_arrays(offsets, pa.array(v, kinds[leaf.path]))]
                    arrays.append(pa.StructArray.from_arrays(lists, names=["r", "d", "v"]))
                take = pa.array(owner, pa.int64())
                number = pa.array(place, pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns[:-1]), number.is_valid(), number, *arrays], names=[f.name for f in out.fields])

    return src.mapInArrow(run, out)


def ordinals(reps: np.ndarray, depth: int) -> list[np.ndarray]:
    """0-based place of each entry at repetition levels 1..depth, from repetition levels."""
    places = []
    for level in range(1, depth + 1):
        # entries that begin an element of this level, counted since its parent began
        count = np.cumsum(reps == level)
        start = np.maximum.accumulate(np.where(reps < level, np.arange(len(reps)), 0))
        places.append(count - count[start])
    return places


def _columns(schema: T.StructType, ancestor: str) -> tuple[list[Node], list[Node]]:
    """The nodes on the way to an ancestor, and the leaves of its table."""
    every: dict[str, Node] = {}

    def walk(nodes: list[Node]) -> None:
        for n in nodes:
            every[n.path] = n
            walk(n.children)

    walk(schema_tree(schema))
    parts = ancestor.split(".") if ancestor else []
    chain = [every[".".join(parts[: i + 1])] for i in range(len(parts))]
    depth = sum(n.repeated for n in chain)
    if chain and chain[-1].repeated and not chain[-1].children:
        # a list of plain values: the element is the row's only column
        below = [chain[-1]]
    else:
        below = [n for n in every.values() if not n.children and not n.repeated and n.repetition == depth and (n.path.startswith(ancestor + ".") if ancestor else True)]
    if not below:
        raise ValueError(f"{ancestor or 'the record'} has no leaves of its own")
    return chain, below


def table(shredded: DataFrame, schema: T.StructType, ancestor: str, *, keys: list[str], with_null_elements: bool = False) -> DataFrame:
    """The flat table of one repeated (or optional) ancestor.

    ``ancestor``: path of a list or object ('' for the record).  A row per present element:
    the columns ``keys`` of the input row, ``<list>_no`` for each list on the way (the
    ancestor included), and the leaves directly or by objects below it, named by their path
    from the ancestor.  Null elements have no row unless ``with_null_elements``; they keep
    their number either way.
    """
    chain, below = _columns(schema, ancestor)
    lists = [n for n in chain if n.repeated]
    depth = len(lists)
    level = chain[-1].definition if chain else 0
    if with_null_elements and chain and chain[-1].repeated:
        level -= 1
    src = shredded.where("complete").select(*keys, *[n.path.replace(".", "__") for n in below])
    name = {n.path: n.name if n.path == ancestor else n.path[len(ancestor) + 1 if ancestor else 0 :].replace(".", "_") for n in below}
    out = T.StructType([*(shredded.schema[k] for k in keys), *(T.StructField(f"{n.name}_no", T.IntegerType()) for n in lists), *(T.StructField(name[n.path], _leaf_type(n)) for n in below)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [batch.column(len(keys) + j) for j in range(len(below))]
            lead = cells[0]
            r = lead.field("r")
            offsets = r.offsets.to_numpy()
            size = np.diff(offsets)
            reps = r.flatten().to_numpy(zero_copy_only=False)
            defs = lead.field("d").flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), size)
            chosen = np.flatnonzero(defs >= level)
            places = ordinals(reps, depth)
            take = pa.array(chosen)
            values = [c.field("v").flatten().take(take) for c in cells]
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(owner[chosen])) for j in range(len(keys))), *(pa.array(p[chosen], pa.int32()) for p in places), *values], names=[f.name for f in out.fields])

    return src.mapInArrow(run, out)


_TIME = T.StructType([T.StructField("secs", T.LongType()), T.StructField("subsec_nanos", T.LongType())])
_SUMMARY = [*"total_words first_position top_five any_position no_suggestions only_wrong false_accept true_positive false_negative true_negative".split()]
_TITLE = T.StructField("title", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("value", T.StringType())])))


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: Who made the speller: titles are lists, so each has a table of its own.
_METADATA = T.StructType(
    [
        T.StructField("info", T.StructType([*_texts("locale"), _TITLE, *_texts("description", "producer")])),
        T.StructField("acceptor", T.StructType([*_texts("type", "id"), _TITLE, *_texts("description", "continuation")])),
        T.StructField("errmodel", T.StructType([*_texts("id"), _TITLE, *_texts("description")])),
    ]
)
_CONFIG = T.StructType(
    [
        T.StructField("n_best", T.LongType()),
        T.StructField("max_weight", T.DoubleType()),
        T.StructField("beam", T.DoubleType()),
        T.StructField("recase", T.BooleanType()),
        T.StructField("reweight", T.StructType([T.StructField(n, T.DoubleType()) for n in ("start_penalty", "end_penalty", "mid_penalty")])),
        T.StructField("node_pool_size", T.LongType()),
        T.StructField("completion_marker", T.StringType()),
        *(T.StructField(n, T.BooleanType()) for n in ("astar_lookahead", "search_dedup", "mutator_subsets")),
    ]
)
#: The record of one evaluation run.
REPORT = T.StructType(
    [
        T.StructField("metadata", _METADATA),
        T.StructField("config", _CONFIG),
        T.StructField("summary", T.StructType([*(T.StructField(n, T.LongType()) for n in _SUMMARY), *(T.StructField(n, _TIME) for n in ("slowest_lookup", "fastest_lookup", "average_time", "average_time_95pc")), T.StructField("average_position_of_correct", T.DoubleType()), T.StructField("average_suggestions_for_correct", T.DoubleType())])),
        T.StructField("start_timestamp", _TIME),
        T.StructField("total_time", _TIME),
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("input", T.StringType()),
                        T.StructField("expected", T.StringType()),
                        T.StructField("distance", T.LongType()),
                        T.StructField("position", T.LongType()),
                        T.StructField("time", _TIME),
                        T.StructField("false_accept", T.BooleanType()),
                        T.StructField("note", T.StructType([T.StructField("seen_by", T.ArrayType(T.StringType()))])),
                        T.StructField(
                            "suggestions",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("value", T.StringType()),
                                        T.StructField("weight", T.DoubleType()),
                                        T.StructField("completed", T.BooleanType()),
                                        T.StructField("weight_details", T.StructType([T.StructField(n, T.DoubleType()) for n in ("lexicon_weight", "mutator_weight", "reweight_start", "reweight_mid", "reweight_end")])),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)


def first_copies(shredded: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The complete rows that come first for their key, by ``order``: copies of a record
    are equal in content, so one stands for all; records of one body stay together.

    One pass: Spark keeps only the first of each key on the map side, so a key with many
    copies does not meet in one task."""
    place = F.rank().over(Window.partitionBy(key).orderBy(*order))
    return shredded.where("complete").withColumn("__place", place).where("__place = 1").drop("__place")
