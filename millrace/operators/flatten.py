"""Nested JSON records to flat related tables by shared inlining.

Pass one reads the schema graph of the data: which element (the key an object stands under) occurs
inside which, and whether in a list.  From that graph alone the relations follow: an element gets a
table of its own if it is repeated, if several different elements hold it (shared), or if it can
hold itself (recursive); every other object is inlined into the row of the object around it.  Pass
two shreds the records and gives each row its own path, the path of the row it belongs to and the
path of the nearest list element around it.

The graph has one edge per pair of key names, is reduced by a distributed aggregation and its size
is checked before the driver reads it.  Records never meet each other, so no task depends on skew;
only repeated deliveries of one record are merged, after shredding, on narrow rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

#: Keys whose value is a list by contract, even where a single object stands there.
LIST_KEYS = frozenset(
    "aggregations all any attachments columns documents entries filters hits messages notes options reservations sections sort "
    "spans toolCalls toolRequests units warnings".split()
)
ROOT = "$"
MAX_EDGES = 200_000


def read_json(text: str | None) -> object:
    """The JSON value of ``text``; None if it is null or can't be read."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except RecursionError:
        return _read_deep(text)
    except ValueError:
        return None


_TOKEN = re.compile(r"[ \t\r\n]*(?:([\[\]{},:])|(\")|([^ \t\r\n\[\]{},:\"]+))")
_BLANK = re.compile(r"[ \t\r\n]*")


def _read_deep(text: str) -> object:
    """The JSON value of a text that nests deeper than the interpreter's stack; None if it can't be read.

    Open lists and objects are kept on an explicit stack.  ``wanted`` names what may come next.
    """
    stack: list[dict | list] = []
    keys: list[str] = []
    root: object = None
    at, wanted = 0, "value"
    while wanted != "end":
        token = _TOKEN.match(text, at)
        if not token:
            return None
        at, mark = token.end(), token[1]
        value: object = None
        try:
            if mark and mark in "[{" and wanted in ("value", "value or close"):
                value = [] if mark == "[" else {}
            elif mark and mark in "]}" and stack and wanted in ("value or close", "key or close", "comma") and (type(stack[-1]) is list) == (mark == "]"):
                stack.pop()
                wanted = "comma" if stack else "end"
                continue
            elif mark == "," and wanted == "comma":
                wanted = "value" if type(stack[-1]) is list else "key"
                continue
            elif mark == ":" and wanted == "colon":
                wanted = "value"
                continue
            elif token[2] and wanted in ("key", "key or close"):
                key, at = scanstring(text, at)
                keys.append(key)
                wanted = "colon"
                continue
            elif token[2] and wanted in ("value", "value or close"):
                value, at = scanstring(text, at)
            elif token[3] and wanted in ("value", "value or close"):
                value = json.loads(token[3])
            else:
                return None
        except ValueError:
            return None
        if not stack:
            root = value
        elif type(stack[-1]) is list:
            stack[-1].append(value)
        else:
            stack[-1][keys.pop()] = value
        if mark:
            stack.append(value)
            wanted = "value or close" if mark == "[" else "key or close"
        else:
            wanted = "comma" if stack else "end"
    return root if _BLANK.fullmatch(text, at) else None


def opened(value: object) -> object:
    """``value``, or the object or list it spells if it is a string with such JSON in it."""
    while type(value) is str:
        head = value.lstrip()[:1]
        if head != "{" and head != "[" and head != '"':
            return value
        inner = read_json(value)
        if type(inner) is str and head == '"' and type(opened(inner)) is not str:
            value = inner
        elif type(inner) is dict or type(inner) is list:
            return inner
        else:
            return value
    return value


def objects(record: object, list_keys: frozenset[str] = LIST_KEYS) -> Iterator[tuple[str, str, str, str, bool, int, dict]]:
    """All objects of a record, outer before inner.

    Yields element name, path, path of the nearest list element around it, name of the object around
    it, whether it is a list element, its index and the object.  The record itself comes first with
    an empty path.  Explicit stack: nesting may be deeper than the interpreter's.
    """
    # An entry: value, element name, path, nearest list element, name of the object around, index in a list or None.
    stack: list[tuple[object, str, str, str, str, int | None]] = [(opened(record), ROOT, "", "", "", None)]
    while stack:
        value, name, path, near, around, index = stack.pop()
        kind = type(value)
        if kind is dict:
            if index is None and name in list_keys:
                index, path = 0, f"{path}[0]"
            yield name, path, near, around, index is not None, index or 0, value
            below = path if index is not None else near
            prefix = f"{path}." if path else ""
            inner = []
            for key, child in value.items():
                child_kind = type(child)
                if child_kind is str:
                    child = opened(child)
                    child_kind = type(child)
                if child_kind is dict or child_kind is list:
                    inner.append((child, key, prefix + key, below, name, None))
            stack.extend(reversed(inner))
        elif kind is list:
            inner = []
            for at, child in enumerate(value):
                child_kind = type(child)
                if child_kind is str:
                    child = opened(child)
                    child_kind = type(child)
                if child_kind is dict or child_kind is list:
                    inner.append((child, name, f"{path}[{at}]", near, around, at))
            stack.extend(reversed(inner))


def schema_graph(records: DataFrame, json_column: str, list_keys: frozenset[str] = LIST_KEYS) -> DataFrame:
    """Edges of the schema graph: around, element, repeated, records.  One row per pair of names."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, bool], int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                value = opened(read_json(text))
                if value is None:
                    continue
                for edge in {(around, name, in_list) for name, _, _, around, in_list, _, _ in objects(value, list_keys)}:
                    found[edge] = found.get(edge, 0) + 1
        rows = list(found.items())
        yield pa.RecordBatch.from_pydict(
            {"around": [k[0] for k, _ in rows], "element": [k[1] for k, _ in rows], "repeated": [k[2] for k, _ in rows], "records": [n for _, n in rows]},
            schema=pa.schema([("around", pa.string()), ("element", pa.string()), ("repeated", pa.bool_()), ("records", pa.int64())]),
        )

    edges = spread(records.select(json_column)).mapInArrow(scan, "around string, element string, repeated boolean, records long")
    return edges.groupBy("around", "element").agg(F.max("repeated").alias("repeated"), F.sum("records").alias("records"))


def relations(edges: Iterable[tuple[str, str, bool]]) -> dict[str, str]:
    """Elements that get a table, with the reason: root, repeated, shared or recursive."""
    holders: dict[str, set[str]] = {}
    inside: dict[str, set[str]] = {}
    reason: dict[str, str] = {}
    for around, element, repeated in edges:
        if element == ROOT:
            reason[ROOT] = "root"
            continue
        holders.setdefault(element, set()).add(around)
        inside.setdefault(around, set()).add(element)
        if repeated:
            reason[element] = "repeated"
    for element, around in holders.items():
        if element in reason:
            continue
        if len(around) > 1:
            reason[element] = "shared"
            continue
        seen, todo = set(), [element]
        while todo:
            for below in inside.get(todo.pop(), ()):
                if below not in seen:
                    seen.add(below)
                    todo.append(below)
        if element in seen:
            reason[element] = "recursive"
    return reason


def read_graph(graph: DataFrame, most: int = MAX_EDGES) -> list[tuple[str, str, bool]]:
    """The schema graph on the driver; an error if key names are data, so that it isn't small."""
    rows = graph.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pairs of element names: keys hold data; name them first")
    return [(r["around"], r["element"], r["repeated"]) for r in rows]


def _scalar(value: object) -> str | None:
    if value is None:
        return None
    return value if type(value) is str else json.dumps(value, ensure_ascii=False)


def _inline(value: dict, tables: dict[str, str], list_keys: frozenset[str]) -> dict[str, str | None]:
    """Columns of a row: its scalars, lists of scalars as JSON, and those of objects without a table."""
    columns: dict[str, str | None] = {}
    todo = [("", value)]
    while todo:
        prefix, at = todo.pop()
        for key, child in at.items():
            child = opened(child)
            if type(child) is dict:
                if key not in tables and key not in list_keys:
                    todo.append((f"{prefix}{key}.", child))
            elif type(child) is list:
                if not any(type(opened(x)) in (dict, list) for x in child):
                    columns[prefix + key] = _scalar(child)
            else:
                columns[prefix + key] = _scalar(child)
    return columns


def shred(
    records: DataFrame, id_column: str, json_column: str, tables: dict[str, str] | None, with_columns: bool = True, list_keys: frozenset[str] = LIST_KEYS
) -> DataFrame:
    """Rows of all tables: table_name, record_id, node_path, parent_path, owner_path, is_element, ordinal, columns.

    owner_path is the row's foreign key: the path of the nearest object around it that has a table
    (the record's own row has the empty path).  A record whose id or JSON is null or unreadable
    gives no rows.  Without ``tables`` every element of a list has a row, and other objects have none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("table_name", pa.string()), ("record_id", pa.string()), ("node_path", pa.string()), ("parent_path", pa.string())]
        fields += [("owner_path", pa.string()), ("is_element", pa.bool_()), ("ordinal", pa.int32())]
        if with_columns:
            fields.append(("columns", pa.string()))
        schema = pa.schema(fields)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = opened(read_json(text)) if key is not None else None
                if value is None:
                    continue
                owners: list[str] = []
                for name, path, near, _, in_list, index, node in objects(value, list_keys):
                    if not in_list if tables is None else name not in tables:
                        continue
                    while owners and not (owners[-1] == "" or path.startswith((owners[-1] + ".", owners[-1] + "["))):
                        owners.pop()
                    row = [name, key, path, near, owners[-1] if owners else None, in_list, index]
                    if with_columns:
                        row.append(json.dumps(_inline(node, tables or {}, list_keys), ensure_ascii=False, sort_keys=True))
                    for column, cell in zip(out, row, strict=True):
                        column.append(cell)
                    owners.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(out, fields, strict=True)], schema=schema)

    wide = "table_name string, record_id string, node_path string, parent_path string, owner_path string, is_element boolean, ordinal int"
    rows = spread(records.select(F.col(id_column).cast("string"), F.col(json_column).cast("string"))).mapInArrow(run, wide + (", columns string" if with_columns else ""))
    return rows


def flat_tables(records: DataFrame, id_column: str, json_column: str, with_columns: bool = True) -> DataFrame:
    """Analyse, then shred: the rows of every relation, each once."""
    tables = relations(read_graph(schema_graph(records, json_column)))
    return shred(records, id_column, json_column, tables, with_columns).distinct()


def list_elements(records: DataFrame, id_column: str, json_column: str, most: int = MAX_EDGES) -> DataFrame:
    """record_id, node_path, parent_path of every object that is an element of a list.

    Elements of lists are repeated, so each has a table; a schema graph of more than ``most`` edges,
    too large for the driver, isn't needed to know that.
    """
    graph = schema_graph(records, json_column)
    try:
        tables = relations(read_graph(graph, most))
    except ValueError:
        tables = None
    rows = shred(records, id_column, json_column, tables, with_columns=False)
    return rows.where("is_element").select("record_id", "node_path", "parent_path").distinct()
