"""Deeply nested JSON records as related flat tables.

Method: every record is read once as a stream of tokens and gives triples of path, value and ordinal; a path is cut at
its innermost list element (the repeated ancestor), which is the row the value belongs to; the triples of one such row
are then pivoted into columns. Rows know their parent by its address, so tables can be joined again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))'
)
END = re.compile(r"[ \t\n\r]*\Z")
TRIPLES = "table_name string, address string, parent string, ordinal int, column_name string, kind string, value string"

#: Names of lists of the tree files: where the tree begins, what its children are called, and lists that may be a single object.
TOPS, CHILDREN, LISTS = ("structure", "hierarchy"), "nodes", ("nodes", "structure", "hierarchy", "blocks", "refs")

Triple = tuple[str, str, str, int, str | None, str, str | None]


class Invalid(ValueError):
    pass


class _Frame:
    __slots__ = ("is_list", "table", "address", "parent", "ordinal", "prefix", "name", "count", "key", "spans", "begun")

    def __init__(self, is_list: bool, table: str, address: str, parent: str, ordinal: int, prefix: str, name: str):
        self.is_list, self.table, self.address, self.parent, self.ordinal, self.prefix, self.name = is_list, table, address, parent, ordinal, prefix, name
        self.count, self.key, self.spans, self.begun = 0, None, {}, 0


def triples(text: str, tops: tuple[str, ...] = TOPS, children: str = CHILDREN, lists: tuple[str, ...] = LISTS) -> list[Triple]:
    """(table, address, parent address, ordinal, column, kind, value) of every object and plain value of one JSON text.

    The tree's nodes have addresses like 0.2.1, other list elements address/list.position. Values keep their JSON
    spelling, strings without quotes and escapes. Of repeated keys the last counts. Raises Invalid if it is not JSON."""
    out: list[Triple | None] = []
    stack: list[_Frame] = []
    pos, size, expect, root = 0, len(text), "value", None
    while True:
        m = TOKEN.match(text, pos)
        if not m:
            if expect == "end" and END.match(text, pos):
                break
            raise Invalid(f"at {pos}")
        pos = m.end()
        mark, string, number, word = m.groups()
        if expect == "end":
            raise Invalid(f"more after the end at {pos}")
        if expect in ("key", "key or }") and string:
            stack[-1].key = _plain(string)
            expect = ":"
        elif expect == ":" and mark == ":":
            expect = "value"
        elif mark in ("}", "]") and (expect == ", or end" or expect == ("value or ]" if mark == "]" else "key or }")):
            frame = stack.pop()
            if frame.is_list != (mark == "]"):
                raise Invalid(f"wrong bracket at {pos}")
            expect = _after(stack, out)
        elif mark == "," and expect == ", or end":
            expect = "value" if stack[-1].is_list else "key"
        elif expect in ("value", "value or ]") and mark in ("{", "[", None):
            top = stack[-1] if stack else None
            table, address, parent, ordinal, column = _place(top, mark == "{", children, lists)
            if top is not None:
                top.begun = len(out)
            else:
                root = "list" if mark == "[" else "object" if mark == "{" else "value"
            if mark == "{":
                if column is None:
                    out.append((table, address, parent, ordinal, None, "object", None))
                    stack.append(_Frame(False, table, address, parent, ordinal, "", ""))
                else:
                    stack.append(_Frame(False, table, address, parent, ordinal, column + ".", ""))
                expect = "key or }"
            elif mark == "[":
                name = "" if top is None or top.is_list else top.prefix + top.key
                stack.append(_Frame(True, top.table if top else "file", top.address if top and not top.is_list else address, parent, ordinal, "", name))
                if top is not None and not top.is_list and top.address == "" and top.key in tops:
                    out.append(("file", "", "", 0, name, "list", None))
                expect = "value or ]"
            else:
                kind = "string" if string else "number" if number else "null" if word == "null" else "boolean"
                out.append((table, address, parent, ordinal, column or "", kind, _plain(string) if string else number or (None if word == "null" else word)))
                expect = _after(stack, out)
        else:
            raise Invalid(f"unexpected token at {pos}")
        if pos >= size and expect == "end":
            break
    return _from_top([t for t in out if t is not None], root, tops)


def _plain(token: str) -> str:
    if "\\" not in token:
        return token[1:-1]
    return json.loads(token).encode("utf-8", "replace").decode("utf-8") if "\\u" in token else json.loads(token)


def _after(stack: list[_Frame], out: list) -> str:
    """After a whole value: count it, and drop what an earlier value of the same key had given."""
    if not stack:
        return "end"
    f = stack[-1]
    if f.is_list:
        f.count += 1
    else:
        if f.key in f.spans:
            a, b = f.spans[f.key]
            out[a:b] = [None] * (b - a)
        f.spans[f.key] = (f.begun, len(out))
    return ", or end"


def _place(top: _Frame | None, is_object: bool, children: str, lists: tuple[str, ...]) -> tuple[str, str, str, int, str | None]:
    """Where the next value belongs; column None for an object that is a row of its own."""
    if top is None:
        return "file", "", "", 0, None
    if top.is_list:
        i = top.count
        if top.name == children and top.table == children:
            address = f"{top.address}.{i}"
        else:
            address = f"{top.address}/{top.name}.{i}"
        return _table(top), address, top.address, i, None if is_object else ""
    column = top.prefix + top.key
    if is_object and top.key in lists:
        list_frame = _Frame(True, top.table, top.address, "", 0, "", column)
        return _place(list_frame, True, children, lists)
    return top.table, top.address, top.parent, top.ordinal, column


def _table(f: _Frame) -> str:
    if f.address == "" and f.name in ("", *TOPS):
        return CHILDREN
    return f.name or "item"


def _from_top(found: list[Triple], root: str | None, tops: tuple[str, ...]) -> list[Triple]:
    """Addresses counted from the list the tree begins with: the file itself, or the first of `tops` that is one."""
    if root == "list":
        cut = "/."
    else:
        has = {t[4] for t in found if t[0] == "file" and t[5] == "list"} | {t[1][1:].partition(".")[0] for t in found if t[5] == "object" and t[1].startswith("/") and t[1].endswith(".0") and t[1].count("/") == 1}
        top = next((t for t in tops if t in has), None)
        if top is None:
            return [_single(t) for t in found] if root == "object" else found
        cut = f"/{top}."
    n = len(cut)

    def strip(a: str) -> str:
        return a[n:] if a.startswith(cut) else a

    return [(t[0] if t[1].startswith(cut) or t[0] != CHILDREN else "item", strip(t[1]), strip(t[2]), *t[3:]) for t in found if t[5] != "list"]


def _single(t: Triple) -> Triple:
    """A file that is one node: it is at 0, and what it holds below."""

    def move(a: str) -> str:
        return "0" if a == "" else "0." + a[len("/nodes.") :] if a.startswith(f"/{CHILDREN}.") else "0" + a

    if t[0] == "file":
        return (CHILDREN, "0", "", *t[3:])
    return (t[0], move(t[1]), move(t[2]), *t[3:])


def json_triples(df: DataFrame, key: str = "doc_id", text: str = "raw_json") -> DataFrame:
    """`key` and the triples of each record's JSON, in the order they are read (see `triples`).

    A null text and one that is not valid JSON give none; rows of one key are read each, and their equal triples fall
    together when pivoted. Records are read one by one without a shuffle, however deep; other columns are not read."""
    src = df.select(key, text)
    schema = f"`{key}` {src.schema[key].dataType.simpleString()}, {TRIPLES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, found = [], []
                for r, s in enumerate(part.column(1).to_pylist()):
                    try:
                        got = triples(s) if s else []
                    except Invalid:
                        continue
                    rows += [r] * len(got)
                    found += got
                if found:
                    cols = list(zip(*found))
                    text_ = pa.string()
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows, pa.int32())), pa.array(cols[0], text_), pa.array(cols[1], text_), pa.array(cols[2], text_), pa.array(cols[3], pa.int32()), pa.array(cols[4], text_), pa.array(cols[5], text_), pa.array(cols[6], text_)],
                        names=[key, "table_name", "address", "parent", "ordinal", "column_name", "kind", "value"],
                    )

    return src.mapInArrow(run, schema)


def whole_number(value: Column) -> Column:
    """An int out of 12, 12.0 or "12"; null from anything else."""
    d = value.try_cast("double")
    return F.when(d == F.floor(d), d.cast("int"))


def pivot_table(found: DataFrame, name: str, columns: dict[str, str], key: str = "doc_id") -> DataFrame:
    """One flat table: a row for each object of the list `name`, by key and address, with parent, ordinal and `columns`
    (name in the JSON -> type). One shuffle, on key and address, after partial aggregation; no hot groups, as a group
    is one object."""

    def value(c: str, kind: str) -> Column:
        v = F.max(F.when(F.col("column_name") == c, F.col("value")))
        return (whole_number(v) if kind == "int" else v.cast(kind)).alias(c)

    return (
        found.where(F.col("table_name") == name)
        .groupBy(key, "address", "parent", "ordinal")
        .agg(F.max(F.col("kind") == "object").alias("_object"), *(value(c, k) for c, k in columns.items()))
        .where("_object")
        .drop("_object")
    )


def tree_nodes(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The nodes of the tree: key, node_path, parent_path ('' at the top), ordinal, node_id, title, start_index, end_index, summary."""
    cols = {"node_id": "string", "title": "string", "start_index": "int", "end_index": "int", "summary": "string"}
    rows = pivot_table(found, CHILDREN, cols, key).where(F.col("address").rlike(r"^[0-9]+(\.[0-9]+)*$"))
    return rows.select(key, F.col("address").alias("node_path"), F.col("parent").alias("parent_path"), "ordinal", *cols)


def tree_lists(found: DataFrame, name: str, columns: dict[str, str], key: str = "doc_id") -> DataFrame:
    """The objects of a list inside nodes (or inside elements of such a list), with their parent's address."""
    return pivot_table(found, name, columns, key).withColumnRenamed("parent", "parent_path").withColumnRenamed("address", "item_path")
