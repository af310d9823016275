"""Deeply nested JSON as flat tables, by columnar shredding with repetition and definition levels."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANKS = "﻿ \t\r\n   \u0000"
_BOX = ("x_min", "y_min", "width", "height")


# ---------------------------------------------------------------- reading
def read_payload(text: str | None) -> dict | None:
    """The object of a payload; None where it can't be read.

    Blanks and byte order marks around it are cut, JSON text inside a JSON string is unpacked, at
    any number of layers. Null, empty, cut-off texts and anything but an object can't be read.
    """
    while isinstance(text, str):
        text = text.strip(_BLANKS)
        if not text:
            return None
        try:
            text = json.loads(text)
        except RecursionError:
            text = _deep_loads(text)
        except ValueError:
            return None
    return text if isinstance(text, dict) else None


_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|([^\s{}\[\],:"]+))')


def _deep_loads(text: str) -> Any:
    """json.loads for nesting beyond the interpreter's recursion limit; None where the text is no JSON."""
    root: list = []
    stack: list[Any] = [root]
    keys: list[str | None] = [None]
    at, n = 0, len(text.rstrip())
    want_key = False
    while at < n:
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        mark, string, word = m.groups()
        top = stack[-1]
        if mark in ("}", "]"):
            if len(stack) == 1 or isinstance(top, dict) != (mark == "}"):
                return None
            stack.pop()
            keys.pop()
            want_key = False
            continue
        if mark == ",":
            want_key = isinstance(top, dict)
            continue
        if mark == ":":
            want_key = False
            continue
        if mark:
            value: Any = {} if mark == "{" else []
        else:
            try:
                value = json.loads(string or word)
            except ValueError:
                return None
        if isinstance(top, dict) and want_key:
            if not string:
                return None
            keys[-1] = value
            continue
        if isinstance(top, dict):
            top[keys[-1]] = value
        else:
            top.append(value)
        if mark:
            stack.append(value)
            keys.append(None)
            want_key = mark == "{"
    return root[0] if len(stack) == 1 and len(root) == 1 else None


# ---------------------------------------------------------------- leaf values as text
def _number(x: Any) -> Decimal | None:
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, (int, float, str)):
        try:
            d = Decimal(str(x).strip())
        except InvalidOperation:
            return None
        return d if d.is_finite() else None
    return None


def _integer(x: Any) -> str | None:
    d = _number(x)
    if d is None or d != d.to_integral_value() or abs(d) >= 2**63:
        return None
    return str(int(d))


def _real(x: Any) -> str | None:
    d = _number(x)
    return None if d is None else repr(float(d))


def _hundredths(x: Any) -> str | None:
    d = _number(x)
    return None if d is None else str(int((d * 100).to_integral_value(ROUND_HALF_EVEN)))


def _text(x: Any) -> str | None:
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, bool):
        return "true" if x else "false"
    return json.dumps(x, ensure_ascii=False)


def _flag(x: Any) -> str | None:
    return _text(x) if isinstance(x, bool) or (isinstance(x, str) and x.lower() in ("true", "false")) else None


def _as_list(x: Any) -> list | None:
    return x if isinstance(x, list) or x is None else [x]


def _as_box(x: Any) -> list | None:
    return [x.get(k) for k in _BOX] if isinstance(x, dict) else _as_list(x)


#: Leaves of an annotation: path below it, how the value is written; lists are the repeated leaves.
_SCALARS = (("id",), _integer), (("category_id",), _integer), (("category_str",), _text), (("confidence",), _real), (("parent_id",), _integer), (("attributes", "occluded"), _flag)
_LISTS = (("bbox",), _as_box, _hundredths), (("attributes", "colors"), _as_list, _text), (("attributes", "position"), _as_list, _text), (("children_ids",), _as_list, _integer)
_IMAGE = (("id",), _integer), (("file_name",), _text), (("width",), _integer), (("height",), _integer), (("tags", "weather"), _text), (("tags", "time"), _text)


class Levels:
    """One leaf column: repetition levels, definition levels, values (None where the level is short)."""

    __slots__ = ("rep", "defn", "val", "full")

    def __init__(self, full: int) -> None:
        self.rep: list[int] = []
        self.defn: list[int] = []
        self.val: list[str | None] = []
        self.full = full  # the definition level of a present value

    def add(self, rep: int, defn: int, val: str | None = None) -> None:
        self.rep.append(rep)
        self.defn.append(defn)
        self.val.append(val)


def _walk(node: Any, path: tuple[str, ...]) -> tuple[Any, int]:
    """The value at ``path`` below ``node`` and how many of its steps are there."""
    for i, step in enumerate(path):
        node = node.get(step) if isinstance(node, dict) else None
        if node is None:
            return None, i
    return node, len(path)


def shred(records: list[dict | None]) -> tuple[dict[tuple, Levels], int]:
    """Leaf columns of a batch of payloads and the greatest depth of ``parts`` in it.

    A column's key is ``("image", path)`` or ``(depth, path)``: the annotations of depth 0 lie in
    ``annotations``, those of depth d + 1 in the ``parts`` of depth d, so ``(d, path)`` stands for
    annotations[].parts[]...parts[].path with d + 1 repeated steps; a list leaf has one more. Every
    column has at least one entry per record; an entry whose path ends early carries the
    definition level of the last step there. An unreadable record is an empty one.
    """
    cols: dict[tuple, Levels] = {("image", p): Levels(1 + len(p)) for p, _ in _IMAGE}
    level: list[tuple[int, int, Any]] = []  # (repetition level, definition level, annotation)
    for record in records:
        image = record.get("image") if record else None
        for p, write in _IMAGE:
            value, there = _walk(image, p)
            value = write(value) if there == len(p) else None
            cols["image", p].add(0, (0 if image is None else 1) + there, value)
        level += _elements(record, "annotations", 0, 0, 0)
    depth = 0
    while True:
        base = 2 * (depth + 1)  # each list counts when it is there and when it has an element
        for p, write in _SCALARS:
            col = cols[depth, p] = Levels(base + len(p))
            for rep, defn, node in level:
                value, there = (None, 0) if node is None else _walk(node, p)
                col.add(rep, defn + there, write(value) if there == len(p) else None)
        for p, cast, write in _LISTS:
            col = cols[depth, p] = Levels(base + len(p) + 1)
            for rep, defn, node in level:
                value, there = (None, 0) if node is None else _walk(node, p)
                items = cast(value) if there == len(p) else None
                if not items:
                    col.add(rep, defn + there)
                    continue
                for i, item in enumerate(items):
                    col.add(rep if i == 0 else depth + 2, defn + there + 1, write(item))
        if not any(isinstance(node, dict) and node.get("parts") for _, _, node in level):
            return cols, depth
        deeper: list[tuple[int, int, Any]] = []
        for rep, defn, node in level:
            deeper += _elements(node, "parts", rep, defn, depth + 1)
        level, depth = deeper, depth + 1


def _elements(node: Any, name: str, rep: int, defn: int, list_level: int) -> list[tuple[int, int, Any]]:
    """The elements of a list of objects, or the placeholder that keeps its owner's place."""
    items = node.get(name) if isinstance(node, dict) else None
    items = _as_list(items)
    if not items:
        return [(rep, defn + (items is not None), None)]
    return [(rep if i == 0 else list_level + 1, defn + 1 + isinstance(x, dict), x if isinstance(x, dict) else None) for i, x in enumerate(items)]


# ---------------------------------------------------------------- reconstruction
def _ordinals(rep: np.ndarray, upto: int) -> np.ndarray:
    """For every entry the number of the ancestor that repeats at level ``upto``: it changes where rep <= upto."""
    return np.cumsum(rep <= upto) - 1


def _object(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def rebuild(cols: dict[tuple, Levels], depth: int, record_ids: list) -> dict[str, list[tuple]]:
    """Tables per repeated ancestor, from the level sequences alone.

    ``images`` one row per record, ``annotations`` one per element that is an object, ``items`` one
    per item of a list leaf and one for the link to the parent. Each carries the record's key;
    ``node`` is the path of positions from the record to the annotation.
    """
    ids = _object(record_ids)
    image = [cols["image", p].val for p, _ in _IMAGE]
    images = list(zip(record_ids, *image, strict=True))
    annotations: list[tuple] = []
    items: list[tuple] = []
    above_id: np.ndarray | None = None
    above_node: np.ndarray | None = None
    for d in range(depth + 1):
        key = cols[d, ("id",)]
        rep = np.asarray(key.rep)
        exists = np.asarray(key.defn) >= 2 * (d + 1)
        record = _ordinals(rep, 0)
        owner = _ordinals(rep, d)  # the annotation of depth d - 1 in whose list this one lies
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(rep)) - first[owner]
        own_id = _object(key.val)
        spot = place.astype(str).astype(object)
        node = spot if d == 0 else above_node[owner] + "/" + spot
        owner_id = _object([None] * len(rep)) if d == 0 else above_id[owner]
        values = {p: cols[d, p].val for p, _ in _SCALARS}
        parent = [o if o is not None else p for o, p in zip(owner_id, values["parent_id",], strict=True)]
        for i in np.flatnonzero(exists):
            annotations.append((ids[record[i]], node[i], d, own_id[i], values["category_id",][i], values["category_str",][i], values["confidence",][i], values["attributes", "occluded"][i], parent[i]))
            if parent[i] is not None:
                items.append((ids[record[i]], node[i], own_id[i], "parent_id", 0, parent[i]))
        for p, _, _ in _LISTS:
            col = cols[d, p]
            r = np.asarray(col.rep)
            slot = _ordinals(r, d + 1)
            start = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            pos = np.arange(len(r)) - start[slot]
            full = np.asarray(col.defn) >= col.full
            name = ".".join(p)
            for i in np.flatnonzero(full):
                if col.val[i] is not None:
                    s = slot[i]
                    items.append((ids[record[s]], node[s], own_id[s], name, int(pos[i]), col.val[i]))
        above_id, above_node = own_id, node
    return {"images": images, "annotations": annotations, "items": items}


_TABLES: dict[str, list[tuple[str, str]]] = {
    "images": [("record_id", "bigint"), ("image_id", "bigint"), ("file_name", "string"), ("width", "bigint"), ("height", "bigint"), ("tags_weather", "string"), ("tags_time", "string")],
    "annotations": [("record_id", "bigint"), ("node", "string"), ("depth", "int"), ("annotation_id", "bigint"), ("category_id", "bigint"), ("category_str", "string"), ("confidence", "double"), ("occluded", "boolean"), ("parent_id", "bigint")],
    "items": [("record_id", "bigint"), ("node", "string"), ("annotation_id", "bigint"), ("field_name", "string"), ("pos", "int"), ("item_value", "string")],
}


#: Characters of payload that are shredded at once: parsed JSON takes many times its text.
SLICE_CHARS = 4_000_000


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(keys, parsed records) of the readable payloads, in slices of bounded size."""
    for batch in batches:
        keys, records, size = [], [], 0
        for k, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            record = read_payload(text)
            if record is None:
                continue
            keys.append(k.as_py())
            records.append(record)
            size += len(text)
            if size >= SLICE_CHARS:
                yield keys, records
                keys, records, size = [], [], 0
        if keys:
            yield keys, records


def nested_table(raw: DataFrame, name: str, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """One of the flat tables ``images``, ``annotations``, ``items`` of per-image JSON payloads.

    Every batch is shredded into leaf columns of (repetition level, definition level, value); the
    table is rebuilt from the level sequences, in the same task: no shuffle, and a record of any
    depth stays within one batch. ``items`` has the fields bbox (in hundredths), attributes.colors,
    attributes.position, children_ids and parent_id (the id of the annotation in whose parts it
    lies, else its own parent_id).

    Payloads that are null, empty, cut off or no objects give no rows; empty lists and null items
    give none either, but keep the positions of their neighbours. Numbers that can't be read are
    null. A file under two record ids comes out under both; a null record id stays null.
    """
    fields = _TABLES[name]
    schema = pa.schema([(c, pa.string() if t not in ("int", "bigint") or c not in ("record_id", "depth", "pos") else pa.int64() if t == "bigint" else pa.int32()) for c, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, records in _readable(batches):
            rows = rebuild(*shred(records), keys)[name]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    wire = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'int' if f.type == pa.int32() else 'string'}" for f in schema)
    flat = raw.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{payload}`").alias("p")).mapInArrow(run, wire)
    return flat.select(*(F.col(c).cast(t).alias(c) for c, t in fields))


def leaf_levels(raw: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """The shredded form itself: ``(record_id, depth, path, seq, rep, def, value)``, one row per column entry.

    ``depth`` is -1 for leaves of the image. Entries of a record keep their order in ``seq``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, records in _readable(batches):
            ids = _object(keys)
            cols, _ = shred(records)
            for (depth, path), col in cols.items():
                rep = np.asarray(col.rep)
                record = _ordinals(rep, 0)
                first = np.flatnonzero(rep == 0)
                n = len(rep)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[record].tolist(), pa.int64()), pa.array([-1 if depth == "image" else depth] * n, pa.int32()), pa.array([".".join(path)] * n),
                        pa.array(np.arange(n) - first[record], pa.int32()), pa.array(rep, pa.int32()), pa.array(col.defn, pa.int32()), pa.array(col.val, pa.string()),
                    ],
                    names=["record_id", "depth", "path", "seq", "rep", "def", "value"],
                )

    wire = "record_id bigint, depth int, path string, seq int, rep int, def int, value string"
    return raw.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{payload}`").alias("p")).mapInArrow(run, wire)
