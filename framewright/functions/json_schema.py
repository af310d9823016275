"""A subset of JSON Schema: validation, types, defaults and enumerations of dotted columns."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COUNT = {"type": "integer", "minimum": 0}
# The layout and enumerations of the per-image JSON format.
DEFAULT_SCHEMA: dict[str, Any] = {
    "type": "object",
    "properties": {
        "image": {
            "type": "object",
            "properties": {
                "file_name": {"type": "string"}, "id": _COUNT, "width": _COUNT, "height": _COUNT,
                "tags": {"type": "object", "properties": {"time": {"enum": ["day", "night"]}, "weather": {"enum": ["rainy", "sunny", "snowy", "foggy", "cloudy", "clear"]}}},
            },
            "required": ["file_name", "id", "width", "height"],
        },
        "annotations": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {
                    "id": _COUNT, "parent_id": _COUNT, "children_ids": {"type": "array", "items": _COUNT, "uniqueItems": True}, "tracking_id": _COUNT, "category_id": _COUNT, "category_str": {"type": "string"},
                    "confidence": {"type": "number", "minimum": 0, "maximum": 1},
                    "bbox": {"type": "array", "items": {"type": "number", "minimum": 0}, "minItems": 2, "maxItems": 4},
                    "attributes": {
                        "type": "object",
                        "properties": {
                            "colors": {"type": "array", "items": {"enum": ["red", "green", "yellow", "blue", "white", "black", "orange", "purple", "grey", "brown", "pink", "beige", "cyan"]}, "uniqueItems": True},
                            "position": {"type": "array", "items": {"enum": ["side", "front", "top", "back", "unknown"]}, "uniqueItems": True},
                            "occluded": {"type": "boolean"},
                        },
                    },
                },
                "required": ["id", "category_id", "bbox"],
            },
        },
    },
}


class SchemaError(ValueError):
    """A document that breaks its schema."""


def load_schema(schema: str | dict | None) -> dict:
    """A schema given as a dict, as "default" (or None) for the built-in one, by URL or by path."""
    if isinstance(schema, dict):
        return schema
    if schema in (None, "default"):
        return DEFAULT_SCHEMA
    if schema.startswith(("http://", "https://")):
        with urllib.request.urlopen(schema, timeout=60) as answer:
            return json.load(answer)
    return json.loads(Path(schema).read_text())


def errors(schema: dict, value: Any, at: str = "$") -> Iterator[str]:
    """What in ``value`` breaks ``schema``: type, enum, minimum, maximum, required, minItems, maxItems, uniqueItems, items, properties."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    kind = schema.get("type")
    wanted = [kind] if isinstance(kind, str) else kind or []

    def fits(k: str) -> bool:
        if k in ("integer", "number"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (k == "number" or float(value).is_integer())
        return isinstance(value, kinds[k])

    if wanted and not any(fits(k) for k in wanted):
        yield f"{at} is no {' or '.join(wanted)}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at} is none of {schema['enum']}"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            yield f"{at} is below {schema['minimum']}"
        if value > schema.get("maximum", value):
            yield f"{at} is above {schema['maximum']}"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            yield f"{at} has {len(value)} items"
        if schema.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in value}) < len(value):
            yield f"{at} repeats items"
        for i, x in enumerate(value):
            yield from errors(schema.get("items", {}), x, f"{at}[{i}]")
    if isinstance(value, dict):
        for k in schema.get("required", []):
            if k not in value:
                yield f"{at} lacks {k}"
        for k, s in schema.get("properties", {}).items():
            if k in value:
                yield from errors(s, value[k], f"{at}.{k}")


def invalid_rows(df: DataFrame, column: str, schema: dict) -> DataFrame:
    """``df`` rows whose JSON text breaks the schema, with the first ``error``."""

    @F.arrow_udf("string")
    def first(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(next(errors(schema, json.loads(t)), None) if t is not None else None)
            except ValueError as e:
                out.append(f"no JSON: {e}")
        return pa.array(out, pa.string())

    return df.withColumn("error", first(F.col(column))).filter("error is not null")


def check_payload(spark: SparkSession, folder: str, schema: dict) -> None:
    """Raise SchemaError for a JSON file below ``folder`` that breaks the schema."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    bad = invalid_rows(texts, "value", schema).select("file", "error").limit(3).collect()
    if bad:
        raise SchemaError("; ".join(f"{r['file']}: {r['error']}" for r in bad))


def flat_schema(schema: dict, prefix: str = "", sep: str = ".", ignore_pattern: str | None = None, required: bool = True) -> dict[str, dict]:
    """Leaves by dotted name, each with ``optional``: whether it or an object above it may be absent. Lists of objects are entered.

    Properties whose own name matches ``ignore_pattern`` are left out, with all below them.
    """
    out: dict[str, dict] = {}
    for k, s in schema.get("properties", {}).items():
        if ignore_pattern and re.match(ignore_pattern, k):
            continue
        name, needed = f"{prefix}{k}", required and k in schema.get("required", [])
        inner = s.get("items", {}) if s.get("type") == "array" else s
        if "properties" in inner:
            # what a list item must have, it must have whether there is a list or not
            out |= flat_schema(inner, name + sep, sep, ignore_pattern, True if inner is not s else needed)
        else:
            out[name] = s | {"optional": not needed}
    return out


def enum_arrays(schema: dict, sep: str = ".", ignore_pattern: str | None = None) -> dict[str, list[str]]:
    """Dotted names of sets of enumerated values (arrays with ``uniqueItems``), with the values."""
    leaves = flat_schema(schema, sep=sep, ignore_pattern=ignore_pattern)
    return {k: list(s["items"]["enum"]) for k, s in leaves.items() if s.get("type") == "array" and s.get("uniqueItems") and "enum" in s.get("items", {})}


_TYPES = {"integer": "bigint", "number": "double", "string": "string", "boolean": "boolean"}


def defaults_and_types(schema: dict, sep: str = ".") -> dict[str, tuple[str, Any]]:
    """Dotted names of leaves of a known type with their Spark type and default (None without one).

    Only what may be absent has a default: the schema's own, or an empty list for an array.
    """
    out: dict[str, tuple[str, Any]] = {}
    for k, s in flat_schema(schema, sep=sep).items():
        items = s.get("items", {})
        kind = f"array<{_TYPES.get(items.get('type', 'string'), 'string')}>" if s.get("type") == "array" else _TYPES.get(s.get("type", ""))
        if kind is not None:
            default = s.get("default", [] if s.get("type") == "array" else None)
            out[k] = (kind, default if s["optional"] else None)
    return out


def fill_defaults(schema: dict, df: DataFrame, prefix: str = "") -> DataFrame:
    """``df`` with the schema's types and, in place of nulls, its defaults; columns that it does not name stay as they are."""
    known = {c[len(prefix) :]: x for c, x in defaults_and_types(schema).items() if c.startswith(prefix)}

    def filled(c: str) -> Column:
        kind, default = known[c]
        value = F.col(f"`{c}`").cast(kind)
        if default is None:
            return value
        given = F.array(*(F.lit(x) for x in default)).cast(kind) if isinstance(default, list) else F.lit(default).cast(kind)
        return F.coalesce(value, given)

    return df.select(*(filled(c).alias(c) if c in known else F.col(f"`{c}`") for c in df.columns))


def schema_tree(schema: dict, prefix: str = "", sep: str = ".") -> dict[str, Any]:
    """The schema's objects as nested dicts whose leaves are the dotted names of the flat columns."""
    return {k: schema_tree(s, f"{prefix}{k}{sep}", sep) if s.get("type") == "object" and "properties" in s else f"{prefix}{k}" for k, s in schema.get("properties", {}).items()}


def renest(names: list[str], sep: str = ".") -> dict[str, Any]:
    """Dotted names as a tree of dicts whose leaves are the names."""
    tree: dict[str, Any] = {}
    for n in names:
        *path, last = n.split(sep)
        node = tree
        for p in path:
            node = node.setdefault(p, {})
            if not isinstance(node, dict):
                raise ValueError(f"{n} lies below a value")
        if isinstance(node.get(last), dict):
            raise ValueError(f"{n} is a value and a prefix")
        node[last] = n
    return tree


def nested_struct(tree: dict[str, Any]) -> list:
    """Struct columns of a tree of names; empty arrays and structs of nothing become null, so that JSON leaves them out."""
    out = []
    for k, v in tree.items():
        if isinstance(v, dict):
            inner = nested_struct(v)
            leaves = [F.col(f"`{x}`").isNotNull() for x in _leaves(v)]
            any_ = leaves[0]
            for x in leaves[1:]:
                any_ = any_ | x
            out.append(F.when(any_, F.struct(*inner)).alias(k))
        else:
            out.append(F.col(f"`{v}`").alias(k))
    return out


def _leaves(tree: dict[str, Any]) -> list[str]:
    return [x for v in tree.values() for x in (_leaves(v) if isinstance(v, dict) else [v])]
