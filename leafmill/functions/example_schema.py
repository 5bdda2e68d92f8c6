"""Record schemas inferred from an example JSON value.

Inference runs on the driver over the example alone. Validation is a set of
column expressions generated from the schema, one per leaf.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import text as X
from leafmill.functions import variants as V
from leafmill.schemas import MISSING

# Fixed value: keys whose empty example is read as a number.
NUMBER_KEY = re.compile(r"(percent|temperature|_c|_h|yield|time|count|mw|mass|equiv|eq\b)", re.I)

# Fixed value: the default record example.
DEFAULT_REACTION_EXAMPLE: dict[str, Any] = {
    "reaction_text": "",
    "reaction_smiles": "",
    "atom_mapped_reaction_smiles": None,
    "reaction_latex": "",
    "rxn_path": "",
    "conditions": {"catalyst": None, "temperature_c": None, "time_h": None},
    "yield_percent": None,
}

NUMERIC_KINDS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


@dataclass(frozen=True)
class Node:
    """One schema node; ``types`` are the JSON kinds a value may have."""

    types: tuple[str, ...]
    children: dict[str, Node] = field(default_factory=dict)
    items: Node | None = None

    @property
    def nullable(self) -> bool:
        return "null" in self.types

    def spark_type(self) -> T.DataType:
        if "object" in self.types:
            return T.StructType([T.StructField(k, c.spark_type()) for k, c in self.children.items()])
        if "array" in self.types:
            return T.ArrayType(self.items.spark_type())
        if "string" in self.types:
            return T.StringType()
        if "boolean" in self.types:
            return T.BooleanType()
        # A fractional number is accepted by an integer leaf, so both are doubles.
        return T.DoubleType()

    def label(self) -> str:
        shown = self.types[0] if len(self.types) == 1 else list(self.types)
        return json.dumps(shown, separators=(",", ":"))


def schema_from_example(example: Any, key: str = "") -> Node:
    if example is None:
        return Node(("number", "null")) if NUMBER_KEY.search(key) else Node(("string", "number", "null"))
    if isinstance(example, bool):
        return Node(("boolean", "null"))
    if isinstance(example, str):
        return Node(("string", "null"))
    if isinstance(example, (int, float)):
        return Node(("integer", "null")) if float(example).is_integer() else Node(("number", "null"))
    if isinstance(example, list):
        first = example[0] if example and example[0] is not None else ""
        return Node(("array",), items=schema_from_example(first, key))
    return Node(("object",), children={k: schema_from_example(v, k) for k, v in example.items()})


def leaves(node: Node, path: str = "") -> list[tuple[str, Node]]:
    if "object" in node.types:
        return [p for k, c in node.children.items() for p in leaves(c, f"{path}.{k}" if path else k)]
    return [(path, node)]


def null_skeleton(node: Node) -> Column:
    """Same keys, nested objects kept, every leaf and list null."""
    return F.struct(
        *[
            (null_skeleton(c) if "object" in c.types else F.lit(None).cast(c.spark_type())).alias(k)
            for k, c in node.children.items()
        ]
    )


def _missing(path: Column) -> Column:
    return F.array(F.struct(path.alias("field"), F.lit("source_not_present").alias("missing_reason")))


def _none(element: T.DataType) -> Column:
    return F.array().cast(T.ArrayType(element) if not isinstance(element, T.ArrayType) else element)


def _result(value: Column, errors: Column, missing: Column) -> Column:
    return F.struct(value.alias("v"), errors.alias("e"), missing.alias("m"))


def _check(node: Node, v: Column, path: Column, at_root: bool = False) -> Column:
    """struct<v, e, m>: value, errors and missing of one node, each part computed once."""
    return V.bind(v, lambda x: V.bind(V.kind(x), lambda k: _check_kind(node, x, k, path, at_root)))


def _check_kind(node: Node, v: Column, k: Column, path: Column, at_root: bool) -> Column:
    s = V.text_of(v)
    numeric = "number" in node.types or "integer" in node.types
    blank = s.isin("null", "") if node.nullable else s == "null"
    is_null = F.coalesce((k == "VOID") | ((k == "STRING") & blank), F.lit(False))

    kinds = [name for t, name in (("string", "STRING"), ("boolean", "BOOLEAN"), ("array", "ARRAY"), ("object", "OBJECT")) if t in node.types]
    allowed = k.isin(*kinds, *(NUMERIC_KINDS if numeric else ()))
    if numeric and "STRING" not in kinds:
        allowed = allowed | ((k == "STRING") & s.rlike(X.NUMERIC_TEXT))
    allowed = F.coalesce(allowed, F.lit(False))

    null_value = F.lit(None).cast(node.spark_type())
    no_errors, no_missing = _none(T.StringType()), _none(MISSING)
    shown = F.when(v.isNull(), F.lit("undefined")).when(is_null, F.lit("null")).otherwise(F.to_json(v))
    where = F.when(path == "", F.lit("$")).otherwise(path)
    error = F.array(F.concat(where, F.lit(f" expected {node.label()}, got "), shown))
    refused = _result(null_value, error, no_missing)
    empty = refused
    if node.nullable:
        empty = _result(null_value, no_errors, F.when(path != "", _missing(path)).otherwise(no_missing))
    return F.when(is_null, empty).when(allowed, _accepted(node, v, k, s, path, at_root)).otherwise(refused)


def _accepted(node: Node, v: Column, k: Column, s: Column, path: Column, at_root: bool) -> Column:
    no_errors, no_missing = _none(T.StringType()), _none(MISSING)
    if "object" in node.types:
        checked = F.struct(
            *[
                _check(child, V.field(v, key), F.lit(key) if at_root else F.concat(path, F.lit(f".{key}"))).alias(key)
                for key, child in node.children.items()
            ]
        )
        return V.bind(
            checked,
            lambda c: _result(
                F.struct(*[c[key]["v"].alias(key) for key in node.children]),
                F.concat(*[c[key]["e"] for key in node.children]),
                F.concat(*[c[key]["m"] for key in node.children]),
            ),
        )
    if "array" in node.types:
        index = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        checked = F.transform(V.items(v), lambda x, i: _check(node.items, x, index(i)))
        return V.bind(
            checked,
            lambda c: _result(
                F.transform(c, lambda r: r["v"]),
                F.flatten(F.transform(c, lambda r: r["e"])),
                F.flatten(F.transform(c, lambda r: r["m"])),
            ),
        )
    numeric = "number" in node.types or "integer" in node.types
    number = F.coalesce(F.when(k == "STRING", X.to_number(s)), F.try_variant_get(v, "$", "double"))
    if "string" in node.types:
        # On a string-or-number leaf a numeric string becomes the number, printed plainly.
        leaf = F.coalesce(V.bind(number, X.number_text), s) if numeric else s
    elif "boolean" in node.types:
        leaf = F.try_variant_get(v, "$", "boolean")
    else:
        leaf = number
    return _result(leaf.cast(node.spark_type()), no_errors, no_missing)


def _check_told(node: Node, told: Any, path: str) -> tuple[Column, list[Column], list[Column]]:
    """Value, errors and missing of a value whose kind is known: ``_check`` without a variant to look into."""
    if isinstance(told, dict) and "object" in node.types:
        parts = {k: _check_told(c, told.get(k), f"{path}.{k}" if path else k) for k, c in node.children.items()}
        value = F.struct(*[v.alias(k) for k, (v, _, _) in parts.items()])
        return value, [e for _, es, _ in parts.values() for e in es], [m for _, _, ms in parts.values() for m in ms]
    null_value = F.lit(None).cast(node.spark_type())
    no_errors, no_missing = _none(T.StringType()), _none(MISSING)

    def refused(shown: Column) -> Column:
        return F.array(F.concat(F.lit(f"{path or '$'} expected {node.label()}, got "), shown))

    empty_errors = [] if node.nullable else [refused(F.lit("null"))]
    empty_missing = [_missing(F.lit(path))] if node.nullable and path else []
    if told is None:
        return null_value, empty_errors, empty_missing
    kind, x = told
    numeric = "number" in node.types or "integer" in node.types
    if kind == "STRING":
        is_null = x.isNull() | (x.isin("null", "") if node.nullable else x == "null")
        allowed = F.lit(True) if "string" in node.types else x.rlike(X.NUMERIC_TEXT) if numeric else F.lit(False)
        number = F.coalesce(X.to_number(x), x.try_cast("double")) if "string" not in node.types else X.to_number(x)
    else:
        is_null, allowed, number = x.isNull(), F.lit(numeric), x
    if "string" in node.types:
        leaf = F.coalesce(X.number_text(number), x.cast("string")) if numeric else x.cast("string")
    else:
        leaf = number if numeric else null_value
    errors = F.when(~is_null & ~allowed, refused(F.to_json(V.plain_number(x) if kind == "NUMBER" else x.cast("variant"))))
    value = F.when(~is_null & allowed, leaf.cast(node.spark_type()))
    lacking = [F.when(is_null, m).otherwise(no_missing) for m in empty_missing]
    refusing = [F.when(is_null, e).otherwise(no_errors) for e in empty_errors]
    return value, [*refusing, F.coalesce(errors, no_errors)], lacking


def validate(node: Node, v: Column | dict[str, Any]) -> Column:
    """struct<value, errors, missing> of a variant checked against the schema; no errors means valid.

    A value made of known columns may be given as a tree instead, by key: None, a dict for an
    object, or a kind (STRING, NUMBER) and its column. Its leaves are judged as they are typed.
    """
    if isinstance(v, dict):
        value, errors, missing = _check_told(node, v, "")
        whole = [F.concat(none, *parts) for none, parts in ((_none(T.StringType()), errors), (_none(MISSING), missing))]
        return F.struct(value.alias("value"), whole[0].alias("errors"), whole[1].alias("missing"))
    return V.bind(
        _check(node, v, F.lit(""), True),
        lambda r: F.struct(r["v"].alias("value"), r["e"].alias("errors"), r["m"].alias("missing")),
    )


def project(node: Node, v: Column) -> Column:
    """Declared keys only, in schema order; values that do not fit become null."""
    return _check(node, v, F.lit(""), True)["v"]


def missing_of(node: Node, value: Column, path: str = "") -> Column:
    """Missing entries of an already typed value: one per null leaf."""
    parts = []
    for key, child in node.children.items():
        p = f"{path}.{key}" if path else key
        if "object" in child.types:
            parts.append(missing_of(child, value[key], p))
        elif "array" not in child.types:
            parts.append(F.when(value[key].isNull(), _missing(F.lit(p))).otherwise(_none(MISSING)))
    return F.concat(*parts) if parts else _none(MISSING)
