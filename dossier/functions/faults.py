"""Every place of an answer that does not fit its record, with the rule it breaks.

The walk follows a :class:`~pyspark.sql.types.StructType` from :mod:`dossier.schemas`, as the
checks in :mod:`dossier.functions.variants` do, and agrees with them: an answer has faults
exactly if a check refuses it. It reads nodes untyped, because a fault has to tell a missing
key from a null and from a value of another kind. Functions take and return expression text.

Rules: ``missing`` (a required key is absent), ``range`` (a number outside its bounds), and
otherwise the kind that was expected: ``text``, ``flag``, ``whole``, ``number``, ``list``,
``object``. A path names keys and positions from 0, like ``experience[2].title``.
"""

from __future__ import annotations

from pyspark.sql import types as T

from . import variants as V

FAULTS = "array<struct<path:string,rule:string>>"
NONE = f"CAST(array() AS {FAULTS})"

_EXPECTED = {
    T.StringType: "text",
    T.BooleanType: "flag",
    T.IntegerType: "whole",
    T.DoubleType: "number",
    T.ArrayType: "list",
    T.StructType: "object",
}


def one_fault(path: str, rule: str) -> str:
    return f"array(named_struct('path', {path}, 'rule', '{rule}'))"


def _wrong_kind(path: str, kind: T.DataType) -> str:
    return one_fault(path, _EXPECTED[type(kind)])


def _record_faults(node: str, record: T.StructType, path: str, depth: int) -> str:
    # The opened record is bound to a name, so that its fields share one reading.
    r = f"r{depth}"
    opened = V.get(node, "struct<" + ",".join(f"{n}:variant" for n in record.names) + ">")
    inner = record_faults(r, record, path, depth + 1)
    wrong = _wrong_kind(path, record)
    return f"flatten(transform(array({opened}), {r} -> CASE WHEN {r} IS NULL THEN {wrong} ELSE {inner} END))"


def _list_faults(node: str, kind: T.ArrayType, path: str, depth: int) -> str:
    entries, x, i = f"e{depth}", f"x{depth}", f"i{depth}"
    place = f"concat({path}, '[', {i}, ']')"
    inner = _kind_faults(x, kind.elementType, place, depth + 1)
    nothing = _wrong_kind(place, kind.elementType)
    each = f"CASE WHEN {x} IS NULL OR is_variant_null({x}) THEN {nothing} ELSE {inner} END"
    walked = f"flatten(transform({entries}, ({x}, {i}) -> {each}))"
    wrong = _wrong_kind(path, kind)
    opened = V.get(node, "array<variant>")
    return (
        f"flatten(transform(array({opened}), {entries} -> "
        f"CASE WHEN {entries} IS NULL THEN {wrong} ELSE {walked} END))"
    )


def _kind_faults(node: str, kind: T.DataType, path: str, depth: int) -> str:
    """Faults of a value that is there and not null."""
    if isinstance(kind, T.StructType):
        return _record_faults(node, kind, path, depth)
    if isinstance(kind, T.ArrayType):
        return _list_faults(node, kind, path, depth)
    if isinstance(kind, T.StringType):
        fits = V.is_text(node)
    else:
        fits = f"({V.READERS[type(kind)](node)}) IS NOT NULL"
    return f"CASE WHEN {fits} THEN {NONE} ELSE {_wrong_kind(path, kind)} END"


def field_faults(node: str, rule: T.StructField, path: str, depth: int = 0) -> str:
    """Faults of one field; ``path`` is an expression that gives its own path."""
    kind = rule.dataType
    optional = rule.nullable or "default" in rule.metadata
    absent = NONE if optional else one_fault(path, "missing")
    null = NONE if rule.nullable else _wrong_kind(path, kind)
    inner = _kind_faults(node, kind, path, depth)
    if "ge" in rule.metadata:
        low, high = rule.metadata["ge"], rule.metadata["le"]
        outside = f"({V.READERS[type(kind)](node)}) NOT BETWEEN {low} AND {high}"
        inner = f"CASE WHEN {outside} THEN {one_fault(path, 'range')} ELSE {inner} END"
    return (
        f"CASE WHEN {node} IS NULL THEN {absent} WHEN is_variant_null({node}) THEN {null} "
        f"ELSE {inner} END"
    )


def record_faults(opened: str, record: T.StructType, path: str | None = None, depth: int = 0) -> str:
    """Faults of a record whose fields are at hand as ``opened.field``, in the order of the schema."""
    parts = []
    for f in record.fields:
        place = f"concat({path}, '.{f.name}')" if path else f"'{f.name}'"
        parts.append(field_faults(f"{opened}.{f.name}", f, place, depth))
    return f"concat({', '.join(parts)})"
