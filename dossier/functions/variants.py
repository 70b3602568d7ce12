"""Strict reading of JSON answers.

``from_json`` is too lenient in some places and too strict in others, so a text is
parsed to VARIANT once and every field is tested on its own type. A
:class:`~pyspark.sql.types.StructType` from :mod:`dossier.schemas` states the rules;
the functions here turn it into Spark SQL expressions. They take and return expression
text: a record has about a hundred tests, and text is much cheaper to put together
than as many column objects.
"""

from __future__ import annotations

from pyspark.sql import types as T

from ..fixed import FALSE_WORDS, TRUE_WORDS, WHITESPACE
from ..schemas import column_type

_DIGITS = r"\d+(?:_\d+)*"
_WHOLE = rf"^[+-]?{_DIGITS}(?:\.0+)?$"
_REAL = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)$"
)
_SPACES = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)


def wrapped(text: str) -> str:
    """Text parsed as the value of a one-key object, null if it is not JSON."""
    return f"""try_parse_json(concat('{{"v":', {text}, '}}'))"""


def lone_value(text: str) -> str:
    """True if the text, put in brackets, is an array of exactly one element.

    Text that breaks out of the object wrapper does not survive this one, and the
    other way round; a text that passes both is one complete JSON value.
    """
    return f"coalesce(json_array_length(concat('[', {text}, ']')) = 1, false)"


def get(node: str, target: str, path: str = "$") -> str:
    return f"try_variant_get({node}, '{path}', '{target}')"


# Of all JSON values only text turns into binary, so this target tells text from the rest.
STRICT_TEXT = "binary"


def is_text(node: str) -> str:
    return f"{get(node, STRICT_TEXT)} IS NOT NULL"


def plain_text(rule: T.StructField) -> bool:
    """True for a text field without default: its null and missing mean the same."""
    return isinstance(rule.dataType, T.StringType) and "default" not in rule.metadata


def has_text_fields(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and any(map(plain_text, kind.fields))


def _struct(fields: list[tuple[str, str]]) -> str:
    return "struct<" + ",".join(f"{name}:{kind}" for name, kind in fields) + ">"


def loose_type(kind: T.DataType) -> str:
    """Type a node is read as: text fields as text (whatever they hold), the rest untyped."""
    if isinstance(kind, T.ArrayType):
        return f"array<{loose_type(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return _struct([(f.name, "string" if plain_text(f) else "variant") for f in kind.fields])
    return "string"


def strict_type(kind: T.DataType) -> str:
    """Type that holds a value only where a text field really is text."""
    if isinstance(kind, T.ArrayType):
        return f"array<{strict_type(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return _struct([(f.name, STRICT_TEXT) for f in kind.fields if plain_text(f)])
    return STRICT_TEXT


def needs_strict(kind: T.DataType) -> bool:
    """True if a node must be read a second time, to tell text from other values."""
    item = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return isinstance(item, T.StringType) or has_text_fields(item)


def _by_kind(node: str, boolean: str, number: str, text: str) -> str:
    kind = f"schema_of_variant({node})"
    return (
        f"CASE WHEN {kind} = 'BOOLEAN' THEN {boolean} WHEN {kind} = 'STRING' THEN {text} "
        f"WHEN {kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({kind}, 'DECIMAL') "
        f"THEN {number} END"
    )


def as_flag(node: str) -> str:
    """Boolean a node stands for: true/false, 0/1, or one of the flag words."""
    word, number = f"lower({get(node, 'string')})", get(node, "double")
    true, false = (", ".join(f"'{w}'" for w in words) for words in (TRUE_WORDS, FALSE_WORDS))
    return _by_kind(
        node,
        get(node, "boolean"),
        f"CASE WHEN {number} = 1 THEN true WHEN {number} = 0 THEN false END",
        f"CASE WHEN {word} IN ({true}) THEN true WHEN {word} IN ({false}) THEN false END",
    )


def as_whole(node: str) -> str:
    """Integer a node stands for: whole numbers, booleans, or text that writes one."""
    number = get(node, "double")
    written = f"btrim({get(node, 'string')}, '{_SPACES}')"
    return _by_kind(
        node,
        f"CAST({get(node, 'boolean')} AS INT)",
        f"CASE WHEN {number} = floor({number}) THEN try_cast({number} AS INT) END",
        f"CASE WHEN {written} RLIKE r'{_WHOLE}' "
        f"THEN try_cast(replace(split_part({written}, '.', 1), '_', '') AS INT) END",
    )


def as_real(node: str) -> str:
    """Double a node stands for: numbers, booleans, or text that writes one."""
    written = f"btrim({get(node, 'string')}, '{_SPACES}')"
    return _by_kind(
        node,
        f"CAST({get(node, 'boolean')} AS DOUBLE)",
        get(node, "double"),
        f"CASE WHEN {written} RLIKE r'{_REAL}' "
        f"THEN try_cast(replace({written}, '_', '') AS DOUBLE) END",
    )


READERS = {T.BooleanType: as_flag, T.IntegerType: as_whole, T.DoubleType: as_real}


def _record_ok(loose: str, strict: str, record: T.StructType, depth: int) -> str:
    checks = [f"{loose} IS NOT NULL"]
    for f in record.fields:
        if not plain_text(f):
            checks.append(field_ok(f"{loose}.{f.name}", f, depth))
        elif f.nullable:
            checks.append(f"({loose}.{f.name} IS NULL OR {strict}.{f.name} IS NOT NULL)")
        else:
            checks.append(f"{strict}.{f.name} IS NOT NULL")
    return " AND ".join(checks)


def _list_ok(loose: str, strict: str, item: T.DataType, depth: int) -> str:
    x, y = f"x{depth}", f"y{depth}"
    if not isinstance(item, T.StructType):
        return f"coalesce(NOT exists({strict}, {y} -> {y} IS NULL), false)"
    if not has_text_fields(item):
        good = _record_ok(x, y, item, depth + 1)
        return f"coalesce(forall({loose}, {x} -> {good}), false)"
    pairs = f"zip_with({loose}, {strict}, ({x}, {y}) -> {_record_ok(x, y, item, depth + 1)})"
    return f"coalesce(forall({pairs}, {x} -> {x}), false)"


def field_ok(
    node: str,
    rule: T.StructField,
    depth: int = 0,
    loose: str | None = None,
    strict: str | None = None,
) -> str:
    """True if the node fits the rule of its field. Never null.

    ``loose`` and ``strict`` name columns that already hold the node in these types.
    """
    kind = rule.dataType
    if isinstance(kind, (T.ArrayType, T.StructType)):
        loose = loose or get(node, loose_type(kind))
        strict = strict or get(node, strict_type(kind))
    if isinstance(kind, T.ArrayType):
        fits = _list_ok(loose, strict, kind.elementType, depth)
    elif isinstance(kind, T.StructType):
        fits = _record_ok(loose, strict, kind, depth)
    elif isinstance(kind, T.StringType):
        fits = is_text(node)
    elif "ge" in rule.metadata:
        low, high = rule.metadata["ge"], rule.metadata["le"]
        fits = f"coalesce({READERS[type(kind)](node)} BETWEEN {low} AND {high}, false)"
    else:
        fits = f"({READERS[type(kind)](node)}) IS NOT NULL"
    if rule.nullable:
        return f"({node} IS NULL OR is_variant_null({node}) OR ({fits}))"
    if "default" in rule.metadata:
        return f"({node} IS NULL OR ({fits}))"
    return f"({node} IS NOT NULL AND ({fits}))"


def record_value(loose: str, record: T.StructType, depth: int = 0) -> str:
    """Typed struct out of a loosely read one."""
    parts = []
    for f in record.fields:
        field = f"{loose}.{f.name}"
        parts.append(f"'{f.name}', {field if plain_text(f) else field_value(field, f, depth)}")
    return f"named_struct({', '.join(parts)})"


def field_value(node: str, rule: T.StructField, depth: int = 0, loose: str | None = None) -> str:
    """Typed value of a node that passed :func:`field_ok`, default filled in."""
    kind = rule.dataType
    if isinstance(kind, (T.ArrayType, T.StructType)):
        loose = loose or get(node, loose_type(kind))
    if isinstance(kind, T.ArrayType):
        item, x = kind.elementType, f"x{depth}"
        if isinstance(item, T.StructType):
            loose = f"transform({loose}, {x} -> {record_value(x, item, depth + 1)})"
        return f"coalesce({loose}, CAST(array() AS {column_type(kind).simpleString()}))"
    if isinstance(kind, T.StructType):
        return f"CASE WHEN {loose} IS NOT NULL THEN {record_value(loose, kind, depth)} END"
    value = get(node, "string") if isinstance(kind, T.StringType) else READERS[type(kind)](node)
    if "default" in rule.metadata:
        return f"coalesce({value}, CAST({rule.metadata['default']} AS {kind.simpleString()}))"
    return value
