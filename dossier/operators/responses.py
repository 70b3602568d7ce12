"""Model answers: clean, parse, check strictly, type, and fill in defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import faults as P
from ..functions import variants as V
from ..functions.text import strip_fences
from ..schemas import PROFILE, RESUME

# Reason an answer is refused, and the status its sender sees.
STATUS = {"malformed": 422, "not_object": 500, "reserved_key": 500, "invalid": 422}

# Key an extraction answer must not hold, because the pipeline sets it.
RESERVED = {"resume": "raw_text", "profile": None}
RECORDS = {"resume": RESUME, "profile": PROFILE}


def parse_answers(
    df: DataFrame, text: str, record: T.StructType, reserved: str | None = None
) -> DataFrame:
    """Add ``root`` (struct of untyped fields) and ``problem`` (why there is none).

    Each answer is parsed once into ``root``; later checks read that column.
    """
    more = [reserved] if reserved else []
    cleaned = df.withColumn("_cleaned", strip_fences(F.coalesce(F.col(text), F.lit(""))))
    parsed = cleaned.selectExpr(
        *_names(df), f"{V.lone_value('_cleaned')} AS _lone", f"{V.wrapped('_cleaned')} AS _node"
    )
    root = ",".join(f"{name}:variant" for name in [*record.names, *more])
    opened = V.get("_node", f"struct<{root}>", "$.v")
    rooted = parsed.selectExpr("*", f"{opened} AS root")
    problem = (
        "CASE WHEN NOT _lone OR _node IS NULL THEN 'malformed' WHEN root IS NULL THEN 'not_object'"
    )
    if reserved:
        problem += f" WHEN root.{reserved} IS NOT NULL THEN 'reserved_key'"
    return rooted.selectExpr(*_names(df), "root", f"{problem} END AS problem")


def _names(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def conform(
    df: DataFrame, text: str, which: str, into: str | None = None, faults: bool = False
) -> DataFrame:
    """Check answers against a record and type them.

    Adds ``reason`` and ``status`` (both null for an accepted answer), ``bad_field`` (the
    first field that does not fit) and the typed record in ``into``, null where refused.
    One bad element refuses the whole answer; unknown keys are ignored. No rows are lost.

    With ``faults`` a column of that name lists every place that does not fit, as ``path,
    rule`` in the order of the record (see :mod:`dossier.functions.faults`); an answer without
    a readable record has one fault with an empty path and its reason as rule, an accepted one
    has none. Only refused answers are walked for it.
    """
    record, into = RECORDS[which], into or which
    parsed = parse_answers(df, text, record, RESERVED[which])
    # A list or struct is read once as loose and once as strict, for all its entries;
    # its check and its value share these columns.
    nested = [f for f in record.fields if isinstance(f.dataType, (T.ArrayType, T.StructType))]
    loose = {f.name: f"_loose_{f.name}" for f in nested}
    strict = {f.name: f"_strict_{f.name}" for f in nested if V.needs_strict(f.dataType)}
    split = parsed.selectExpr(
        "*",
        *[f"{V.get(f'root.{f.name}', V.loose_type(f.dataType))} AS {loose[f.name]}" for f in nested],
        *[
            f"{V.get(f'root.{f.name}', V.strict_type(f.dataType))} AS {strict[f.name]}"
            for f in nested
            if f.name in strict
        ],
    )
    fits = [
        V.field_ok(f"root.{f.name}", f, loose=loose.get(f.name), strict=strict.get(f.name))
        for f in record.fields
    ]
    typed = [V.field_value(f"root.{f.name}", f, loose=loose.get(f.name)) for f in record.fields]
    misfit = " ".join(
        f"WHEN NOT {ok} THEN '{name}'" for ok, name in zip(fits, record.names)
    )
    judged = split.selectExpr(
        "*", f"CASE WHEN problem IS NULL THEN CASE {misfit} END END AS bad_field"
    ).selectExpr("*", "coalesce(problem, nvl2(bad_field, 'invalid', NULL)) AS reason")
    status = " ".join(f"WHEN '{reason}' THEN {code}" for reason, code in STATUS.items())
    value = ", ".join(f"'{name}', {made}" for name, made in zip(record.names, typed))
    listed = (
        f"'faults', CASE WHEN reason IS NULL THEN {P.NONE} WHEN problem IS NOT NULL "
        f"THEN array(named_struct('path', '', 'rule', problem)) "
        f"ELSE {P.record_faults('root', record)} END, "
    )
    verdict = (
        f"named_struct('bad_field', bad_field, 'reason', reason, {listed if faults else ''}"
        f"'status', CASE reason {status} END, "
        f"'{into}', CASE WHEN reason IS NULL THEN named_struct({value}) END)"
    )
    # The one-row inline keeps a later filter on the reason above the checks. Pushed
    # below them, the filter would repeat every parse and check in its condition.
    return judged.selectExpr(*_names(df), f"inline(array({verdict}))")


def accepted(df: DataFrame) -> DataFrame:
    """Rows whose answer fits."""
    return df.filter(F.col("reason").isNull()).drop("reason", "status", "bad_field")


def refused(df: DataFrame) -> DataFrame:
    """Quarantine: rows whose answer does not fit, with the reason."""
    return df.filter(F.col("reason").isNotNull())
