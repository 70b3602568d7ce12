"""Display columns: dates, organisations, meta lines, links, identities, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_null(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(text, F.lit(""))


def first_filled(*choices: Column) -> Column:
    """First choice that is neither null nor empty; the last one is taken as it is."""
    return F.coalesce(*[or_null(c) for c in choices[:-1]], choices[-1])


def error_text(payload_error: Column, stderr: Column, default: Column) -> Column:
    """Error shown to the caller."""
    return first_filled(payload_error, stderr, default)


def suffixed(prefix: str, text: Column) -> Column:
    """``prefix`` and the text, or nothing where the text is missing."""
    return F.coalesce(F.concat(F.lit(prefix), or_null(text)), F.lit(""))


def date_span(start: Column, end: Column, is_current: Column | None = None) -> Column:
    """Start or nothing, then the end, or Present for a current entry without end."""
    open_end = F.lit("")
    if is_current is not None:
        open_end = F.when(is_current, F.lit(" – Present")).otherwise(F.lit(""))
    return F.concat(
        F.coalesce(start, F.lit("")),
        F.coalesce(F.concat(F.lit(" – "), or_null(end)), open_end),
    )


def organisation(company: Column, location: Column) -> Column:
    return F.concat(company, suffixed(" · ", location))


def meta_line(parts: list[Column], label: str, tail: Column) -> Column:
    """Filled parts joined by a dot, then a labelled tail if there is one."""
    filled = F.filter(F.array(*parts), lambda p: p != "")
    return F.concat(F.array_join(filled, " · "), suffixed(f" · {label}: ", tail))


def link(url: Column) -> Column:
    """Target of a link; any text that starts with http is kept. Missing text has none."""
    return F.when(
        or_null(url).isNotNull(),
        F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url)),
    )


def display_name(full_name: Column, email: Column) -> Column:
    return first_filled(full_name, F.split_part(email, F.lit("@"), F.lit(1)), F.lit("there"))


def avatar(name: Column) -> Column:
    return F.upper(F.substring(name, 1, 1))


def plain_number(value: Column) -> Column:
    """A double as a browser prints it: no exponent from 1e-6 up to 1e21, no trailing zeros."""
    size = F.abs(value)
    digits = F.regexp_replace(value.cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    plain = (size >= F.lit(1e-6)) & (size < F.lit(1e21))
    return F.when(value == 0, F.lit("0")).when(plain, digits).otherwise(value.cast("string"))


def fault_text(faults):
    """Message for a list of faults: one line with their number, then one line for each.

    Null where there are none.
    """
    lines = F.transform(
        faults,
        lambda f: F.concat(F.when(f["path"] == "", F.lit("answer")).otherwise(f["path"]), F.lit(": "), f["rule"]),
    )
    head = F.concat(F.size(faults).cast("string"), F.lit(" faults"))
    return F.when(F.size(faults) > 0, F.concat_ws("\n", head, F.array_join(lines, "\n")))
