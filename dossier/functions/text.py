"""Text rules: strip, fences, truncation, blank tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import PROMPT_CHARS, WHITESPACE

_FENCE = "```"
_TAGGED = "```json"


def strip(text: Column) -> Column:
    """Drop Unicode white space from both ends (plain ``trim`` drops spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    """True if anything is left after stripping; null counts as blank."""
    return F.coalesce(strip(text) != "", F.lit(False))


def strip_fences(text: Column) -> Column:
    """Drop one Markdown fence around an answer, with or without a json tag.

    Prose before the fence stays, so that the JSON check refuses it.
    """
    bare = strip(text)
    opened = (
        F.when(F.lower(F.substring(bare, 1, 7)) == _TAGGED, F.substr(bare, F.lit(8)))
        .when(bare.startswith(_FENCE), F.substr(bare, F.lit(4)))
        .otherwise(bare)
    )
    inner = F.ltrim(opened, F.lit(WHITESPACE))
    closed = F.when(
        inner.endswith(_FENCE),
        F.rtrim(F.substr(inner, F.lit(1), F.length(inner) - 3), F.lit(WHITESPACE)),
    ).otherwise(inner)
    return closed


def truncate(text: Column, limit: int = PROMPT_CHARS) -> Column:
    """First ``limit`` characters, counted as code points."""
    return F.substring(text, 1, limit)


def drop_blank_lines(text: Column) -> Column:
    """Column form of the paragraph rule: blank lines go, the others stay as they are."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: strip(line) != ""), "\n")
