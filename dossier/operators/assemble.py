"""Document text from pages and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import PROMPT_CHARS
from ..functions.text import has_text, truncate


def _join_units(units: DataFrame, keep: Column) -> DataFrame:
    """One row per document: its units in order. A text is one value, as large as its file."""
    unit = F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))
    kept = F.array_sort(F.collect_list(F.when(keep, unit)))
    return (
        units.groupBy("doc_id")
        .agg(kept.alias("units"))
        .select(
            "doc_id",
            F.size("units").alias("n_units"),
            F.array_join(F.transform("units", lambda u: u.getField("text")), "\n").alias("text"),
        )
    )


def assemble_pages(units: DataFrame) -> DataFrame:
    """Page texts in page order, joined by a line break. Blank pages are kept."""
    return _join_units(units, F.lit(True))


def assemble_paragraphs(units: DataFrame) -> DataFrame:
    """Paragraphs in order, without those that are blank, joined by a line break.

    A document whose paragraphs are all blank stays, with empty text.
    """
    return _join_units(units, has_text(F.col("text")))


def assemble_units(units: DataFrame) -> DataFrame:
    """Both rules in one pass, chosen by ``kind`` (``page`` or ``paragraph``)."""
    return _join_units(units, (F.col("kind") == "page") | has_text(F.col("text")))


def leading_text(texts: DataFrame, limit: int = PROMPT_CHARS) -> DataFrame:
    """First ``limit`` characters of each document."""
    return texts.select("doc_id", truncate(F.col("text"), limit).alias("text"))
