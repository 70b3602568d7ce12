"""Dates written by hand in a document, read by a stated rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of the text and the pattern that reads it. A year, or a month of a year,
# stands for its first day.
DATE_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^\d{2}/\d{4}$", "MM/yyyy"),
    (r"^[A-Z][a-z]{2} \d{4}$", "MMM yyyy"),
    (r"^[A-Z][a-z]{3,8} \d{4}$", "MMMM yyyy"),
    (r"^\d{4}$", "yyyy"),
)


def loose_date(text: Column) -> Column:
    """Date a text states, null if it has none of the known shapes or no such day."""
    read = None
    for shape, pattern in DATE_SHAPES:
        parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
        read = F.when(text.rlike(shape), parsed) if read is None else read.when(
            text.rlike(shape), parsed
        )
    return read
