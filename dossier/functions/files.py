"""Upload gates. Three callers accept slightly different files; each rule is kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import DOCX, MAX_FILE_MB, MSWORD, PDF


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _suffix(name: Column, ending: str) -> Column:
    return F.lower(_or_empty(name)).endswith(ending)


def file_type_service(mime: Column, name: Column) -> Column:
    """Type the service parses the file as, null if it refuses the file.

    A declared type from the list wins; only otherwise is the name looked at.
    """
    return (
        F.when(mime.isin(PDF, DOCX, MSWORD), mime)
        .when(_suffix(name, ".pdf"), F.lit(PDF))
        .when(_suffix(name, ".docx"), F.lit(DOCX))
    )


def file_type_gateway(mime: Column, name: Column) -> Column:
    """Type the gateway passes on: PDF by type or name goes before DOCX by type or name."""
    declared = _or_empty(mime)
    return F.when((declared == PDF) | _suffix(name, ".pdf"), F.lit(PDF)).when(
        (declared == DOCX) | _suffix(name, ".docx"), F.lit(DOCX)
    )


def file_ok_client(mime: Column, name: Column) -> Column:
    """Browser-side rule, the loosest: a ``.doc`` name alone is enough."""
    return _or_empty(mime).isin(PDF, DOCX, MSWORD) | _or_empty(name).rlike(
        r"(?i)\.(pdf|docx|doc)\z"
    )


def size_ok(size_bytes: Column, mb: int = MAX_FILE_MB) -> Column:
    """A file of exactly the limit passes."""
    return size_bytes <= F.lit(mb * 1024 * 1024)


def nonempty(size_bytes: Column) -> Column:
    return size_bytes > 0
