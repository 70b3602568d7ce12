"""Result envelopes: one JSON answer per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def envelope(ok: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Successes carry both payloads, failures the error text; nulls are written out.

    ``ok`` holds ``key, parsed_resume, profile_intelligence``, ``bad`` holds ``key, error``.
    """
    good = F.struct(
        F.lit(True).alias("success"), F.col("parsed_resume"), F.col("profile_intelligence")
    )
    failed = F.struct(F.lit(False).alias("success"), F.col("error"))
    return ok.select(
        key,
        F.lit(True).alias("success"),
        F.to_json(good, _KEEP_NULLS).alias("json"),
        F.lit(None).cast("string").alias("error"),
    ).unionByName(
        bad.select(
            key, F.lit(False).alias("success"), F.to_json(failed, _KEEP_NULLS).alias("json"), "error"
        )
    )


def envelopes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same answers in one pass, for rows that hold both payloads or an ``error``."""
    failed = F.col("error").isNotNull()
    good = F.struct(F.lit(True).alias("success"), "parsed_resume", "profile_intelligence")
    bad = F.struct(F.lit(False).alias("success"), "error")
    json = F.when(failed, F.to_json(bad, _KEEP_NULLS)).otherwise(F.to_json(good, _KEEP_NULLS))
    return rows.select(*keys, (~failed).alias("success"), json.alias("json"), "error")


def service_envelopes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Answers in the form of the upload service: ``success, data, error, filename, file_type``.

    ``rows`` holds ``resume`` (null where it failed), ``error, filename, file_type``. Nulls are
    written out, so every answer has all five fields.
    """
    form = F.struct(
        F.col("error").isNull().alias("success"),
        F.when(F.col("error").isNull(), F.col("resume")).alias("data"),
        "error",
        "filename",
        "file_type",
    )
    return rows.select(*keys, F.to_json(form, _KEEP_NULLS).alias("json"))
