"""Requests meeting their answers as both arrive, with a time limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import ANSWER_LIMIT_S

_KEEP_NULLS = {"ignoreNullFields": "false"}


def answered_in_time(
    requests: DataFrame, answers: DataFrame, limit_s: int = ANSWER_LIMIT_S, disorder: str = "1 minute"
) -> DataFrame:
    """``request_id, asked_at, answered_at, answer``: one row per request, answered or not.

    ``requests`` holds ``request_id, asked_at``, ``answers`` at most one row per request of
    ``request_id, answered_at, answer``. An answer counts if it comes at ``asked_at`` or up to
    ``limit_s`` seconds later, the limit included. A request is given up, with null answers,
    once both streams have passed the limit; so state is held for the limit and the ``disorder``
    that rows may have, not for good. Rows later than that are dropped by the watermarks.
    Works on tables as well, where nothing is dropped.
    """
    asked = requests.select("request_id", "asked_at").withWatermark("asked_at", disorder).alias("q")
    given = answers.select(F.col("request_id").alias("answered_id"), "answered_at", "answer")
    given = given.withWatermark("answered_at", disorder).alias("a")
    limit = F.expr(f"INTERVAL {limit_s} SECONDS")
    same = (
        (F.col("request_id") == F.col("answered_id"))
        & (F.col("answered_at") >= F.col("asked_at"))
        & (F.col("answered_at") <= F.col("asked_at") + limit)
    )
    return asked.join(given, same, "left_outer").select("request_id", "asked_at", "answered_at", "answer")


def timed_envelopes(met: DataFrame, limit_s: int = ANSWER_LIMIT_S) -> DataFrame:
    """``request_id, success, json, error``: the answer, or a failure for a request given up."""
    error = F.when(F.col("answered_at").isNull(), F.lit(f"no answer within {limit_s} seconds"))
    good = F.struct(F.lit(True).alias("success"), "answer")
    bad = F.struct(F.lit(False).alias("success"), error.alias("error"))
    return met.select(
        "request_id",
        error.isNull().alias("success"),
        F.when(error.isNull(), F.to_json(good, _KEEP_NULLS)).otherwise(F.to_json(bad, _KEEP_NULLS)).alias("json"),
        error.alias("error"),
    )
