"""The whole run of a pipeline over many uploads, with its counts taken on the way.

Gates, text, extraction answer, analysis answer, stored profile, envelope: an upload leaves at
the first step it fails, and every upload gets exactly one envelope. The model is outside: it
is handed a table of requests and gives back a table of answers, in which any may be missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..fixed import ANSWER_LIMIT_S, MAX_FILE_MB, PDF, SERVICE_MESSAGES
from ..functions.text import has_text
from ..session import written
from ..sources.profiles import append_changes
from .assemble import assemble_units, leading_text
from .envelope import envelopes
from .intake import judge_uploads
from .requests import extraction_requests, profile_requests
from .responses import conform
from .state import batch_changes

Model = Callable[[DataFrame], DataFrame]

# Every way a run can end, step by step; the counts of a run have one number for each.
OUTCOMES = {
    "intake": ("type", "no_size", "size", "empty", "blank_text"),
    "extraction": ("no_answer", "malformed", "not_object", "reserved_key", "invalid"),
    "analysis": ("no_answer", "malformed", "not_object", "invalid"),
    "done": ("",),
}
_NO_ANSWER = (500, f"no answer within {ANSWER_LIMIT_S} seconds")


@dataclass
class Run:
    """``envelopes``: ``upload_id, step, reason, status, success, json, error``, one row per upload."""

    envelopes: DataFrame
    observation: Observation

    def counts(self) -> dict[tuple[str, str], int]:
        """Runs by step and reason, as seen while the envelopes were written; no second pass."""
        seen = self.observation.get
        return {(step, reason): seen[f"{step}:{reason}"] for step, reasons in OUTCOMES.items() for reason in reasons}


def _answered(asked: DataFrame, answers: DataFrame, which: str) -> DataFrame:
    """``upload_id``, the typed record and the verdict for each request, answered or not."""
    marked = answers.select("request_id", "answer", F.lit(True).alias("_met"))
    met = asked.join(conform(marked, "answer", which).drop("answer"), "request_id", "left")
    silent = F.col("_met").isNull()
    return met.select(
        "upload_id",
        which,
        F.when(silent, F.lit("no_answer")).otherwise(F.col("reason")).alias("reason"),
        F.when(silent, F.lit(_NO_ANSWER[0])).otherwise(F.col("status")).alias("status"),
        F.when(silent, F.lit(_NO_ANSWER[1]))
        .when(F.col("reason").isNotNull(), F.concat(F.lit("answer refused: "), F.col("reason")))
        .alias("error"),
    )


def whole_run(
    uploads: DataFrame,
    units: DataFrame,
    extract: Model,
    analyse: Model,
    profiles: str,
    writer: str,
    batch_id: int,
    mb: int = MAX_FILE_MB,
) -> Run:
    """Take every upload through all steps, apply the successes to the profile table, answer all.

    ``uploads`` holds ``upload_id, user_id, filename, mime, size_bytes, uploaded_at``, one row
    per upload; ``units`` the text layer ``doc_id, seq, text`` of their files. ``extract`` and
    ``analyse`` are given requests (``request_id, prompt`` and more) and return ``request_id,
    answer``, at most one each. The table at ``profiles`` gets one layer for ``writer`` and
    ``batch_id``; a run that is repeated adds none. A run without a user succeeds and is not
    stored, like one whose user is unknown to the database. Texts, records and answers are
    written once to the shared folder, because the steps after them branch.
    """
    gates = judge_uploads(uploads.withColumn("text", F.lit("any")), "service", mb).drop("text")
    gates = written(gates, "flow-gates")
    passed = gates.filter("reason IS NULL")
    kind = F.when(F.col("file_type") == PDF, "page").otherwise("paragraph")
    read = passed.select(F.col("upload_id").alias("doc_id"), kind.alias("kind"))
    texts = written(assemble_units(units.drop("kind").join(read, "doc_id")), "flow-texts")
    has = texts.select(F.col("doc_id").alias("upload_id"), has_text(F.col("text")).alias("has"))

    good = leading_text(texts.filter(has_text(F.col("text"))))
    asked = extraction_requests(good)
    key = F.col("doc_id").alias("upload_id")
    resumes = _answered(asked.select("request_id", key), extract(asked), "resume")
    resumes = written(resumes, "flow-resumes")

    fit = resumes.filter("reason IS NULL").select(F.col("upload_id").alias("person_id"), "resume")
    asked = profile_requests(fit)
    key = F.col("person_id").alias("upload_id")
    analysed = _answered(asked.select("request_id", key), analyse(asked), "profile")
    analysed = written(analysed, "flow-profiles")

    done = (
        gates.join(has, "upload_id", "left")
        .join(_prefixed(resumes, "e"), "upload_id", "left")
        .join(_prefixed(analysed, "a"), "upload_id", "left")
        .join(texts.select(F.col("doc_id").alias("upload_id"), F.col("text").alias("raw_text")), "upload_id", "left")
    )
    judged = done.withColumns(_verdict())
    record = F.struct("resume.*", "raw_text")
    ended = judged.select(
        "upload_id", "user_id", "filename", "uploaded_at", "step", "reason", "status", "error",
        F.when(F.col("step") == "done", record).alias("parsed_resume"),
        F.when(F.col("step") == "done", F.struct("profile.*", record.alias("original_resume"))).alias("profile_intelligence"),
    )
    runs = ended.filter("step = 'done'").select(
        F.col("upload_id").alias("run_id"),
        "user_id",
        F.col("uploaded_at").alias("ts"),
        F.lit(True).alias("success"),
        F.to_json("profile_intelligence", {"ignoreNullFields": "false"}).alias("profile_data"),
        F.col("filename").alias("source_filename"),
    )
    append_changes(batch_changes(runs), profiles, writer, batch_id)

    seen = Observation(f"run-{writer}-{batch_id}")
    numbers = [
        F.count_if((F.col("step") == step) & (F.coalesce("reason", F.lit("")) == reason)).alias(f"{step}:{reason}")
        for step, reasons in OUTCOMES.items()
        for reason in reasons
    ]
    said = ended.observe(seen, *numbers)
    keys = ["upload_id", "step", "reason", "status"]
    made = envelopes(said, keys)
    return Run(written(made, "flow-envelopes"), seen)


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    """Verdict columns under names of their own, so that two steps can stand side by side."""
    return rows.select(*[F.col(c).alias(f"{prefix}_{c}") if c in ("reason", "status", "error") else F.col(c) for c in rows.columns])


def _verdict() -> dict[str, Column]:
    """Step, reason, status and error of the first step an upload fails."""
    blank = ~F.coalesce("has", F.lit(False))
    steps = [
        (F.col("reason").isNotNull(), "intake", F.col("reason"), F.col("status"), F.col("error")),
        (blank, "intake", F.lit("blank_text"), F.lit(422), F.lit(SERVICE_MESSAGES["blank_text"])),
        (F.col("e_reason").isNotNull(), "extraction", *[F.col(f"e_{c}") for c in ("reason", "status", "error")]),
        (F.col("a_reason").isNotNull(), "analysis", *[F.col(f"a_{c}") for c in ("reason", "status", "error")]),
    ]

    def first(place: int, last: Column) -> Column:
        chosen = F
        for fails, *values in steps:
            value = values[place]
            chosen = chosen.when(fails, F.lit(value) if isinstance(value, str) else value)
        return chosen.otherwise(last)

    none = F.lit(None)
    return {
        "step": first(0, F.lit("done")),
        "reason": first(1, none.cast("string")),
        "status": first(2, none.cast("int")),
        "error": first(3, none.cast("string")),
    }
