"""Request tables for the external language model.

The model itself is outside Spark: a request table goes out, an answer table comes in.
Wording is a setting; the record skeletons are rendered from the schemas.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import (
    ANALYSIS_TEMPERATURE,
    CAREER_LEVELS,
    CONFIDENCES,
    EXTRACTION_TEMPERATURE,
    MAX_TOKENS,
    PROFICIENCIES,
    ROLE_COUNT,
    STRENGTH_COUNT,
)
from ..schemas import PROFILE, RESUME


def skeleton(kind: T.DataType, nullable: bool = False):
    """Example value that shows a model the shape of a record."""
    if isinstance(kind, T.StructType):
        return {f.name: skeleton(f.dataType, f.nullable) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [skeleton(kind.elementType)]
    if isinstance(kind, T.BooleanType):
        return False
    if isinstance(kind, T.IntegerType):
        return 0
    if isinstance(kind, T.DoubleType):
        return 0.0
    return "string or null" if nullable else "string"


@dataclass(frozen=True)
class Template:
    """Wording around the data of a request. The data is never read as a pattern."""

    kind: str
    system: str
    before: str
    after: str
    temperature: float
    max_tokens: int = MAX_TOKENS


def _words(values) -> str:
    return ", ".join(values)


EXTRACTION = Template(
    kind="extraction",
    system="Turn career documents into JSON records. Answer with one JSON object only.",
    before=(
        "Read the document below and fill in this record. Use null for absent text and an "
        "empty list for an absent section, copy dates as written, group skills by topic, "
        "give each bullet its own entry, and add nothing the document does not say.\n\n"
        + json.dumps(skeleton(RESUME), indent=2)
        + "\n\nDocument:\n"
    ),
    after="\n",
    temperature=EXTRACTION_TEMPERATURE,
)

ANALYSIS = Template(
    kind="analysis",
    system="Describe the career profile behind a resume record. Answer with one JSON object only.",
    before=(
        "Study the resume record below and fill in this profile. "
        f"Name {ROLE_COUNT[0]} to {ROLE_COUNT[1]} fitting roles, best first, each rated "
        f"{_words(CONFIDENCES)}; {STRENGTH_COUNT[0]} to {STRENGTH_COUNT[1]} strengths; a level "
        f"out of {_words(CAREER_LEVELS)}; a proficiency per skill group out of "
        f"{_words(PROFICIENCIES)}; years worked, taken from the dates; and a completeness "
        "score from 0 to 100. Leave the resume itself out.\n\n"
        + json.dumps(skeleton(PROFILE), indent=2)
        + "\n\nResume:\n"
    ),
    after="\n",
    temperature=ANALYSIS_TEMPERATURE,
)


def _request(template: Template, body) -> list:
    return [
        F.lit(template.kind).alias("kind"),
        F.lit(template.system).alias("system"),
        F.concat(F.lit(template.before), body, F.lit(template.after)).alias("prompt"),
        F.lit(template.temperature).alias("temperature"),
        F.lit(template.max_tokens).alias("max_tokens"),
    ]


def extraction_requests(
    docs: DataFrame, template: Template = EXTRACTION
) -> DataFrame:
    """One request per document, with the text as it is given. For a model that accepts only so
    much, give the result of :func:`~dossier.operators.assemble.leading_text`."""
    request_id = F.concat(F.lit("extraction-"), F.col("doc_id").cast("string"))
    return docs.select(
        request_id.alias("request_id"), "doc_id", *_request(template, F.col("text"))
    )


def resume_json(resume: Column) -> Column:
    """Resume as JSON in field order, nulls kept (they are dropped by default)."""
    return F.to_json(resume, {"ignoreNullFields": "false"})


def profile_requests(resumes: DataFrame, template: Template = ANALYSIS) -> DataFrame:
    """One request per resume record; the raw text is not part of the record."""
    request_id = F.concat_ws("-", F.lit("analysis"), "person_id")
    return resumes.select(
        request_id.alias("request_id"),
        "person_id",
        *_request(template, resume_json(F.col("resume"))),
    )
