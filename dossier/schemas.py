"""Record shapes.

Each field states how a missing or null value is treated:

* not nullable, no default: required, and null is refused;
* nullable: may be missing or null, both read as null;
* ``default`` in the metadata: may be missing, then takes the default; null is refused.

``ge``/``le`` in the metadata bound an integer.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _required(name: str, kind: T.DataType, **rule) -> T.StructField:
    return T.StructField(name, kind, False, rule or None)


def _text(name: str) -> T.StructField:
    return T.StructField(name, T.StringType(), True)


def _must(name: str) -> T.StructField:
    return _required(name, T.StringType())


def _list(name: str, item: T.DataType) -> T.StructField:
    return _required(name, T.ArrayType(item, False), default="[]")


def _flag(name: str) -> T.StructField:
    return _required(name, T.BooleanType(), default="false")


STRINGS = T.StringType()

PERSONAL_INFO = T.StructType(
    [
        _text(n)
        for n in ("name", "email", "phone", "location", "linkedin", "github", "website", "summary")
    ]
)

EDUCATION = T.StructType(
    [_must("institution")]
    + [
        _text(n)
        for n in ("degree", "field_of_study", "start_date", "end_date", "gpa", "description")
    ]
)

EXPERIENCE = T.StructType(
    [_must("company"), _must("title")]
    + [_text(n) for n in ("location", "start_date", "end_date")]
    + [_flag("is_current"), _list("responsibilities", STRINGS)]
)

PROJECT = T.StructType(
    [_must("name"), _text("description"), _list("technologies", STRINGS)]
    + [_text(n) for n in ("url", "start_date", "end_date")]
)

CERTIFICATION = T.StructType(
    [_must("name")] + [_text(n) for n in ("issuer", "date", "expiry", "credential_id")]
)

SKILL_GROUP = T.StructType([_must("category"), _list("skills", STRINGS)])

# What an extraction answer holds. The raw text travels beside it, never inside.
RESUME = T.StructType(
    [
        T.StructField("personal_info", PERSONAL_INFO, True),
        _list("education", EDUCATION),
        _list("experience", EXPERIENCE),
        _list("projects", PROJECT),
        _list("certifications", CERTIFICATION),
        _list("skills", SKILL_GROUP),
        _list("languages", STRINGS),
    ]
)

JOB_ROLE = T.StructType([_must("title"), _must("confidence"), _must("reasoning")])

SKILL_INFERENCE = T.StructType(
    [_must("category"), _list("skills", STRINGS), _must("proficiency_level")]
)

SECTION_FLAGS = (
    "has_contact_info",
    "has_summary",
    "has_education",
    "has_experience",
    "has_skills",
    "has_projects",
    "has_certifications",
)

COMPLETENESS = T.StructType(
    [_required("overall_score", T.IntegerType(), ge=0, le=100)]
    + [_flag(n) for n in SECTION_FLAGS]
    + [_list("missing_sections", STRINGS), _list("improvement_suggestions", STRINGS)]
)

# What an analysis answer holds; the original resume is joined on afterwards.
PROFILE = T.StructType(
    [
        _list("inferred_job_roles", JOB_ROLE),
        _must("career_level"),
        _required("total_years_experience", T.DoubleType(), default="0.0"),
        _list("skill_categories", SKILL_INFERENCE),
        _required("profile_completeness", COMPLETENESS),
        _list("industry_domains", STRINGS),
        _list("key_strengths", STRINGS),
        _required("professional_summary", STRINGS, default="''"),
    ]
)



def column_type(kind: T.DataType) -> T.DataType:
    """Spark type of a record without its rules: everything may be null."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, column_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(column_type(kind.elementType))
    return kind


LIST_SECTIONS = ("education", "experience", "projects", "certifications", "skills", "languages")

# Stored profile rows. The payload is JSON text, so any reader can load it.
PROFILE_ROW = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("profile_data", T.StringType(), False),
        T.StructField("source_filename", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("updated_at", T.TimestampNTZType(), False),
    ]
)
