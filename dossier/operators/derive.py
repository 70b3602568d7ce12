"""Columns derived from records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import loose_date
from ..functions.display import date_span, link, meta_line, organisation
from ..functions.text import has_text

COVERED_SECTIONS = (
    "contact_info",
    "summary",
    "education",
    "experience",
    "skills",
    "projects",
    "certifications",
)


def completeness(resumes: DataFrame, key: str = "person_id") -> DataFrame:
    """Which of seven sections a person has, which are missing, and the share covered.

    The share is a rule of our own, not the score a model gives. A person whose resume
    has several parts has a section if any part has it.
    """
    info = F.col("resume").getField("personal_info")
    present = {
        "contact_info": has_text(info.getField("email")) | has_text(info.getField("phone")),
        "summary": has_text(info.getField("summary")),
        **{s: F.size(F.col("resume").getField(s)) > 0 for s in COVERED_SECTIONS[2:]},
    }
    flags = resumes.select(key, *[c.alias(f"has_{s}") for s, c in present.items()])
    person = flags.groupBy(key).agg(
        *[F.bool_or(f"has_{s}").alias(f"has_{s}") for s in COVERED_SECTIONS]
    )
    missing = F.array_compact(
        F.array(*[F.when(~F.col(f"has_{s}"), F.lit(s)) for s in COVERED_SECTIONS])
    )
    covered = F.round(
        100.0 * (len(COVERED_SECTIONS) - F.size("missing_sections")) / len(COVERED_SECTIONS)
    )
    return person.withColumn("missing_sections", missing).withColumn(
        "section_coverage_pct", covered.cast("int")
    )


def years_experience(entries: DataFrame, as_of: date, key: str = "person_id") -> DataFrame:
    """Years a person worked, overlapping entries counted once.

    ``entries`` holds ``key, start_date, end_date, is_current`` as written. An entry
    without a readable end counts to ``as_of`` if it is current. Entries without a
    readable start or end, or with an end before the start, are counted but not used.

    Entries are first reduced to one row per person and start day, by a partial
    aggregate. So the window sees at most one row per calendar day for any person,
    however many entries that person has.
    """
    start = loose_date(F.col("start_date"))
    end = F.coalesce(loose_date(F.col("end_date")), F.when(F.col("is_current"), F.lit(as_of)))
    dated = entries.select(key, start.alias("s"), end.alias("e"))
    usable = F.coalesce(F.col("e") >= F.col("s"), F.lit(False))
    days = (
        dated.select(key, F.when(usable, F.col("s")).alias("s"), F.when(usable, F.col("e")).alias("e"))
        .groupBy(key, "s")
        .agg(F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))
    )
    before = Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    reached = days.withColumn("reached", F.max("e").over(before))
    opens = F.coalesce(F.col("s") > F.col("reached"), F.col("s").isNotNull())
    fresh = F.date_diff("e", F.greatest("s", "reached"))
    used = F.col("s").isNotNull()
    total = F.coalesce(F.sum(F.greatest(fresh, F.lit(0))), F.lit(0))
    return (
        reached.groupBy(key)
        .agg(
            F.sum("n").alias("n_entries"),
            F.sum(F.when(used, F.lit(0)).otherwise(F.col("n"))).alias("n_ignored"),
            F.sum(opens.cast("int")).alias("n_periods"),
            total.alias("days"),
        )
        .withColumn("years", F.round(F.col("days") / 365.25, 1))
    )


def rank_roles(profiles: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """Roles by confidence: high, medium, low, anything else; ties stay as given.

    Roles are sorted inside their row, so nothing is shuffled. ``top`` keeps the first few.
    """
    order = F.create_map(
        *[F.lit(x) for pair in (("high", 1), ("medium", 2), ("low", 3)) for x in pair]
    )

    def sortable(role, pos):
        rank = F.coalesce(order[F.lower(role.getField("confidence"))], F.lit(4))
        return F.struct(rank.alias("r"), pos.alias("p"), role.alias("role"))

    ranked = F.array_sort(
        F.transform(F.col("profile").getField("inferred_job_roles"), sortable)
    )
    if top is not None:
        ranked = F.slice(ranked, 1, top)
    return profiles.select(*keys, F.posexplode(ranked).alias("pos", "x")).select(
        *keys,
        (F.col("pos") + 1).alias("rank"),
        (F.col("x.p") + 1).alias("given_pos"),
        "x.role.title",
        "x.role.confidence",
        F.lower("x.role.confidence").alias("confidence_key"),
        "x.role.reasoning",
    )


def timeline(experience: DataFrame, keys: list[str]) -> DataFrame:
    """Display row of an experience entry."""
    return experience.select(
        *keys,
        "title",
        organisation(F.col("company"), F.col("location")).alias("organisation"),
        date_span(F.col("start_date"), F.col("end_date"), F.col("is_current")).alias("dates"),
    )


def education_lines(education: DataFrame, keys: list[str]) -> DataFrame:
    """Display row of an education entry."""
    return education.select(
        *keys,
        "institution",
        meta_line([F.col("degree"), F.col("field_of_study")], "GPA", F.col("gpa")).alias("meta"),
        date_span(F.col("start_date"), F.col("end_date")).alias("dates"),
    )


def certification_lines(certifications: DataFrame, keys: list[str]) -> DataFrame:
    """Display row of a certification."""
    return certifications.select(
        *keys,
        "name",
        meta_line([F.col("issuer"), F.col("date")], "ID", F.col("credential_id")).alias("meta"),
    )


def links(df: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """Link target of a written address."""
    return df.select(*keys, F.col(url).alias("written"), link(F.col(url)).alias("href"))
