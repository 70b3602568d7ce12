"""Dashboard cards and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import avatar, display_name, plain_number


def _said(number, unit: str):
    return F.concat(number, F.lit(unit))


def stat_cards(resumes: DataFrame, profiles: DataFrame, key: str = "person_id") -> DataFrame:
    """Four cards per person: from the profile if there is one, else from the resume.

    ``profiles`` holds ``key, profile``, at most one row per person.

    List sizes are taken inside the row; only narrow counts are shuffled. Skills listed
    under two categories count twice. Parts of one person are added up.
    """
    resume = F.col("resume")
    skills = F.aggregate(
        resume.getField("skills"),
        F.lit(0).cast("long"),
        lambda n, group: n + F.size(group.getField("skills")),
    )
    sizes = {
        "n_experience": F.size(resume.getField("experience")),
        "n_skills": skills,
        "n_projects": F.size(resume.getField("projects")),
        "n_education": F.size(resume.getField("education")),
    }
    counts = (
        resumes.select(key, *[c.alias(n) for n, c in sizes.items()])
        .groupBy(key)
        .agg(*[F.sum(n).alias(n) for n in sizes])
    )
    p = F.col("profile")
    roles = F.size(p.getField("inferred_job_roles"))
    shown = profiles.select(
        key,
        F.lit(True).alias("analysed"),
        p.getField("career_level").alias("level"),
        _said(p.getField("profile_completeness").getField("overall_score"), "%").alias("score"),
        _said(plain_number(p.getField("total_years_experience")), " Yrs").alias("years"),
        _said(roles, " roles").alias("matches"),
    )

    def card(from_profile: str, count: str, unit: str):
        return F.when(F.col("analysed"), F.col(from_profile)).otherwise(
            _said(F.col(count).cast("string"), unit)
        )

    return counts.join(shown, key, "left").select(
        key,
        F.when(F.col("analysed"), "profile").otherwise("resume").alias("card_set"),
        card("level", "n_experience", " roles").alias("card_1"),
        card("score", "n_skills", " found").alias("card_2"),
        card("years", "n_projects", " listed").alias("card_3"),
        card("matches", "n_education", " entries").alias("card_4"),
    )


def identity(users: DataFrame, keys: list[str]) -> DataFrame:
    """Name and avatar a user is greeted with."""
    named = users.select(
        *keys, display_name(F.col("full_name"), F.col("email")).alias("display_name")
    )
    return named.withColumn("avatar", avatar(F.col("display_name")))


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs per outcome and the share of successes, for each ``by`` group.

    The window runs over the grouped counts: one row per outcome, not per run.
    """
    counts = runs.groupBy(*by, "success", "reason", "status").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    good = F.sum(F.when(F.col("success"), F.col("n")).otherwise(0)).over(group)
    return counts.withColumn("success_share", good / F.sum("n").over(group))
