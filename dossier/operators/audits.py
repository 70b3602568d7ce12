"""Audits of profile answers: reported, never refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CAREER_LEVELS, CONFIDENCES, PROFICIENCIES, ROLE_COUNT, STRENGTH_COUNT


def _outside(field: str, values: Column, allowed: tuple[str, ...]) -> Column:
    odd = F.filter(values, lambda v: ~v.isin(*allowed))
    return F.transform(odd, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))


def domain_audit(profiles: DataFrame) -> DataFrame:
    """Values outside the stated lists, with their number. One pass over the profiles."""
    p = F.col("profile")
    odd = F.concat(
        _outside("confidence", p.getField("inferred_job_roles").getField("confidence"), CONFIDENCES),
        _outside("career_level", F.array(p.getField("career_level")), CAREER_LEVELS),
        _outside(
            "proficiency_level",
            p.getField("skill_categories").getField("proficiency_level"),
            PROFICIENCIES,
        ),
    )
    return (
        profiles.select(F.explode(odd).alias("odd"))
        .select("odd.field", "odd.value")
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cardinality_audit(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Number of roles and strengths per profile, and whether each is in its range."""
    roles = F.size(F.col("profile").getField("inferred_job_roles"))
    strengths = F.size(F.col("profile").getField("key_strengths"))
    return profiles.select(
        *keys,
        roles.alias("n_roles"),
        roles.between(*ROLE_COUNT).alias("roles_ok"),
        strengths.alias("n_strengths"),
        strengths.between(*STRENGTH_COUNT).alias("strengths_ok"),
    )
