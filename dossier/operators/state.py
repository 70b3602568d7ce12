"""One current profile per user: upsert, visibility, cascade, constraint audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PROFILE_ROW

COLUMNS = PROFILE_ROW.names


def profile_id(user_id: Column) -> Column:
    """Row id made from the user id, so that a repeated job gives the same id."""
    digest = F.md5(user_id.cast("string"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, n) for start, n in cuts])


def batch_changes(runs: DataFrame) -> DataFrame:
    """Profile rows a batch of runs leaves behind, one per user.

    ``runs`` holds ``run_id, user_id, ts, success, profile_data, source_filename``. A
    failed run writes nothing, nor does one that :func:`refused_runs` lists. The latest success wins whole: its null filename replaces
    a known one. Grouping has a partial step, so a user with a third of all runs is
    reduced to one row per task before the shuffle.
    """
    return (
        runs.filter("success AND user_id IS NOT NULL AND profile_data IS NOT NULL")
        .groupBy("user_id")
        .agg(
            F.max_by(F.struct("profile_data", "source_filename"), F.struct("ts", "run_id")).alias("p"),
            F.min("ts").alias("created_at"),
            F.max("ts").alias("updated_at"),
        )
        .select(
            profile_id(F.col("user_id")).alias("id"),
            "user_id",
            "p.profile_data",
            "p.source_filename",
            "created_at",
            "updated_at",
        )
    )


def refused_runs(runs: DataFrame) -> DataFrame:
    """Successful runs that the table does not take, with the rule they break."""
    reason = F.when(F.col("user_id").isNull(), "null_user_id").when(F.col("profile_data").isNull(), "null_profile_data")
    return runs.filter("success").withColumn("reason", reason).filter("reason IS NOT NULL")


def fold_profiles(layers: DataFrame, order: str) -> DataFrame:
    """Current row per user out of layers stacked in ``order``.

    Id and creation time come from the first layer of a user, the rest from the last.
    """
    first = F.min_by(F.struct("id", "created_at"), order)
    last = F.max_by(F.struct("profile_data", "source_filename", "updated_at"), order)
    return (
        layers.groupBy("user_id")
        .agg(first.alias("a"), last.alias("z"))
        .select(
            "a.id", "user_id", "z.profile_data", "z.source_filename", "a.created_at", "z.updated_at"
        )
    )


def upsert(snapshot: DataFrame, runs: DataFrame) -> DataFrame:
    """Snapshot after a batch of runs: insert new users, replace the payload of others."""
    layers = (
        snapshot.select(*COLUMNS)
        .withColumn("layer", F.lit(0))
        .unionByName(batch_changes(runs).withColumn("layer", F.lit(1)))
    )
    return fold_profiles(layers, "layer")


def visible_profiles(profiles: DataFrame, user_id: str | None, role: str) -> DataFrame:
    """Rows a reader may see: their own, or all for the service role."""
    if role == "service_role":
        return profiles
    return profiles.filter(F.col("user_id") == F.lit(user_id))


def visible_to(profiles: DataFrame, readers: dict[str, tuple[str | None, str]]) -> DataFrame:
    """``reader`` and the rows it may see, for several readers in one pass.

    ``readers`` gives the user and the role of each.
    """
    seen = [
        F.lit(name) if role == "service_role" else F.when(F.col("user_id") == F.lit(user), F.lit(name))
        for name, (user, role) in readers.items()
    ]
    return profiles.select(F.explode(F.array_compact(F.array(*seen))).alias("reader"), *profiles.columns)


def cascade(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Profiles whose user still exists."""
    return profiles.join(users.select("user_id"), "user_id", "left_semi")


def constraint_audit(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Rows that break a rule the files cannot enforce, with their number per user.

    Rules: user and payload present, one row per user, user exists. All are read off one
    count per user, so the profiles are shuffled once.
    """
    per_user = profiles.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("profile_data").isNull().cast("long")).alias("n_null_data"),
    )
    known = users.select("user_id", F.lit(True).alias("known")).distinct()
    marked = per_user.join(known, "user_id", "left")
    has_user = F.col("user_id").isNotNull()
    broken = [
        ("null_user_id", ~has_user, F.col("n")),
        ("null_profile_data", F.col("n_null_data") > 0, F.col("n_null_data")),
        ("duplicate_user_id", has_user & (F.col("n") > 1), F.col("n")),
        ("orphan_user_id", has_user & F.col("known").isNull(), F.col("n")),
    ]
    found = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(rule).alias("violation"), n.alias("n_rows")))
                for rule, test, n in broken
            ]
        )
    )
    return marked.select("user_id", F.explode(found).alias("v")).select(
        "v.violation", "user_id", "v.n_rows"
    )
