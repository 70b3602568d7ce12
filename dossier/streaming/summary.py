"""Outcomes of pipeline runs by event time, as the runs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(runs: DataFrame, length: str = "1 day", disorder: str = "1 hour") -> DataFrame:
    """``window_start, success, n, n_users``: runs and users per window and outcome.

    ``runs`` holds ``ts`` (a timestamp), ``success`` and ``user_id``. A window is given out once
    the watermark, ``disorder`` behind the latest run, has passed its end; runs that come later
    than that are dropped, and until then they count in the window they belong to. Users are
    counted by a sketch-free set: one row per window and user is kept until the window closes.
    Works on tables as well, where nothing is dropped.
    """
    timed = runs.select("ts", "success", "user_id").withWatermark("ts", disorder)
    per_user = timed.groupBy(F.window("ts", length), "success", "user_id").agg(F.count("*").alias("n"))
    whole = per_user.groupBy(F.window(F.window_time("window"), length).alias("w"), "success")
    counted = whole.agg(F.sum("n").alias("n"), F.count("user_id").alias("n_users"))
    return counted.select(F.col("w.start").alias("window_start"), "success", "n", "n_users")
