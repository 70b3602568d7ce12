"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A JSON object that repeats a key keeps the last value, as strict JSON readers do.
REQUIRED_CONF = {"spark.sql.variant.allowDuplicateKeys": "true"}

# Defaults for sessions made here. A cluster sets its own partition counts.
DEFAULT_CONF = {
    **REQUIRED_CONF,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the settings needed for right results on a running session."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str, shuffle_partitions: int, memory: str = "8g") -> SparkSession:
    """Session for tests and for the benchmark."""
    builder = SparkSession.builder.master(master).appName("dossier")
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach, named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made, but only for a session that runs in this
    one process; on a cluster other machines would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir has to name a shared folder (master: {master})")
    return tempfile.mkdtemp(prefix="dossier-")


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back.

    For a frame that several branches of a job read: the table cuts the lineage, survives
    the loss of executors, and each branch reads only the columns it needs.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
