"""Profile table kept as Parquet layers.

Layout: ``<path>/data/version=N/bucket=B`` holds the rows of layer N whose users hash to B,
``<path>/log`` one row per published layer. A layer of kind ``base`` is a whole table, a
``change`` layer holds the rows one batch changed, deletions as tombstones. Readers fold the last base and the changes after it; a layer
that is not in the log does not exist for them. So a batch costs as much as it changes,
and nothing that is being read is overwritten. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.state import COLUMNS, fold_profiles
from ..schemas import PROFILE_ROW

LOG = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
# Folders that the users of a layer are dealt over by a hash, so that one user's read opens one.
BUCKETS = 32

_LAYER = T.StructType(
    [T.StructField(f.name, f.dataType, True) for f in PROFILE_ROW.fields]
    + [
        T.StructField("deleted", T.BooleanType()),
        T.StructField("version", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)


def bucket_of(user_id: Column) -> Column:
    """The folder a user's rows lie in."""
    return F.pmod(F.xxhash64(user_id.cast("string")), F.lit(BUCKETS)).cast("int")


def layers_log(spark: SparkSession, path: str) -> DataFrame:
    """Published layers; empty if nothing was written yet."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Latest version and latest base; two numbers, whatever the table holds."""
    base = F.max(F.when(F.col("kind") == "base", F.col("version")))
    row = layers_log(spark, path).agg(F.max("version").alias("v"), base.alias("b")).first()
    return row.v or 0, row.b or 0


def _publish(spark, path: str, version: int, kind: str, writer: str, batch_id: int) -> None:
    entry = spark.createDataFrame([(version, kind, writer, batch_id)], LOG)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/log")


def _write_layer(rows: DataFrame, path: str, kind: str, writer: str, batch_id: int) -> int:
    spark = rows.sparkSession
    version = _state(spark, path)[0] + 1
    if "deleted" not in rows.columns:
        rows = rows.withColumn("deleted", F.lit(False))
    dealt = rows.select(*COLUMNS, "deleted").withColumn("bucket", bucket_of(F.col("user_id")))
    dealt = dealt.repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    _publish(spark, path, version, kind, writer, batch_id)
    return version


def write_profiles(profiles: DataFrame, path: str) -> int:
    """Write a whole table as a new base and switch readers to it. Returns the version."""
    return _write_layer(profiles, path, "base", "batch", -1)


def append_changes(changes: DataFrame, path: str, writer: str, batch_id: int, fold_after: int = 0) -> bool:
    """Publish the rows a batch changed. A batch already published is skipped.

    With ``fold_after`` the table is folded into a new base as soon as that many layers lie on
    the last one, so that readers never open more.
    """
    spark = changes.sparkSession
    done = layers_log(spark, path).filter(
        (F.col("writer") == writer) & (F.col("batch_id") == batch_id)
    )
    if not done.isEmpty():
        return False
    version = _write_layer(changes, path, "change", writer, batch_id)
    if fold_after and version - _state(spark, path)[1] >= fold_after:
        compact(spark, path)
    return True


def append_deletions(users: DataFrame, path: str, writer: str, batch_id: int) -> bool:
    """Publish that the profiles of ``users`` (``user_id``) are gone: one narrow row for each.

    A tombstone hides everything its user has in earlier layers. A later success starts anew,
    with an id and a creation time of its own.
    """
    gone = users.select("user_id").filter("user_id IS NOT NULL").distinct()
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in PROFILE_ROW.fields if f.name != "user_id"]
    return append_changes(gone.select("user_id", *blank, F.lit(True).alias("deleted")), path, writer, batch_id)


def cascade_deletions(spark: SparkSession, users: DataFrame, path: str, writer: str, batch_id: int) -> bool:
    """Delete the profiles whose user is not among ``users``; payloads are neither read nor written."""
    here = read_profiles(spark, path).select("user_id")
    return append_deletions(here.join(users.select("user_id"), "user_id", "left_anti"), path, writer, batch_id)


def read_profiles(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """Current row of every user, or of one, for whom only their folder of each layer is opened."""
    version, base = _state(spark, path)
    if version == 0:
        return spark.createDataFrame([], PROFILE_ROW)
    log = layers_log(spark, path).filter(F.col("version").between(base, version))
    live = [f"{path}/data/version={r.version}" for r in log.select("version").orderBy("version").collect()]
    # Published layers are named one by one: a half-written one is not even listed.
    current = spark.read.schema(_LAYER).option("basePath", f"{path}/data").parquet(*live)
    if user_id is not None:
        current = current.filter((F.col("bucket") == bucket_of(F.lit(user_id))) & (F.col("user_id") == F.lit(user_id)))
    # Tombstones are few and narrow; what lies below a user's last one does not count.
    gone = current.filter("deleted").groupBy("user_id").agg(F.max("version").alias("gone_at"))
    kept = current.filter("NOT deleted").join(gone, "user_id", "left")
    return fold_profiles(kept.filter("gone_at IS NULL OR version > gone_at"), "version")


def compact(spark: SparkSession, path: str) -> int:
    """Fold all layers into a new base, so that readers open fewer files."""
    return write_profiles(read_profiles(spark, path), path)


def remove_old_layers(spark: SparkSession, path: str) -> int:
    """Delete what lies below the last base. Returns how many layers went.

    For a time when no reader works on them any more: one that started before the base was
    published may still do so.
    """
    base = _state(spark, path)[1]
    old = [r.version for r in layers_log(spark, path).filter(F.col("version") < base).select("version").collect()]
    jvm, removed = spark._jvm, 0
    for version in old:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/data/version={version}")
        removed += folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return removed
