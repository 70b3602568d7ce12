"""Continuous upsert of profile runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import batch_changes
from ..sources.profiles import append_changes, layers_log


def arriving_files(spark: SparkSession, path: str, schema: str | T.StructType, per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first, so many in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def stream_upsert(
    runs: DataFrame, path: str, checkpoint: str, name: str = "upsert", trigger: dict | None = None
) -> StreamingQuery:
    """Apply every micro-batch of a stream of runs to the profile table at ``path``.

    A batch is published once: when Spark repeats it after a failure, its id is found in
    the log and nothing is written. ``path`` and ``checkpoint`` lie on shared storage, and
    a stream that is started again with both goes on after the last batch it published.
    ``name`` tells the log who wrote a layer: keep it over restarts.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        append_changes(batch_changes(batch), path, name, batch_id)

    return (
        runs.writeStream.queryName(name)
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stop_after(query: StreamingQuery, path: str, layers: int, wait: float = 0.05) -> int:
    """Stop a stream as soon as its table has so many layers, in the middle of what it does then.

    Returns the layers that were published. A stream that ends by itself before is left alone.
    """
    spark = SparkSession.active()
    while query.isActive and layers_log(spark, path).count() < layers:
        time.sleep(wait)
    query.stop()
    return layers_log(spark, path).count()


def appended(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything a stream has to give, written as Parquet batch by batch, and read back.

    Each batch is written once: the folder keeps a log of the files that count.
    """
    made = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    made.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
