"""Upload manifests and text layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import DOCX, MSWORD, PARSER_MESSAGES, PDF

MANIFEST = ("upload_id", "user_id", "filename", "mime", "size_bytes", "uploaded_at")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Manifest table: one row per uploaded file."""
    return spark.read.parquet(path).select(*MANIFEST)


def upload_files(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of a folder of files. Sizes come from the listing; contents are not read.

    Spark's file scan leaves out files of zero bytes. Where the gate for empty files
    matters, read a manifest table with :func:`uploads`, which lists them.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )
    return files.select(
        F.sha1("path").alias("upload_id"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.lit(None).cast("string").alias("mime"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("uploaded_at"),
    )


def text_units(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text layer table of parsed files, split by :func:`split_units`."""
    return split_units(spark.read.parquet(path))


def split_units(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units of known types as ``doc_id, seq, text, kind``, and documents of other types.

    PDF text comes in pages, DOCX text in paragraphs. A document whose ``mime`` is neither
    goes to the second frame with an error.
    """
    kind = F.when(F.col("mime") == PDF, "page").when(
        F.col("mime").isin(DOCX, MSWORD), "paragraph"
    )
    typed = units.withColumn("kind", kind)
    known = typed.filter(F.col("kind").isNotNull()).select("doc_id", "seq", "text", "kind")
    said_before, said_after = PARSER_MESSAGES["type"].split("{type}")
    other = (
        typed.filter(F.col("kind").isNull())
        .select("doc_id", F.coalesce("mime", F.lit("")).alias("mime"))
        .distinct()
        .withColumn("error", F.concat(F.lit(said_before), F.col("mime"), F.lit(said_after)))
    )
    return known, other
