"""Helpers the operators share: word rules, stored tables, sorted numbering."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Words of letters, digits and everything beyond ASCII (after lower-casing A-Z).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The same rule on UTF-8 bytes: lower-case, turn every other ASCII byte into a space, split.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

# Rows and bytes per Arrow batch. Texts are long, so batches are kept small; results do not depend on it.
BATCH_ROWS, BATCH_BYTES = "1000", str(2 << 20)


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep the batches that Python workers hold small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def release() -> None:
    """Give memory that this process holds free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what was freed; others need no call
    if trim:
        trim(0)


def lean(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over batches whose worker keeps no free memory when a task ends.

    Executors keep their workers for later tasks, where what one step freed would count beside
    what the next one needs.
    """

    def run(batches: Iterator) -> Iterator:
        yield from step(batches)
        release()

    return run


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of words; none for null."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_list(text: str | None) -> list[bytes]:
    """The words of one text, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def token_list(text: str | None) -> list[bytes]:
    """Runs of non-space characters, A-Z in lower case, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_scratch: ContextVar[tuple[list[Stored], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """What operators store inside goes at the end. A result has to be written before, to a place made outside."""
    made: list[Stored] = []
    token = _scratch.set((*_scratch.get(), made))
    try:
        yield
    finally:
        _scratch.reset(token)
        for store in made:
            store.clear()


class Stored:
    """Tables written to the shared folder by one job, so that they can be removed with it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        for made in _scratch.get():
            made.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        """The same rows read back from Parquet; cuts the lineage and survives lost executors."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for table in tables:
            self._remove(table.stored_at)

    def clear(self) -> None:
        """Remove all tables of this place."""
        self._remove(self.base)

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def column_named(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that others cannot clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have in any letter case."""
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows stored once with a number of their own, and the name of its column."""
    name = free_name(docs, "_row")
    return Stored(docs.sparkSession, label).write(docs.withColumn(name, F.monotonically_increasing_id())), name


def one_per_component(kept: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """The one row of each component that is first by id (null last), text and number.

    ``kept`` holds the rows with their number, ``found`` gives ``row, component`` for each.
    Ids decide alone where they can; texts are read only where an id is null or repeated.
    """
    store = Stored(kept.sparkSession, "keepers")
    ids = kept.select(F.col(row).alias("row"), "doc_id")
    narrow = store.write(found.join(ids, "row").select("row", "component", "doc_id"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("first"))
    least = narrow.groupBy("component").agg(F.min(key).alias("k"))
    tied = narrow.join(least, "component").filter(F.col("doc_id").eqNullSafe(F.col("k.first")))
    best = tied.groupBy("component").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    several = tied.select("component", "row").join(best.filter("n > 1").select("component"), "component")
    texts = kept.select(F.col(row).alias("row"), "text").join(several, "row")
    chosen = texts.groupBy("component").agg(F.min(F.struct("text", "row")).alias("k")).select("k.row")
    stay = best.filter("n = 1").select("row").unionByName(chosen)
    gone = store.write(narrow.join(stay, "row", "left_anti").select(F.col("row").alias(row)))
    return kept.join(gone, row, "left_anti").drop(row).select(*[F.col(f"`{c}`") for c in kept.columns if c != row])
