"""Uploaded files as a Spark data source of their own.

Spark's file sources leave out files of zero bytes; this one lists them, so that the gate for
empty files can fire. Folders are listed by tasks, one folder below the root each, and file
contents are read only when asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "uploaded_files"

_COLUMNS = "path string, folder string, filename string, size_bytes long, uploaded_at timestamp, content binary"
_TYPES = [
    ("path", pa.string()),
    ("folder", pa.string()),
    ("filename", pa.string()),
    ("size_bytes", pa.int64()),
    ("uploaded_at", pa.timestamp("us", "UTC")),
    ("content", pa.binary()),
]

# Rows of a batch, and bytes of content after which a batch is given out.
BATCH_ROWS, BATCH_BYTES = 5_000, 16 << 20


@dataclass
class Folder(InputPartition):
    """A folder to list: all below it, or (``deep`` false) only its own files."""

    path: str
    name: str
    deep: bool


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path on it, and what stands before it in full."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/"), ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/"), path.split("://")[0] + "://" if "://" in path else "file:"


class UploadReader(DataSourceReader):
    def __init__(self, path: str, content: bool, limit: int, only: str | None):
        self.path, self.content, self.limit, self.only = path, content, limit, only

    def partitions(self) -> list[InputPartition]:
        """One per folder below the root, and one for the files of the root itself."""
        system, root, _ = _opened(self.path)
        below = [x for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory]
        found = [Folder(root, "", False), *[Folder(x.path, x.base_name, True) for x in sorted(below, key=lambda x: x.path)]]
        # Spark wants one at least; the one without a path lists nothing.
        return [x for x in found if self.only is None or x.name == self.only] or [Folder("", "", False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _, before = _opened(self.path)
        rows: list[tuple] = []
        weight = 0
        for info in system.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep)):
            if info.type != fs.FileType.File:
                continue
            content = None
            # What the size gate refuses anyway is never loaded.
            if self.content and info.size <= self.limit:
                with system.open_input_stream(info.path) as stream:
                    content = stream.read()
                weight += len(content)
            changed = info.mtime.astimezone(UTC) if info.mtime is not None else None
            rows.append((before + info.path, partition.name, info.base_name, info.size, changed, content))
            if len(rows) >= BATCH_ROWS or weight >= BATCH_BYTES:
                yield self._batch(rows)
                rows, weight = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(cols, _TYPES, strict=True)], [n for n, _ in _TYPES])


class UploadSource(DataSource):
    """``spark.read.format("uploaded_files").option("content", "true").load(root)``.

    Options: ``content`` (default false) loads the bytes of files of at most ``limit`` bytes
    (default 10 MB); otherwise ``content`` is null. ``folder`` names the one folder below the
    root to list.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _COLUMNS

    def reader(self, schema) -> UploadReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("the folder of the uploads is missing")
        content = str(self.options.get("content", "false")).lower() == "true"
        return UploadReader(path, content, int(self.options.get("limit", 10 << 20)), self.options.get("folder"))


def scan_uploads(spark: SparkSession, path: str, content: bool = False, folder: str | None = None) -> DataFrame:
    """Manifest of a folder of uploads: ``upload_id, folder, filename, mime, size_bytes, uploaded_at``.

    Files of zero bytes are rows like any other. With ``content`` there is ``text`` too: the
    bytes as UTF-8, null for files over the size limit. ``folder`` names the one folder below
    the root to look into; the others are then not listed. A missing folder is an error.
    """
    spark.dataSource.register(UploadSource)
    reader = spark.read.format(NAME).option("content", str(content).lower())
    files = (reader if folder is None else reader.option("folder", folder)).load(path)
    manifest = [
        F.sha1("path").alias("upload_id"),
        "folder",
        "filename",
        F.lit(None).cast("string").alias("mime"),
        "size_bytes",
        "uploaded_at",
    ]
    return files.select(*manifest, *([F.decode("content", "UTF-8").alias("text")] if content else []))
