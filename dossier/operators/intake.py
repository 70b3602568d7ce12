"""Upload intake: the first gate a file fails decides its reason and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CLIENT_MESSAGES, GATEWAY_MESSAGES, MAX_FILE_MB, SERVICE_MESSAGES
from ..functions import files
from ..functions.text import has_text

Gate = tuple[str, int | None, Column, Column]


def _service(mb: int) -> tuple[Column, list[Gate]]:
    mime, name, size = F.col("mime"), F.col("filename"), F.col("size_bytes")
    kind = files.file_type_service(mime, name)
    said = SERVICE_MESSAGES
    before, after = said["type"].split("{type}")
    refused = F.concat(F.lit(before), F.coalesce(mime, F.lit("")), F.lit(after))
    return kind, [
        ("type", 415, kind.isNull(), refused),
        ("no_size", 400, size.isNull(), F.lit("The size of the file is unknown.")),
        ("size", 413, ~files.size_ok(size, mb), F.lit(said["size"].format(mb=mb))),
        ("empty", 400, ~files.nonempty(size), F.lit(said["empty"])),
        ("blank_text", 422, ~has_text(F.col("text")), F.lit(said["blank_text"])),
    ]


def _gateway(mb: int) -> tuple[Column, list[Gate]]:
    mime, name, size = F.col("mime"), F.col("filename"), F.col("size_bytes")
    kind = files.file_type_gateway(mime, name)
    said = GATEWAY_MESSAGES
    return kind, [
        ("auth", 401, F.col("user_id").isNull(), F.lit(said["auth"])),
        ("no_file", 400, name.isNull() & size.isNull(), F.lit(said["no_file"])),
        ("type", 400, kind.isNull(), F.lit(said["type"])),
        ("no_size", 400, size.isNull(), F.lit("The size of the file is unknown.")),
        ("size", 400, ~files.size_ok(size, mb), F.lit(said["size"])),
        ("pipeline", 500, ~files.nonempty(size), F.lit(said["pipeline"])),
        ("pipeline", 500, ~has_text(F.col("text")), F.lit(SERVICE_MESSAGES["blank_text"])),
    ]


def _client(mb: int) -> tuple[Column, list[Gate]]:
    mime, name, size = F.col("mime"), F.col("filename"), F.col("size_bytes")
    fits = files.file_ok_client(mime, name)
    kind = F.when(fits, F.coalesce(mime, F.lit("")))
    return kind, [
        ("type", None, kind.isNull(), F.lit(CLIENT_MESSAGES["type"])),
        ("no_size", None, size.isNull(), F.lit("The size of the file is unknown.")),
        ("size", None, ~files.size_ok(size, mb), F.lit(CLIENT_MESSAGES["size"].format(mb=mb))),
    ]


CALLERS = {"service": _service, "gateway": _gateway, "client": _client}


def judge_uploads(uploads: DataFrame, caller: str, mb: int = MAX_FILE_MB) -> DataFrame:
    """Add ``file_type, reason, status, error`` by the rules of one caller.

    All rows are kept; an upload that passes has no reason. No shuffle. ``uploads``
    holds ``mime, filename, size_bytes``, and ``text`` and ``user_id`` where a rule
    of the caller looks at them.
    """
    kind, verdict = _verdict(caller, mb)
    return uploads.withColumn("file_type", kind).withColumns(verdict)


def _verdict(caller: str, mb: int) -> tuple[Column, dict[str, Column]]:
    kind, gates = CALLERS[caller](mb)

    def first(values: list[Column | None]):
        chosen = None
        for (_, _, fails, _), value in zip(gates, values):
            chosen = F.when(fails, value) if chosen is None else chosen.when(fails, value)
        return chosen

    return kind, {
        "reason": first([F.lit(g[0]) for g in gates]),
        "status": first([F.lit(g[1]).cast("int") for g in gates]),
        "error": first([g[3] for g in gates]),
    }


def judge_for_callers(uploads: DataFrame, callers: list[str], keys: list[str], mb: int = MAX_FILE_MB) -> DataFrame:
    """``caller``, keys, ``reason, status, error`` for several callers, in one pass over the uploads."""
    judged = [
        F.struct(F.lit(c).alias("caller"), *[v.alias(n) for n, v in _verdict(c, mb)[1].items()]) for c in callers
    ]
    return uploads.select(*keys, F.explode(F.array(*judged)).alias("v")).select("v.caller", *keys, "v.reason", "v.status", "v.error")


def intake(
    uploads: DataFrame, caller: str = "service", mb: int = MAX_FILE_MB
) -> tuple[DataFrame, DataFrame]:
    """Uploads that pass every gate, and the quarantine with reason, status and error."""
    judged = judge_uploads(uploads, caller, mb)
    passed = judged.filter(F.col("reason").isNull()).drop("reason", "status", "error")
    return passed, judged.filter(F.col("reason").isNotNull())
