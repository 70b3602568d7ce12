"""SpotSigs fingerprints.

A spot begins at a common word and takes the content words that follow it; its signature is
the chain of both. A fingerprint is the set of a text's signatures. Two fingerprints are
compared by Jaccard, and only sets of similar length can be similar.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, Stored, column_named

# Common words that anchor spots (English, German, French, Spanish).
COMMON = (
    "a an the and or of to in on at is are was be been by for from it that this with as not "
    "der die das den dem des ein eine und oder von zu im ist sind war mit auf nicht sich für "
    "le la les un une et ou de du en est sont par pour que qui dans sur pas avec au aux "
    "el los las uno y o del es son por para con no se su lo"
)
ANCHORS = frozenset(w.encode() for w in COMMON.split())

# Content words of a chain.
CHAIN = 2
SIMILAR = 0.8


def signatures(text: str | bytes | None, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct signatures (32 bits) of a text.

    A text with words but without a full spot has one signature of all its words; a text
    without words has none.
    """
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    w = raw.translate(WORD_BYTES).split()
    spots, content = [], []
    for x in w:
        if x in ANCHORS:
            spots.append((x, len(content)))
        else:
            content.append(x)
    pairs = list(map(b" ".join, zip(*[content[i:] for i in range(chain)], strict=False)))
    last, digest = len(pairs), xxhash.xxh32_intdigest
    found = {x + b" " + pairs[k] for x, k in spots if k < last}
    if not found and w:
        found = {b" ".join(w)}
    return np.unique(np.fromiter(map(digest, found), dtype=np.uint32, count=len(found)))


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 as soon as it cannot reach ``floor``. Two empty sets: 1."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 1.0
    if len(small) < floor * len(large):
        return 0.0
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    share = both / (len(a) + len(b) - both)
    return share if share >= floor else 0.0


def as_text(sigs: np.ndarray) -> str:
    """A fingerprint as text: signatures of eight hexadecimal digits in ascending order."""
    return sigs.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many first characters of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_OUT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows in order, each with its bucket, id, text and whether it only ends its bucket."""
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _compare(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *[f.split()[0] for f in _OUT.split(", ")]]
    types = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    out: list[tuple] = []
    before = None
    for bucket, doc_id, text, extra in _neighbours(batches):
        text = text or ""
        sigs = signatures(text)
        if before is not None and before[0] == bucket:
            _, own_id, own, own_sigs = before
            new = edited(own, text)
            new_sigs = signatures(new)
            digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            near = (likeness(own_sigs, new_sigs), likeness(own_sigs, sigs))
            out.append((own_id, len(own), digest, as_text(own_sigs), as_text(new_sigs), *near))
        before = None if extra else (bucket, doc_id, text, sigs)
        if len(out) >= 500:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint and that of its edited text, compared with each other.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text borrows from the next document in descending order of
    ``doc_id``; after the last comes the first. Rows that repeat an id are ordered by text;
    rows without an id come last. A null text counts as empty; two empty fingerprints are
    alike. A table of one row is its own next; an empty table gives no rows.

    Ids are cut into buckets at quantiles, so a text is shuffled once. The first row of each
    bucket is also sent to the bucket before it, whose last row needs it: no window over the
    whole table, and no text through the driver.
    """
    spark = docs.sparkSession
    rows = column_named(docs, "doc_id", "text").withColumn("key", -F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))))
    if buckets is None:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = ", ".join(str(k / buckets) for k in range(1, buckets))
    cuts = rows.agg(F.expr(f"percentile_approx(key, array({share}), 100000)").alias("c")).first().c if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    rows = rows.withColumn("bucket", _bucket("key", cuts))
    heads = rows.groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()
    if not heads:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_OUT}")
    # By bucket number: the key that begins it, and the bucket before it (the last one for the first).
    first, back = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for k, h in enumerate(heads):
        first[h.bucket], back[h.bucket] = h.key, heads[k - 1].bucket

    def entry(values: list, kind: str):
        array = ", ".join("NULL" if v is None else str(v) for v in values)
        return F.expr(f"element_at(cast(array({array}) as array<{kind}>), bucket + 1)")

    places = F.array(
        F.struct(F.col("bucket"), F.lit(False).alias("extra")),
        F.when(
            entry(first, "bigint") == F.col("key"),
            F.struct(entry(back, "int").alias("bucket"), F.lit(True).alias("extra")),
        ),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        rows.select("doc_id", "text", "key", F.explode(F.array_compact(places)).alias("p"))
        .select("p.bucket", "doc_id", "text", "p.extra", "key")
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket", "extra", "key", "text")
        .select("bucket", "doc_id", "text", "extra")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return dealt.mapInArrow(lambda it: _compare(it, id_type), f"doc_id {kind}, {_OUT}")


def _bucket(key: str, cuts: list[int]):
    """How many cuts are smaller than the key, by bisection over a constant array."""
    if not cuts:
        return F.lit(0)
    array = f"array({', '.join(f'{c}L' for c in cuts)})"
    mid = "cast((s.lo + s.hi) / 2 as int)"
    return F.expr(
        f"aggregate(sequence(1, {len(cuts).bit_length()}), named_struct('lo', 0, 'hi', {len(cuts)}), "
        f"(s, i) -> CASE WHEN s.lo >= s.hi THEN s WHEN element_at({array}, {mid} + 1) < {key} "
        f"THEN named_struct('lo', {mid} + 1, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', {mid}) END, "
        "s -> s.lo)"
    )


def similar(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``a, b, share``: representatives of equal fingerprints whose Jaccard reaches the threshold.

    Signatures are ordered from rare to frequent over all documents; sets whose Jaccard
    reaches ``t`` share one of their first ``size - ceil(t*size) + 1``. Candidates meet by
    length bucket and such a signature, and are compared in full. Equal fingerprints are one
    representative (smallest id), so copies are not paired. Fingerprints are told apart by a
    row number; one whose rows all have a null id is paired with null as its id.
    """
    spark = docs.sparkSession
    store = Stored(spark, "spots")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(t.as_py()).astype(np.int64).tolist() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "sigs"])

    rows = column_named(docs, "doc_id", "text").mapInArrow(sets, "doc_id long, sigs array<long>")
    distinct = rows.groupBy("sigs").agg(F.min("doc_id").alias("id")).filter("size(sigs) > 0")
    distinct = store.write(distinct.withColumn("doc_id", F.monotonically_increasing_id()))
    long = store.write(distinct.select("doc_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig")))
    ranked = long.join(long.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    ordered = ranked.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    prefix = F.explode(F.slice("s", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1)).alias("p")
    keys = store.write(ordered.select("doc_id", "n", prefix).select("doc_id", "n", "p.sig"))
    step = -math.log(threshold)
    own = F.floor(F.log("n") / step).cast("int")
    reach = F.sequence(own, F.greatest(own, F.floor(F.log(F.col("n") / threshold) / step + 1e-9).cast("int")))
    left = keys.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(reach).alias("bucket"))
    right = keys.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "sig", own.alias("bucket"))
    near = left.join(right, ["bucket", "sig"]).filter(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("na") >= F.col("nb") * threshold)
    )
    pairs = near.select("a", "b").distinct()
    both = pairs.join(distinct.withColumnsRenamed({"doc_id": "a", "sigs": "x", "id": "ia"}), "a").join(
        distinct.withColumnsRenamed({"doc_id": "b", "sigs": "y", "id": "ib"}), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    share = common / (F.size("x") + F.size("y") - common)
    # The smaller set comes first, of equal ones that with the smaller id.
    swap = (F.size("x") == F.size("y")) & F.coalesce(F.col("ia") > F.col("ib"), F.lit(False))
    a, b = F.when(swap, F.col("ib")).otherwise(F.col("ia")), F.when(swap, F.col("ia")).otherwise(F.col("ib"))
    return both.select(a.alias("a"), b.alias("b"), share.alias("share")).filter(F.col("share") >= threshold)
