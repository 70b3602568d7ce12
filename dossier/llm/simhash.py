"""SimHash near-duplicates through a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, column_named, lean, numbered, one_per_component, token_list
from .components import components

SHINGLE = 3
MAX_DIFF = 3
SEED = 42

# Children of an index node.
FANOUT = 8
# Pairs of query and node looked at in one step; bounds memory only.
STEP_PAIRS = 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit b is set if it is set in over half the shingles' hashes. No words: 0."""
    w = token_list(text)
    if not w:
        return 0
    parts = w if len(w) >= shingle else [b" ".join(w)]
    if parts is w:
        parts = map(b" ".join, zip(*[w[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, SEED) for p in parts), dtype=np.uint64)
    n, votes = len(h), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        block = np.ascontiguousarray(h[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for every document; the fingerprint as a signed long."""
    rows = column_named(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_fingerprints), f"doc_id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of a code in the Gray order, where neighbours differ in one bit."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits their members share.

    A level groups up to FANOUT neighbours. A node keeps the bits on which all its members
    agree; bits that its parent holds already are taken out. A search adds up the
    differences with the bits on the way down and leaves a whole group as soon as the sum
    exceeds the limit. At the leaves all 64 bits have been counted, so distances are exact.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        pattern = codes[self.order]
        mask = np.full(len(codes), ~np.uint64(0))
        levels = [(mask, pattern)]
        while len(pattern) > 1:
            starts = np.arange(0, len(pattern), FANOUT)
            both = np.bitwise_and.reduceat(pattern, starts)
            either = np.bitwise_or.reduceat(pattern, starts)
            mask = np.bitwise_and.reduceat(mask, starts) & ~(both ^ either)
            pattern = both
            levels.append((mask, pattern))
        self.levels = []
        for k, (mask, pattern) in enumerate(levels):
            above = levels[k + 1][0][np.arange(len(mask)) // FANOUT] if k + 1 < len(levels) else np.uint64(0)
            self.levels.append((mask & ~above, pattern))

    def near(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, code number) within ``limit`` bits."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), dtype=np.int64)
        diff = np.zeros(len(queries), dtype=np.uint8)
        for k in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[k]
            diff = diff + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            keep = diff <= limit
            q, node, diff = q[keep], node[keep], diff[keep]
            if k:
                q, diff = np.repeat(q, FANOUT), np.repeat(diff, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = node < len(self.levels[k - 1][1])
                q, node, diff = q[real], node[real], diff[real]
        return q, self.order[node]


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def _forest(codes: np.ndarray, limit: int) -> np.ndarray:
    """Smallest member number of the group each code belongs to, by links within ``limit``."""
    parent = np.arange(len(codes))
    index = GrayIndex(codes)
    step = max(1, STEP_PAIRS // len(codes))
    for at in range(0, len(codes), step):
        q, c = index.near(codes[at : at + step], limit)
        q = q + at
        while True:
            a, b = _find(parent, q), _find(parent, c)
            apart = a != b
            if not apart.any():
                break
            q, c = q[apart], c[apart]
            np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
    return _find(parent, np.arange(len(codes)))


def _link_groups(batches: Iterator[pa.RecordBatch], limit: int = MAX_DIFF) -> Iterator[pa.RecordBatch]:
    """Rows ``key, fp, id`` sorted by key: links of members to the first of their local group."""
    names = ["a", "b"]
    rest = None
    for batch in _with_end(batches):
        if batch is not None:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if rest is None or not len(rest[0]):
            continue
        key = rest[0]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        if batch is not None:
            done = cut[-1] if len(cut) else 0
        else:
            done = len(key)
        ends = np.append(cut[cut < done], done)
        starts = np.append(0, ends[:-1])
        a, b = [], []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            root = _forest(rest[1][s:e].view(np.uint64), limit)
            ids = rest[2][s:e]
            linked = root != np.arange(e - s)
            a.append(ids[linked])
            b.append(ids[root[linked]])
        rest = [x[done:] for x in rest]
        if a and sum(map(len, a)):
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=names)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _keys() -> list[str]:
    """SQL of the 16 bucket keys: a 16-bit block, then a 12-bit block of the 48 bits left.

    Of four blocks one is free of differences when at most three bits differ; then of the
    four parts of the rest again one is. So every link meets in a bucket, and a bucket holds
    only fingerprints that agree in 28 bits.
    """
    out = []
    for i in range(4):
        block = f"(shiftrightunsigned(fp, {16 * i}) & 65535L)"
        low = f"(fp & {(1 << (16 * i)) - 1}L)" if i else "0L"
        high = f"shiftleft(shiftrightunsigned(fp, {16 * i + 16}), {16 * i})" if i < 3 else "0L"
        for j in range(4):
            part = f"(shiftrightunsigned(({low} | {high}), {12 * j}) & 4095L)"
            out.append(f"({4 * i + j}L * 268435456L + {block} * 4096L + {part})")
    return out


def links(distinct: DataFrame, limit: int = MAX_DIFF) -> DataFrame:
    """Links ``a, b`` between ids whose fingerprints differ in at most ``limit`` bits (3 or fewer).

    ``distinct`` holds ``id, fp``, each fingerprint once. A bucket gives at most one link per
    member, to its local group's first, never all pairs; together the buckets join exactly
    what the pairs would.
    """
    if limit > MAX_DIFF:
        raise ValueError("buckets are made for up to three differing bits")
    keyed = distinct.selectExpr("id", "fp", f"explode(array({', '.join(_keys())})) AS key")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = keyed.select("key", "fp", "id").repartition(n, "key").sortWithinPartitions("key", "id")
    return sorted_rows.mapInArrow(lean(lambda it: _link_groups(it, limit)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` per document.

    Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints are
    one node, so copies are never paired. ``component_id`` is the smallest document id
    reachable; rows with a null id link like any other, and where no row has an id it is null. Repeated rows
    stay. An empty table gives no rows.
    """
    spark = docs.sparkSession
    store = Stored(spark, "simhash")
    rows = store.write(fingerprints(docs))
    nodes = store.write(rows.groupBy("fp").agg(F.min("doc_id").cast("long").alias("id")))
    # A fingerprint is its own number: rows without an id may be what links two others.
    found = components(links(nodes.select("fp", F.col("fp").alias("id"))))
    placed = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = placed.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays, with all its columns.

    Rows count one by one, so a null or repeated id does not matter. That with the smallest
    id stays (null last), then that with the smallest text.
    """
    kept, row = numbered(docs, "simhash")
    found = near_duplicates(kept.select(F.col(row).alias("doc_id"), "text"))
    return one_per_component(kept, row, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")))
