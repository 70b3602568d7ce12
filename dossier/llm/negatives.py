"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Rows are dealt into blocks that hold every dimension as a sorted list. An anchor reads the
lists of a block from the end its own sign asks for; each row met is scored at once from its
whole vector in integers, and the values next in line, weighted by the anchor, bound what no
list has shown yet. A block is left when that bound is strictly below the worst score that is
still wanted, so ties are always read to their end. What is wanted carries over from block to
block of a task; tasks' finds meet by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, column_named

# Values of a block, rows of a block, values of the anchors that one job tells its tasks.
BLOCK_CELLS = 1 << 18
BLOCK_ROWS = 4096
TOLD_CELLS = 1 << 19

POSITIVES = 5
NEGATIVES = 3

# Entries read from each list before the bound is looked at; doubled from look to look.
STEP = 16

EXACT = float(1 << 53)
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def whole_components(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, as 64-bit numbers (larger ones are cut to them)."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows of one matrix; shorter ones end in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


class Block:
    """Rows with their numbers, ids, labels and vectors, and a sorted list for each dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.labels = rows, ids, labels
        self.largest = float(np.abs(vectors.astype(float)).max(initial=0))
        self.exact = vectors
        self.near = vectors.astype(float)
        self.order = np.argsort(vectors, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.near.T, self.order, axis=1)

    def __len__(self) -> int:
        return len(self.rows)

    def scores(self, at: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Integer products of the rows ``at`` with a vector, exact, cut to 64 bits."""
        d = min(len(vector), self.near.shape[1])
        if self.largest * float(np.abs(vector.astype(float)).max(initial=0)) * max(d, 1) < EXACT:
            return (self.near[at, :d] @ vector[:d].astype(float)).astype(np.int64)
        told = [int(x) for x in vector[:d]]
        exact = [sum(int(x) * y for x, y in zip(self.exact[i, :d], told, strict=True)) for i in at]
        return np.array([min(max(x, LOW), HIGH) for x in exact], dtype=np.int64)


def sorted_access(block: Block, vector: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Rows newly met, with the bound on every row not met so far.

    The first pair holds no rows, only the bound on the whole block; the last one has the
    bound minus infinity. Bounds beyond 53 bits are raised by what rounding may have lost.
    """
    n, d = len(block), min(len(vector), block.near.shape[1])
    weight = vector[:d].astype(float)
    up, down = np.flatnonzero(weight < 0), np.flatnonzero(weight > 0)

    def bound(depth: int) -> float:
        ends = weight[up] * block.sorted[up, depth], weight[down] * block.sorted[down, n - 1 - depth]
        slack = sum(float(np.abs(x).sum()) for x in ends)
        return float(ends[0].sum() + ends[1].sum()) + (slack * 1e-12 if slack >= EXACT else 0.0)

    met = np.zeros(n, dtype=bool)
    depth, step = 0, STEP
    yield np.zeros(0, dtype=np.int64), bound(0)
    while depth < n:
        end = min(n, depth + step)
        now = np.zeros(n, dtype=bool)
        now[block.order[up, depth:end]] = True
        now[block.order[down, n - end : n - depth]] = True
        if not len(up) and not len(down):
            now[:], end = True, n
        now &= ~met
        met |= now
        done = end == n or met.all()
        yield np.flatnonzero(now), float("-inf") if done else bound(end)
        if done:
            return
        depth, step = end, 2 * step


class Best:
    """The first ``k`` rows by score (high first), id, number."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.id = self.row = np.zeros(0, dtype=np.int64)

    @property
    def worst(self) -> float:
        """The score below which nothing is wanted any more."""
        return float(self.score[-1]) if len(self.score) == self.k else float("-inf")

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(self.score) == self.k:
            take = score >= self.score[-1]
            score, ids, rows = score[take], ids[take], rows[take]
        if not len(score):
            return
        score, ids, rows = np.append(self.score, score), np.append(self.id, ids), np.append(self.row, rows)
        at = np.lexsort((rows, ids, ~score))[: self.k]
        self.score, self.id, self.row = score[at], ids[at], rows[at]


def nearest_of_label(block: Block, row: int, label: int, vector: np.ndarray, best: Best) -> None:
    """Adds the block's rows of the anchor's label, but not the anchor itself."""
    for met, bound in sorted_access(block, vector):
        met = met[(block.labels[met] == label) & (block.rows[met] != row)]
        best.add(block.scores(met, vector), block.ids[met], block.rows[met])
        if bound < best.worst:
            return


def nearest_in_windows(
    block: Block, label: int, vector: np.ndarray, windows: dict[tuple[int, int], Best]
) -> None:
    """Adds the block's rows of other labels to every window of scores ``(lowest, highest)``."""
    for met, bound in sorted_access(block, vector):
        met = met[block.labels[met] != label]
        score = block.scores(met, vector)
        for (low, high), best in windows.items():
            at = (score >= low) & (score <= high)
            best.add(score[at], block.ids[met[at]], block.rows[met[at]])
        if all(bound < max(low, best.worst) for (low, _), best in windows.items()):
            return


# Ids that are null stand behind all others.
NO_ID = np.iinfo(np.int64).max

_BLOCK = "block long, size int, rows array<long>, ids array<long>, labels array<long>, vectors array<long>"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``label, id, vector`` in order, as blocks of bounded size, numbered across the table."""
    count = TaskContext.get().partitionId() << 33
    for batch in batches:
        label, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        start = 0
        while start < len(label):
            wide = np.maximum.accumulate(sizes[start : start + BLOCK_ROWS].astype(np.int64))
            fits = wide * np.arange(1, len(wide) + 1) <= BLOCK_CELLS
            end = start + max(1, int(fits.sum()))
            m = _padded(batch.column(2).slice(start, end - start))
            rows = np.arange(count + start, count + end)
            one = [[count + start], [end - start], [rows], [ids[start:end]], [label[start:end]], [m.ravel()]]
            types = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4]
            names = ["block", "size", "rows", "ids", "labels", "vectors"]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(one, types, strict=True)], names)
            start = end
        count += len(label)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            size = batch.column(1)[i].as_py()
            rows, ids, labels, m = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
            yield Block(rows, ids, labels, m.reshape(size, -1) if len(m) else np.zeros((size, 0), dtype=np.int64))


_ANCHOR = "row long, id long, label long, vector array<long>"


def _anchors_of(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    for block in _blocks_of(batches):
        at = np.flatnonzero((block.ids % every == 0) & (block.ids != NO_ID))
        cols = [block.rows[at], block.ids[at], block.labels[at], list(block.exact[at])]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row", "id", "label", "vector"]
        )


def _written(found: list[tuple[int, int, Best]]) -> pa.RecordBatch:
    """Finds of ``(anchor, positive's score, best)`` as rows."""
    n = [len(b.score) for _, _, b in found]
    join = [np.concatenate([np.zeros(0, np.int64), *[getattr(b, k) for _, _, b in found]]) for k in ("score", "id", "row")]
    keys = [np.repeat(np.array([x[k] for x in found], dtype=np.int64), n) for k in (0, 1)]
    return pa.record_batch([pa.array(x) for x in [*keys, *join]], ["anchor", "against", "score", "id", "row"])


_FOUND = "anchor long, against long, score long, id long, row long"


def mine(
    rows: DataFrame,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
    every: int = 50,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. A row's score is the integer
    product of its ``floor(scale * x)`` with the anchor's. An anchor's positives are its first
    ``positives`` other rows of its label; for each, the first ``negatives`` rows of other
    labels with ``low * p <= 100 * n <= high * p`` are returned, ranked from 1. Higher scores
    come first, then smaller ids, then the order of the rows.

    Rows with a null label, a null vector or a null or non-finite component take no part. A row
    without an id is never an anchor and comes last among ties. Rows that repeat an id are rows
    of their own: as anchors each is answered, as candidates each may be listed. Vectors of
    unequal length are compared as if the shorter one ended in zeros; an empty one scores 0.
    Scores beyond 64 bits are cut to them. An empty table, or one without anchors, gives no
    rows. Other columns are not read, so their names cannot clash.

    Blocks are written once. Anchors go out in broadcasts of at most about ``TOLD_CELLS``
    values, each job reading all blocks where they lie; per task and anchor only the best
    few finds are shuffled.
    """
    spark = rows.sparkSession
    store = Stored(spark, "negatives")
    given = column_named(rows, id_column, label_column, vector_column)
    given = given.toDF("id", "label", "v").filter(F.col("label").isNotNull() & usable(F.col("v")))
    given = given.select(
        F.col("label").cast("long").alias("label"),
        F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"),
        whole_components(F.col("v"), scale).alias("v"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("v")
    ordered = given.repartitionByRange(n, "label", "id", spread).sortWithinPartitions("label", "id", spread)
    blocks = store.write(ordered.mapInArrow(_to_blocks, _BLOCK))
    anchors = store.write(blocks.mapInArrow(lambda it: _anchors_of(it, every), _ANCHOR))
    total, widest = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    jobs = -(-total * max(widest or 1, 1) // TOLD_CELLS)
    parts = [
        _answers(store, blocks, anchors.filter(F.pmod(F.xxhash64("row"), F.lit(jobs)) == k), low, high, positives, negatives)
        for k in range(jobs)
    ]
    empty = spark.createDataFrame(
        [],
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
    )
    for part in parts:
        empty = empty.unionByName(part)
    id_type = rows.schema[id_column].dataType
    if isinstance(id_type, T.IntegralType):
        for name in ("anchor_id", "positive_id", "negative_id"):
            empty = empty.withColumn(name, F.col(name).cast(id_type))
    return empty


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` finds per key out of the few that every task has left."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _answers(
    store: Stored, blocks: DataFrame, anchors: DataFrame, low: int, high: int, positives: int, negatives: int
) -> DataFrame:
    """The answers for one broadcast of anchors."""
    sc = blocks.sparkSession.sparkContext
    asked = [(r.row, r.label, np.array(r.vector, dtype=np.int64)) for r in anchors.collect()]
    told = sc.broadcast(asked)

    def search_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(positives) for _ in told.value]
        for block in _blocks_of(batches):
            there = set(np.unique(block.labels).tolist())
            for (row, label, vector), found in zip(told.value, best, strict=True):
                if label in there:
                    nearest_of_label(block, row, label, vector, found)
        yield _written([(row, 0, b) for (row, _, _), b in zip(told.value, best, strict=True)])

    chosen = store.write(_first(blocks.mapInArrow(search_positives, _FOUND), ["anchor"], positives))
    limits: dict[int, dict[int, tuple[int, int]]] = {}
    for r in chosen.select("anchor", "score").distinct().collect():
        # Smallest and largest whole n with low * p <= 100 * n <= high * p.
        bounds = -(-low * r.score // 100), high * r.score // 100
        if bounds[0] <= bounds[1]:
            limits.setdefault(r.anchor, {})[r.score] = bounds
    wanted = sc.broadcast(limits)

    def search_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [x for x in told.value if x[0] in wanted.value]
        windows = [{w: Best(negatives) for w in wanted.value[row].values()} for row, _, _ in asked]
        for block in _blocks_of(batches):
            there = np.unique(block.labels)
            for (_, label, vector), found in zip(asked, windows, strict=True):
                if len(there) > 1 or there[0] != label:
                    nearest_in_windows(block, label, vector, found)
        yield _written(
            [
                (row, score, found[w])
                for (row, _, _), found in zip(asked, windows, strict=True)
                for score, w in wanted.value[row].items()
            ]
        )

    best = _first(blocks.mapInArrow(search_negatives, _FOUND), ["anchor", "against"], negatives)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    pos = chosen.select("anchor", F.col("score").alias("against"), known("id").alias("positive_id"))
    neg = best.select("anchor", "against", "rank", known("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pos.join(neg, ["anchor", "against"]).join(anchors.select(F.col("row").alias("anchor"), "id"), "anchor")
    return store.write(
        out.select(
            F.col("id").alias("anchor_id"),
            "positive_id",
            "rank",
            "negative_id",
            F.col("against").alias("positive_score"),
            "negative_score",
        )
    )
