"""Jaccard join of shingle sets through an R-tree of count vectors.

Every set is hashed into groups, and the number of its members in each group is a coordinate.
Two sets cannot share more than the sum of the smaller of their coordinates, and nothing under
a tree node can share more with a set than the sum of the minima with the node's largest
coordinates. The tree is packed by sorting: near copies mostly have the same smallest hash, so
they come into the same page. It is joined with itself from the top:

* upper nodes are compared in very fine groups (one hash each). To share the needed number of
  members, a set has to share one of its ``n - need + 1`` rarest ones, with enough members
  behind the first such one on both sides; where the minima over these coordinates sum to
  nothing, or sizes and what is behind do not suffice, two pages are never brought together;
* pages that meet are compared by their largest coordinates, then sets with pages, then sets
  with sets, in coarser groups of one or two members each;
* what survives is compared in full.

Only components are wanted, so a cluster of near copies is first linked like a star, and pairs
inside one component are not looked at again; all pairs between components are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, lean, token_list
from .components import components
from .simhash import _with_end

SHINGLE = 5
PERCENT = 80
SEED = 42

# Sets of a page, and coordinates that its sets may have together.
PAGE_ROWS, PAGE_CELLS = 32, 1 << 13

# Groups whose loads order the hashes from rare to frequent: a table of fixed size.
LOADS = 1 << 20
SLICES = 64

# Members per coordinate that the number of groups aims at, and the fewest groups.
LOAD, LEAST_WIDTH = 2, 16

# Words a task remembers the hashes of, and sets it remembers as met.
KNOWN_WORDS, KNOWN_SETS = 100_000, 500_000

# One odd factor per place of a word, by rule.
PLACES = [np.uint64(xxhash.xxh64_intdigest(str(k), SEED) | 1) for k in range(64)]
SHORT, MIX = (np.uint64(xxhash.xxh64_intdigest(name, SEED) | 1) for name in ("short", "mix"))


class WordHashes(dict):
    """Hash of each word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingles(text: str | None, size: int = SHINGLE, hashes: WordHashes | None = None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending; of all its words if there are fewer."""
    words = token_list(text)
    if not words:
        return np.zeros(0, dtype=np.int64)
    hashes = WordHashes() if hashes is None else hashes
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    wide = min(size, len(h))
    out = np.zeros(len(h) - wide + 1, dtype=np.uint64)
    for k in range(wide):
        out += h[k : len(h) - wide + 1 + k] * PLACES[k]
    if len(h) < size:
        out += np.uint64(int(SHORT) * len(h) % (1 << 64))
    out ^= out >> np.uint64(29)
    out *= MIX
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def needed(a, b, percent: int = PERCENT):
    """The fewest common members at which sets of these sizes reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def width_of(n: int) -> int:
    """Coordinates for a set of ``n`` members: a power of two."""
    return max(LEAST_WIDTH, 1 << max(0, -(-n // LOAD) - 1).bit_length())


def counts_of(sigs: np.ndarray, width: int) -> np.ndarray:
    """Members per group. Halving the width adds up neighbours half the width apart."""
    return np.bincount((sigs.view(np.uint64) >> np.uint64(24)).astype(np.int64) & (width - 1), minlength=width)


def folded(counts: np.ndarray, width: int) -> np.ndarray:
    """Vectors (in rows) of a smaller width."""
    return counts.reshape(len(counts), -1, width).sum(axis=1)


# Slots of the filter that tells which sets have to be made again; a table of fixed size.
SLOTS, SLOT_SLICES = 1 << 24, 16


def _loads(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many members of the task's sets fall into each of ``LOADS`` groups, in slices."""
    total, hashes = np.zeros(LOADS, dtype=np.int64), WordHashes()
    for batch in batches:
        found = [shingles(text.as_py(), size, hashes) for text in batch.column(0)]
        if found:
            total += np.bincount(np.concatenate(found) & (LOADS - 1), minlength=LOADS)
    yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array(list(total.reshape(SLICES, -1)))], ["slice", "part"])


def _in_slices(parts: DataFrame, kind: str, join) -> list:
    """Slices of a table of fixed size, joined over all tasks in two steps."""

    def one(table: pa.Table) -> pa.Table:
        return pa.table({"slice": table.column("slice").slice(0, 1), "part": [join(table.column("part").to_pylist())]})

    # No task joins one slice of every task.
    for key in (F.array("slice", F.pmod(F.xxhash64("part"), F.lit(16)).cast("int")), F.array("slice")):
        parts = parts.groupBy(key).applyInArrow(one, f"slice int, part {kind}")
    return [r.part for r in sorted(parts.collect())]


def group_loads(rows: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Members of all sets per group: ``LOADS`` numbers, whatever the size of the table."""
    parts = rows.select("text").mapInArrow(lean(lambda it: _loads(it, size)), "slice int, part array<long>")
    found = _in_slices(parts, "array<long>", lambda x: np.sum(np.array(x, dtype=np.int64), axis=0).tolist())
    out = np.zeros(LOADS, dtype=np.int64)
    if found:
        out[:] = np.concatenate(found)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _marked(keys: DataFrame) -> np.ndarray:
    """For each slot, whether a key falls into it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, dtype=bool)
        for batch in batches:
            slots[batch.column(0).to_numpy(zero_copy_only=False) & (SLOTS - 1)] = True
        parts = np.packbits(slots).reshape(SLOT_SLICES, -1)
        yield pa.record_batch([pa.array(range(SLOT_SLICES), pa.int32()), pa.array([p.tobytes() for p in parts])], ["slice", "part"])

    def either(parts: list[bytes]) -> bytes:
        return np.bitwise_or.reduce([np.frombuffer(p, dtype=np.uint8) for p in parts]).tobytes()

    found = _in_slices(keys.mapInArrow(lean(made), "slice int, part binary"), "binary", either)
    bits = np.frombuffer(b"".join(map(bytes, found)), dtype=np.uint8)
    return np.unpackbits(bits).astype(bool) if len(bits) else np.zeros(SLOTS, dtype=bool)


def _name(sigs: np.ndarray) -> int:
    """The name of a set: a hash of its members, as a signed number."""
    found = xxhash.xxh64_intdigest(sigs.tobytes(), SEED)
    return found - (1 << 64) if found >> 63 else found


class Met:
    """Sets that a task has met; forgets when it gets long, so a set may come again."""

    def __init__(self) -> None:
        self.names: set[int] = set()

    def first(self, name: int) -> bool:
        if len(self.names) >= KNOWN_SETS:
            self.names.clear()
        before = len(self.names)
        self.names.add(name)
        return len(self.names) > before


_POINT = "node long, n int, key long, width int, low long, counts binary, prefix array<long>"


def _points(batches: Iterator[pa.RecordBatch], loads: np.ndarray, percent: int, size: int) -> Iterator[pa.RecordBatch]:
    """``row, node, n, key`` of every row; the rest too where the set is new and not empty."""
    hashes, met = WordHashes(), Met()
    for batch in batches:
        node, size_of, points = [], [], []
        for text in batch.column(1):
            h = shingles(text.as_py(), size, hashes)
            node.append(_name(h))
            size_of.append(len(h))
            points.append(_point(h, loads, percent) if len(h) and met.first(node[-1]) else (None,) * 4)
        cols = [batch.column(0), pa.array(node, pa.int64()), pa.array(size_of, pa.int32()), batch.column(2)]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        cols += [pa.array(list(c), t) for c, t in zip(zip(*points, strict=True), types, strict=True)] if points else []
        if points:
            yield pa.record_batch(cols, ["row", "node", "n", "key", "width", "low", "counts", "prefix"])


def _point(h: np.ndarray, loads: np.ndarray, percent: int) -> tuple[int, int, bytes, np.ndarray]:
    n, wide = len(h), width_of(len(h))
    c = counts_of(h, wide)
    while c.max() > 255:
        wide *= 2
        c = counts_of(h, wide)
    # A partner of any size shares at least so many: the smallest partner is a subset.
    least = -(-percent * n // 100)
    rare = np.argsort(loads[h & (LOADS - 1)], kind="stable")
    return wide, int(h[0]), c.astype(np.uint8).tobytes(), h[rare[: n - least + 1]]


_COORD = [("sig", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("rest", pa.int32())]
_COORDS = pa.list_(pa.struct(_COORD))
_PAGE = (
    "page long, width int, nodes array<long>, sizes array<int>, counts binary, "
    "coords array<struct<sig: long, low: int, high: int, rest: int>>"
)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points sorted by ``width, low, node`` as pages; equal sets come once.

    A page's fine coordinates tell for each hash the smallest and the largest of the sets that
    have it among their rarest, and the most members that one of them has from it on.
    """
    page = TaskContext.get().partitionId() << 40
    last = None
    held: list[tuple] = []

    def closed() -> pa.RecordBatch:
        nodes, sizes, width, counts, prefix = zip(*held, strict=True)
        lengths = [len(x) for x in prefix]
        sig, size = np.concatenate(prefix), np.repeat(np.array(sizes), lengths)
        rest = size - np.concatenate([np.arange(x) for x in lengths])
        order = np.argsort(sig, kind="stable")
        sig, size, rest = sig[order], size[order], rest[order]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        found = [sig[starts], np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts)]
        found.append(np.maximum.reduceat(rest, starts))
        coords = pa.StructArray.from_arrays(
            [pa.array(x.astype(np.int64 if k == 0 else np.int32)) for k, x in enumerate(found)], [n for n, _ in _COORD]
        )
        one = [[page], [width[0]], [list(nodes)], [list(sizes)], [b"".join(counts)]]
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        cols = [pa.array(x, t) for x, t in zip(one, types, strict=True)]
        cols.append(pa.ListArray.from_arrays(pa.array([0, len(coords)], pa.int32()), coords))
        return pa.record_batch(cols, ["page", "width", "nodes", "sizes", "counts", "coords"])

    for batch in batches:
        node, n, width = (batch.column(k).to_pylist() for k in ("node", "n", "width"))
        for i in range(batch.num_rows):
            if node[i] == last:
                continue
            last = node[i]
            if held and (width[i] != held[0][2] or len(held) >= max(1, min(PAGE_ROWS, PAGE_CELLS // width[i]))):
                yield closed()
                held, page = [], page + 1
            counts, prefix = batch.column("counts")[i].as_py(), batch.column("prefix")[i].values
            held.append((node[i], n[i], width[i], counts, prefix.to_numpy(zero_copy_only=False)))
    if held:
        yield closed()


def _runs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``sig, page, low, high, rest`` sorted by the first two, without sigs of a single page.

    ``hub`` is the sig's first page, ``star`` says whether sets of the two may be similar.
    """
    held, held_hub, held_start = None, None, True
    for batch in _with_end(batches):
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns] if batch is not None else None
        if held is not None:
            cols = held if cols is None else [np.append(x, y) for x, y in zip(held, cols, strict=True)]
        if cols is None or not len(cols[0]):
            continue
        sig = cols[0]
        starts = np.append(held_start, sig[1:] != sig[:-1])
        at = np.maximum.accumulate(np.where(starts, np.arange(len(sig)), 0))
        hub = [c[at] for c in cols[1:]]
        if not held_start:
            run = np.maximum.accumulate(np.where(starts, 1, 0)) == 0
            hub = [np.where(run, x, h) for x, h in zip(held_hub, hub, strict=True)]
        out = ~starts | np.append(sig[1:] == sig[:-1], False)
        page, low, high, rest = cols[1:]
        star = ~starts & (100 * high.astype(np.int64) >= percent * hub[1].astype(np.int64))
        star &= 100 * hub[2].astype(np.int64) >= percent * low.astype(np.int64)
        star &= np.minimum(rest, hub[3]) >= needed(low.astype(np.int64), hub[1].astype(np.int64), percent)
        if batch is not None:
            # The last row waits: whether its sig has another page is not known yet.
            held, held_hub, held_start = [c[-1:] for c in cols], [h[-1] for h in hub], bool(starts[-1])
            out[-1] = False
        found = [c[out] for c in (*cols, hub[0], star)]
        yield pa.record_batch([pa.array(c) for c in found], ["sig", "page", "low", "high", "rest", "hub", "star"])


class Page:
    """A node of the tree with its sets below it."""

    def __init__(self, width: int, nodes: np.ndarray, sizes: np.ndarray, counts: bytes, comps: np.ndarray | None):
        self.width, self.nodes, self.sizes, self.comps = width, nodes, sizes.astype(np.int64), comps
        self.counts = np.frombuffer(counts, dtype=np.uint8).reshape(len(nodes), width).astype(np.int32)

    @classmethod
    def at(cls, batch: pa.RecordBatch, i: int, side: str) -> Page:
        column = lambda c: batch.column(c + side)[i]
        comps = column("comps").values.to_numpy(zero_copy_only=False) if "comps" + side in batch.schema.names else None
        lists = [column(c).values.to_numpy(zero_copy_only=False) for c in ("nodes", "sizes")]
        return cls(column("width").as_py(), *lists, column("counts").as_py(), comps)


def meeting(a: Page, b: Page, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in both pages, and the bound, of the sets that may be similar enough."""
    none = np.zeros(0, dtype=np.int64)
    width = min(a.width, b.width)
    x, y = folded(a.counts, width), folded(b.counts, width)
    top_x, top_y = x.max(axis=0), y.max(axis=0)
    # Page with page, by the smallest sizes; then sets with the other page.
    if np.minimum(top_x, top_y).sum() < needed(a.sizes.min(), b.sizes.min(), percent):
        return none, none, none
    i = np.flatnonzero(np.minimum(x, top_y).sum(axis=1) >= needed(a.sizes, b.sizes.min(), percent))
    j = np.flatnonzero(np.minimum(y, top_x).sum(axis=1) >= needed(b.sizes, a.sizes.min(), percent))
    if not len(i) or not len(j):
        return none, none, none
    bound = np.empty((len(i), len(j)), dtype=np.int64)
    for k, row in enumerate(x[i]):
        bound[k] = np.minimum(row, y[j]).sum(axis=1)
    may = bound >= needed(a.sizes[i][:, None], b.sizes[j][None, :], percent)
    p, q = np.nonzero(may)
    return i[p], j[q], bound[p, q]


def _first_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each set of page 2, the set of page 1 with the highest bound (of its own page, an earlier one)."""
    for batch in batches:
        left, right = [], []
        for k in range(batch.num_rows):
            a, b = Page.at(batch, k, "1"), Page.at(batch, k, "2")
            i, j, bound = meeting(a, b, percent)
            if np.array_equal(a.nodes, b.nodes):
                i, j, bound = i[i < j], j[i < j], bound[i < j]
            order = np.lexsort((i, -bound, j))
            i, j = i[order], j[order]
            first = np.append(True, j[1:] != j[:-1]) if len(j) else np.zeros(0, dtype=bool)
            left.append(a.nodes[i[first]])
            right.append(b.nodes[j[first]])
        yield _links(left, right)


def _other_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """All pairs that may be similar enough and lie in different components."""
    for batch in batches:
        left, right = [], []
        for k in range(batch.num_rows):
            a, b = Page.at(batch, k, "1"), Page.at(batch, k, "2")
            i, j, _ = meeting(a, b, percent)
            keep = a.comps[i] != b.comps[j]
            if np.array_equal(a.nodes, b.nodes):
                keep &= i < j
            left.append(a.nodes[i[keep]])
            right.append(b.nodes[j[keep]])
        yield _links(left, right)


def _links(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    empty = np.zeros(0, dtype=np.int64)
    x, y = (np.concatenate([empty, *z]) for z in (left, right))
    return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _sides(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs ``page1, page2`` with the columns of both pages."""
    for side in ("1", "2"):
        one = pages.select([F.col(c).alias(c + side) for c in pages.columns])
        pairs = pairs.join(one, "page" + side)
    return pairs


def _verified(store: Stored, rows: DataFrame, keys: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough.

    Their sets are made again, from those texts alone whose ``key`` is marked.
    """
    pairs = store.write(pairs.distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    told = rows.sparkSession.sparkContext.broadcast(np.packbits(_marked(keys.join(ends, "node").select("key"))))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, hashes, met = np.unpackbits(told.value), WordHashes(), Met()
        for batch in batches:
            node, sigs = [], []
            for i in np.flatnonzero(marked[batch.column(0).to_numpy(zero_copy_only=False) & (SLOTS - 1)]):
                h = shingles(batch.column(1)[int(i)].as_py(), size, hashes)
                name = _name(h)
                if len(h) and met.first(name):
                    node.append(name)
                    sigs.append(h)
            yield pa.record_batch([pa.array(node, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["node", "sigs"])

    made = rows.select("key", "text").mapInArrow(lean(again), "node long, sigs array<long>")
    whole = store.write(made.dropDuplicates(["node"]))
    both = pairs
    for end, name in (("a", "x"), ("b", "y")):
        both = both.join(whole.select(F.col("node").alias(end), F.col("sigs").alias(name)), end)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = (z.values.to_numpy(zero_copy_only=False) for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike[k] = common >= needed(len(x), len(y), percent)
            yield batch.select(["a", "b"]).filter(pa.array(alike))

    return both.select("a", "b", "x", "y").mapInArrow(lean(compared), "a long, b long")


def near_copies(rows: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``row, n, node, component`` for every row of ``row, text``; ``row`` may be of any type, repeated or null.

    ``n`` is the size of the row's set of shingles, ``node`` names the set, ``component`` the
    chain of sets, each with ``100 * common >= percent * union`` to the next, that it belongs
    to (the name of one of them). Rows without words have the empty set, which is similar to
    none; they share its name. Nulls count as empty texts, repeated rows share their set, an
    empty table gives no rows. Other columns are not read.

    Texts are read four times: for the loads, for the points, and for the sets of surviving
    pairs in both rounds, of which only those are made again. Shuffled are the points once (about a fifth of the hashes), these
    hashes once more to see which pages meet, pages that meet, and the sets of surviving pairs.
    """
    spark = rows.sparkSession
    store = Stored(spark, "rtree")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("row", "text", F.xxhash64("text").alias("key"))
    told = spark.sparkContext.broadcast(group_loads(rows, size))
    kind = rows.schema["row"].dataType.simpleString()
    every = store.write(rows.mapInArrow(lean(lambda it: _points(it, told.value, percent, size)), f"row {kind}, {_POINT}"))
    points = every.filter("width IS NOT NULL")
    keys = points.select("node", "key")
    points = points.select("node", "n", "width", "low", "counts", "prefix")
    packed = points.repartitionByRange(n, "width", "low", "node").sortWithinPartitions("width", "low", "node")
    pages = store.write(packed.mapInArrow(lean(_pages), _PAGE))
    body = pages.drop("coords")

    coords = pages.select("page", F.explode("coords").alias("c")).select("c.sig", "page", "c.low", "c.high", "c.rest")
    coords = coords.repartition(n, "sig").sortWithinPartitions("sig", "page")
    runs = "sig long, page long, low int, high int, rest int, hub long, star boolean"
    shared = store.write(coords.mapInArrow(lean(lambda it: _runs(it, percent)), runs))

    # A star: every page with itself and with the first page that has one of its hashes.
    own = body.select([F.col(c).alias(c + s) for s in "12" for c in body.columns])
    star = _sides(body, shared.filter("star").select(F.col("hub").alias("page1"), F.col("page").alias("page2")).distinct())
    first = own.unionByName(star).mapInArrow(lean(lambda it: _first_links(it, percent)), "a long, b long")
    links = store.write(_verified(store, rows, keys, first, percent, size))
    found = components(links)

    # All pages whose sets are not in one component yet.
    places = body.select("page", F.posexplode("nodes").alias("k", "node")).join(found, "node", "left")
    placed = places.select("page", "k", F.coalesce("component", "node").alias("component"))
    comps = placed.groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct("k", "component"))).getField("component").alias("comps"),
        F.when(F.min("component") == F.max("component"), F.min("component")).alias("only"),
    )
    comps = store.write(comps)
    body = body.join(comps.select("page", "comps"), "page")
    pairs = store.write(_open_pairs(store, shared, comps.select("page", "only"), percent))
    other = _sides(body, pairs).mapInArrow(lean(lambda it: _other_links(it, percent)), "a long, b long")
    more = _verified(store, rows, keys, other, percent, size)
    found = components(links.unionByName(more))
    return every.select("row", "n", "node").join(found, "node", "left").select(
        "row", "n", "node", F.coalesce("component", "node").alias("component")
    )


def _open_pairs(store: Stored, shared: DataFrame, only: DataFrame, percent: int) -> DataFrame:
    """Pairs of pages ``page1 <= page2`` that may hold similar sets and are not in one component as a whole.

    The pages of a hash that lie in its largest component are never paired with each other, so
    a hash that many near copies share costs no more than its other pages times all.
    """
    marked = store.write(shared.select("sig", "page", "low", "high", "rest").join(only, "page"))
    sizes = marked.filter("only IS NOT NULL").groupBy("sig", "only").agg(F.count("*").alias("n"))
    main = sizes.groupBy("sig").agg(F.max_by("only", F.struct("n", "only")).alias("main"))
    rest = store.write(marked.join(main, "sig", "left").filter("only IS NULL OR only <> main").drop("main"))
    x, y = rest.alias("x"), marked.alias("y")
    may = f"""x.sig = y.sig AND x.page <> y.page AND NOT (x.only = y.only) <=> true
        AND 100L * x.high >= {percent}L * y.low AND 100L * y.high >= {percent}L * x.low
        AND {100 + percent}L * least(x.rest, y.rest) >= {percent}L * (x.low + y.low)"""
    met = x.join(y, F.expr(may))
    pairs = met.select(F.least("x.page", "y.page").alias("page1"), F.greatest("x.page", "y.page").alias("page2"))
    mixed = only.filter("only IS NULL").select(F.col("page").alias("page1"), F.col("page").alias("page2"))
    return pairs.distinct().unionByName(mixed)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document.

    ``component_id`` is the smallest id that links lead to, the document's own included. A
    document without words is alone. Rows count one by one: those that repeat an id are rows
    of their own, and a row without an id links others like any other; where no row of a
    component has an id, it is null. Otherwise as ``near_copies``.
    """
    found = near_copies(docs.select(F.col("doc_id").alias("row"), "text"), percent, size)
    named = Stored(docs.sparkSession, "rtree-ids").write(found.withColumnRenamed("row", "doc_id"))
    least = named.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    # Rows of a set meet its component's id by the set, which adaptive execution may split.
    sets = named.filter("n > 0").select("node", "component").distinct().join(least, "component")
    out = named.join(sets.select("node", "least"), "node", "left")
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
