"""Removal of repeated passages with a distributed suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier. Suffixes of
all bytes would be sorted in vain where nothing repeats, so the texts are first written over
a larger alphabet: every window of LENGTH bytes holds an anchor, the least hash of its
SEED-byte strings, and equal windows have equal anchors. A text becomes the string of its
anchors and their distances. Anchors that occur once end no repeat and are left out.

The suffixes of these strings are sorted by the difference cover method: triples at the
positions not divisible by three are sorted and named, the names form shorter strings that
are sorted in the same way, and the other suffixes are merged in by their first symbols and
the ranks behind them. Neighbours in the suffix array whose prefixes agree over the bytes
that a window may touch are one passage; all but its first place are repeats. Windows over
the edges of such passages are compared at the end, anchor by anchor with the bytes around it.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, column_named, free_name

LENGTH = 100
SEED = 51
WINDOW = LENGTH - SEED + 1  # strings of SEED bytes in a window; anchors are less than this apart

# Texts are hashed in parts of this many bytes; bounds memory, not results.
PART = 1 << 20
# Bytes of short texts that are hashed together, and pairs a task gathers before it deals them;
# they bound memory, not results.
TOGETHER = 1 << 15
GATHERED = 1 << 20
# Buckets of anchor hashes per shuffle partition, at most, and pairs that a dealt row holds on average.
BUCKETS = 8
FILLED = 64
# Bytes that the windows of one anchor cover.
AROUND = LENGTH + WINDOW - 1
# Most different surroundings of one anchor hash that a task holds; bounds memory, not results.
HELD = 1 << 12
# Symbols of a prefix that the suffix array tells apart. In text of very short periods a window
# holds more anchors; such windows are compared exactly like those at edges.
DEPTH = 27
GAP = -1  # stands for anchors that occur once
END = -2  # what follows a string

_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_B, _INV):
            row = np.full(PART + 4 * LENGTH, base, dtype=np.uint64)
            row[0] = 1
            _POWERS.append(np.cumprod(row))
    return _POWERS


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _string_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each position on."""
    up, down = _powers()
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    terms = values + np.uint64(1)
    terms *= up[: len(values)]
    np.cumsum(terms, out=sums[1:])
    h = sums[size:] - sums[:-size]
    h *= down[: len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least_places(h: np.ndarray) -> np.ndarray:
    """For each window the place of its least hash, the first of equals."""
    least = h & np.uint64(0xFFFFFFFFFF000000)
    least |= np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - span)], least[WINDOW - span :])
    least &= np.uint64(0xFFFFFF)
    return least.view(np.int64)


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first window it is the anchor of.

    A window's anchor is its SEED-byte string with the least hash, the first of equals.
    Windows of one anchor are neighbours.
    """
    hashes, places, firsts = [], [], []
    for at in range(0, len(raw) - LENGTH + 1, PART):
        h = _string_hashes(raw[at : at + PART + LENGTH - 1].astype(np.uint64), SEED)
        place = _least_places(h)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        hashes.append(h[place[first]])
        places.append(place[first] + at)
        firsts.append(first + at)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h, p, f = map(np.concatenate, (hashes, places, firsts))
    keep = np.append(True, p[1:] != p[:-1])
    return h[keep], p[keep], f[keep]


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`anchors` finds in each text, one after the other, and how many each has.

    Short texts are hashed as one string; windows over two of them are left out.
    """
    none = np.zeros(0, dtype=np.int64)
    found, counts = [(none.view(np.uint64), none, none)], [none]
    for block in _together(texts):
        if len(block) == 1:
            found.append(anchors(np.frombuffer(block[0], dtype=np.uint8)))
            counts.append(np.array([len(found[-1][0])]))
            continue
        size = np.fromiter(map(len, block), dtype=np.int64, count=len(block))
        end = np.cumsum(size)
        if end[-1] < LENGTH:
            counts.append(np.zeros(len(block), dtype=np.int64))
            continue
        h = _string_hashes(np.frombuffer(b"".join(block), dtype=np.uint8).astype(np.uint64), SEED)
        place = _least_places(h)
        first = np.flatnonzero((np.repeat(end, size) - np.arange(end[-1]) >= LENGTH)[: len(place)])
        place = place[first]
        new = np.append(True, place[1:] != place[:-1])[: len(place)]
        place, first = place[new], first[new]
        owner = np.searchsorted(end, first, side="right")
        begin = (end - size)[owner]
        found.append((h[place], place - begin, first - begin))
        counts.append(np.bincount(owner, minlength=len(block)))
    h, p, f = map(np.concatenate, zip(*found, strict=True))
    return h, p, f, np.concatenate(counts)


def _together(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, in blocks of up to TOGETHER bytes; a longer text is a block of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > TOGETHER:
            yield texts[start:k]
            start, size = k, 0
        size += len(text)
    if texts:
        yield texts[start:]


def _blobs(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """The numbers that stand one after the other as bytes, ``count`` of them in each."""
    ends = pa.array(np.append(0, np.cumsum(count)) * values.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(count), [None, ends.buffers()[1], pa.py_buffer(values.tobytes())])


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _among(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which values are in the pool; both are short, so one small sort is all it takes."""
    if not len(pool):
        return np.zeros(len(values), dtype=bool)
    pool = np.sort(pool)
    return pool[np.minimum(np.searchsorted(pool, values), len(pool) - 1)] == values


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The numbers of each list of a column; none for null."""
    ends = np.cumsum(_sizes(column))
    return np.split(column.flatten().to_numpy(), ends[:-1]) if len(ends) else []


_PARSED = "row long, doc long, n long, digest binary, hashes binary, places binary, firsts binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _PARSED.split(", ")]
    for batch in batches:
        texts = [_bytes_of(t) for t in batch.column(2).to_pylist()]
        h, p, f, count = anchors_of(texts)
        # Places are kept as distances, which are less than LENGTH.
        far = np.diff(p, prepend=0)
        begin = (np.cumsum(count) - count)[count > 0]
        far[begin] = p[begin]
        digest = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        made = [pa.array(list(map(len, texts)), pa.int64()), pa.array(digest, pa.binary()), _blobs(h.astype("<u8"), count)]
        made += [_blobs(far.astype("<u1"), count), _blobs((p - f).astype("<u1"), count)]
        yield pa.record_batch([batch.column(0), batch.column(1), *made], names)


class Parsed:
    """Anchors of one row: places, and the windows of each."""

    def __init__(self, n: int, places: bytes, firsts: bytes):
        self.place = np.cumsum(np.frombuffer(places, dtype="<u1").astype(np.int64))
        self.first = self.place - np.frombuffer(firsts, dtype="<u1")
        # Windows of an anchor end where those of the next begin.
        self.last = np.append(self.first[1:] - 1, n - LENGTH) if len(self.place) else self.first


def _emit_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each anchor hash once per text, and a second time if it occurs there again."""
    for batch in batches:
        for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield _once_or_twice(np.frombuffer(raw.as_buffer(), dtype="<u8"), row)


def _once_or_twice(hashes: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(hashes).view(np.int64)
    h = h[np.append([True, True], h[2:] != h[:-2])[: len(h)]]
    return h, np.full(len(h), row)


_DEALT = "bucket int, h binary, row binary"


def _dealt(found: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs of hash and row, those of one bucket of hashes together as bytes."""
    held: list[tuple] = []
    size = 0
    for pair in itertools.chain(found, [None]):
        if pair is not None:
            held.append(pair)
            size += len(pair[0])
        if size and (pair is None or size >= GATHERED):
            h, row = map(np.concatenate, zip(*held, strict=True))
            held, size = [], 0
            bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket)
            bucket = bucket[by]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            count = np.diff(np.append(starts, len(bucket)))
            yield pa.record_batch([pa.array(bucket[starts]), _blobs(h[by], count), _blobs(row[by], count)], ["bucket", "h", "row"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs sorted by bucket those whose h comes more than once, each pair once."""
    rows = (x for batch in batches for x in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for _, group in itertools.groupby(rows, lambda x: x[0]):
        _, *blobs = zip(*group, strict=True)
        h, row = (np.frombuffer(b"".join(x), dtype=np.int64) for x in blobs)
        by = np.argsort(h)
        h, row = h[by], row[by]
        same = h[1:] == h[:-1]
        twice = np.append(same, False) | np.append(False, same)
        h, row = h[twice], row[twice]
        by = np.lexsort((h, row))
        h, row = h[by], row[by]
        new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
        yield pa.record_batch([pa.array(h[new]), pa.array(row[new])], ["h", "row"])


def _buckets(source: DataFrame, pairs: int) -> int:
    """How many buckets the pairs found in a stored table go to.

    A task sends a row to each bucket, so rows would grow with the product of tasks and
    partitions, that is, with the square of the input where both follow it. There are only so many
    buckets that a row still holds some pairs; rows then grow as the pairs do.
    """
    partitions = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(partitions, source.rdd.getNumPartitions())
    return max(1, min(BUCKETS * partitions, GATHERED // FILLED, pairs // (FILLED * tasks)))


def _recurring(rows: DataFrame, pairs: Callable, name: str, buckets: int) -> DataFrame:
    """For each row its hashes, among the ``pairs`` found in ``rows``, that come more than once over all."""
    dealt = rows.mapInArrow(lambda it: _dealt(pairs(it), buckets), _DEALT)
    again = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "h long, row long")
    return again.groupBy("row").agg(F.collect_list("h").alias(name))


_LIVE = (
    "row long, doc long, n long, places binary, firsts binary, repeated binary, hashes binary, suffix binary, "
    "symbols array<long>, need array<long>, digest array<long>"
)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its string of symbols, and for each suffix how much of it its windows need.

    ``digest`` stands for the needed prefix; 0 where no window asks for this suffix or the
    string of repeated anchors ends too early. ``suffix`` gives for each anchor the suffix
    that covers its windows, -1 if none does. Hashes are kept of repeated anchors only.
    """
    names = [f.split()[0] for f in _LIVE.split(", ")]
    types = [*[pa.binary()] * 4, *[pa.list_(pa.int64())] * 3]
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        firsts = []
        known = (x.view(np.uint64) for x in _lists(batch.column(6)))
        for n, h, p, f, again in zip(*[batch.column(i).to_pylist() for i in range(2, 6)], known, strict=True):
            hashes = np.frombuffer(h, dtype="<u8")
            repeated = _among(hashes, again)
            symbols, need, digest, suffix = _string_of(Parsed(n, p, f), hashes, repeated)
            firsts.append(f)
            blobs = (p, repeated.tobytes(), hashes[repeated].tobytes(), suffix.astype("<i4").tobytes())
            for c, v in zip(out, (*blobs, symbols, need, digest), strict=True):
                c.append(v)
        made = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
        head = [batch.column(i) for i in range(3)]
        yield pa.record_batch([*head, made[0], pa.array(firsts, pa.binary()), *made[1:]], names)


def _string_of(t: Parsed, hashes: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, needs and digests of a string, and the suffix for each anchor."""
    far = np.append(np.diff(t.place), 0).astype(np.uint64)
    symbol = (_mix(hashes + far * _B) >> np.uint64(1)).view(np.int64)
    # A run of unrepeated anchors becomes one gap.
    kept = rep | np.append(True, rep[:-1])
    where = np.where(rep, np.cumsum(kept) - 1, -1)
    symbols = np.where(rep, symbol, GAP)[kept]
    size = len(symbols)
    need = np.zeros(size, dtype=np.int64)
    digest = np.zeros(size, dtype=np.int64)
    suffix = np.full(len(rep), -1, dtype=np.int64)
    u = np.flatnonzero(rep)
    if len(u):
        run = np.cumsum(~rep)  # the same within a run of repeated anchors
        # The suffix that begins at or before the anchor's first window, and the anchor that ends behind its last.
        p = np.searchsorted(t.place, t.first[u], side="right") - 1
        v = np.searchsorted(t.place + SEED, t.last[u] + LENGTH)
        inside = (p >= 0) & (v < len(rep))
        p, v = np.where(inside, p, u), np.where(inside, v, u)
        inside &= rep[p] & rep[v] & (run[p] == run[v]) & (v - p < DEPTH)
        u, p, v = u[inside], p[inside], v[inside]
        suffix[u] = where[p]
        np.maximum.at(need, where[p], where[v] - where[p] + 1)
        up, down = _powers() if size < PART else _long_powers(size)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(symbols.view(np.uint64) * up[:size])))
        at = np.flatnonzero(need)
        digest[at] = (_mix((sums[at + need[at]] - sums[at]) * down[at]) ^ need[at].astype(np.uint64)).view(np.int64) | 1
    return symbols, need, digest, suffix


def _long_powers(size: int) -> list[np.ndarray]:
    rows = [np.full(size + 1, base, dtype=np.uint64) for base in (_B, _INV)]
    for r in rows:
        r[0] = 1
    return [np.cumprod(r) for r in rows]


def ordered(
    store: Stored,
    rows: DataFrame,
    keys: list[str],
    ties: list[str],
    keep: list[str],
    count: str = "false",
    names: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` of all rows, with their places in the order of keys and ties.

    ``pos``: global place from 0. ``before``: rows before it for which ``count`` holds.
    ``name``: how often the keys (or the columns ``names``) have changed up to it, from 1. Rows
    are dealt by ranges of keys and ties, so a very frequent key is spread over tasks. Each
    partition closes with a summary row; these alone come to the driver.
    """
    rows = rows.withColumn("counted", F.expr(count))
    columns = rows.columns
    by = [columns.index(c) for c in names or keys]
    at_counted, kept = columns.index("counted"), [columns.index(c) for c in keep]
    out_names = [*keep, "part", "pos", "before", "name", "summary"]
    nothing = pa.list_(pa.int64())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None
        pos = before = name = 0
        types: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in by]
            head = [int(c[0]) for c in cols]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last != head
            named = name + np.cumsum(new)
            held = batch.column(at_counted).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = before + np.cumsum(held) - held
            places = pos + np.arange(batch.num_rows)
            first, last = first or head, [int(c[-1]) for c in cols]
            pos, before, name = pos + batch.num_rows, int(counts[-1] + held[-1]), int(named[-1])
            types = [batch.column(i).type for i in kept]
            add = [pa.array(np.full(batch.num_rows, part, dtype=np.int32)), *map(pa.array, (places, counts, named))]
            yield pa.record_batch([*[batch.column(i) for i in kept], *add, pa.nulls(batch.num_rows, nothing)], out_names)
        if last is not None:
            summary = pa.array([[pos, before, name, *first, *last]], nothing)
            none = [pa.nulls(1, t) for t in [*types, *[pa.int64()] * 3]]
            yield pa.record_batch([*none[: len(kept)], pa.array([part], pa.int32()), *none[len(kept) :], summary], out_names)

    # The table is written once, so equal keys may stand in any order inside a partition.
    dealt = rows.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    local = store.write(
        dealt.mapInArrow(number, f"{schema}, part int, pos long, before long, name long, summary array<long>")
    )
    parts = {r.part: r.summary for r in local.filter("summary IS NOT NULL").select("part", "summary").collect()}
    offsets = [(0, 0, 0)] * (max(parts, default=0) + 1)
    pos = before = name = 0
    last = None
    for part in sorted(parts):
        size, held, changes, *ends = parts[part]
        # A key that goes on from the partition before keeps its name.
        name -= last == ends[: len(by)]
        offsets[part] = (pos, before, name)
        pos, before, name, last = pos + size, before + held, name + changes, ends[len(by) :]

    def shifted(column: str, i: int) -> Column:
        offset = F.expr(f"element_at(array({','.join(f'{o[i]}L' for o in offsets)}), part + 1)")
        return (F.col(column) + offset).alias(column)

    out = local.filter("summary IS NULL").select(*keep, shifted("pos", 0), shifted("before", 1), shifted("name", 2))
    out.stored_at, out.n_rows, out.n_names = local.stored_at, pos, name
    return out


class Places:
    """Every position of the strings of a batch, and what stands behind it."""

    def __init__(self, rows: pa.Array, symbols: pa.Array, ranks: pa.Array | None = None):
        size = _sizes(symbols)
        self.symbols = symbols.flatten().to_numpy()
        self.row = np.repeat(rows.to_numpy(), size)
        self.i = np.arange(len(self.symbols)) - np.repeat(np.cumsum(size) - size, size)
        self.left = np.repeat(size, size) - self.i
        self.rank = np.zeros(len(self.i), dtype=np.int64)
        if ranks is not None:
            # Ranks of sampled positions: first those after a multiple of three, then the others.
            known = _sizes(ranks)
            at = np.repeat(np.cumsum(known) - known, size) + self.i // 3
            at += np.where(self.i % 3 == 2, np.repeat((size + 1) // 3, size), 0)
            sampled = self.i % 3 != 0
            self.rank[sampled] = ranks.flatten().to_numpy()[at[sampled]]

    def ahead(self, values: np.ndarray, step: int, end: int) -> np.ndarray:
        """The values ``step`` positions further on, ``end`` past the end of the string."""
        out = np.full(len(values), end, dtype=np.int64)
        inside = np.flatnonzero(self.left > step)
        out[inside] = values[inside + step]
        return out

    def batch(self, take: np.ndarray, **keys: np.ndarray) -> pa.RecordBatch:
        columns = {"row": self.row, "i": self.i.astype(np.int32), **keys}
        return pa.record_batch([pa.array(c[take]) for c in columns.values()], list(columns))


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _triples(every: bool) -> Callable:
    """Three symbols from each position on, or from those not divisible by three."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = Places(*batch.columns)
            s = p.symbols
            yield p.batch((p.i % 3 != 0) | every, a=s, b=p.ahead(s, 1, END), c=p.ahead(s, 2, END))

    return make


def _halves(left_out: int) -> Callable:
    """Positions but those with one remainder, with the keys that order them, and known ranks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = Places(*batch.columns)
            s = p.symbols
            keys = {"a": s, "r1": p.ahead(p.rank, 1, -1)} if left_out == 2 else {"a": s, "b": p.ahead(s, 1, END), "r2": p.ahead(p.rank, 2, -1)}
            yield p.batch(p.i % 3 != left_out, **keys, r=p.rank)

    return make


def _per_string(rows: DataFrame, value: str, sampled: bool = False, gap: bool = False) -> DataFrame:
    """One array of values per string, in the order of positions ``i``; values of one place are added.

    ``sampled`` puts positions after a multiple of three first, and ``gap`` a 0 behind these.
    A string is as long as its text at most; a task holds one string and one batch.
    """

    def close(pieces: list[list[np.ndarray]]) -> pa.RecordBatch:
        row, i, v = (np.concatenate(c) for c in zip(*pieces, strict=True))
        place = np.where(i % 3 == 1, 0, 1 << 32) + i if sampled else i
        by = np.lexsort((place, row))
        row, i, v = row[by], i[by], v[by]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (i[1:] != i[:-1])))
        row, i, v = row[new], i[new], np.add.reduceat(v, new)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        names, ends = row[starts], np.append(starts[1:], len(row))
        if gap:
            v = np.insert(v, starts + np.add.reduceat((i % 3 == 1).astype(np.int64), starts), 0)
            ends = ends + np.arange(1, len(ends) + 1)
        offsets = pa.array(np.append(0, ends).astype(np.int32))
        return pa.record_batch([pa.array(names), pa.ListArray.from_arrays(offsets, pa.array(v))], ["row", value])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                cols = [c.to_numpy() for c in batch.columns]
                # Strings before the last one of the batch are complete.
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                if cut:
                    yield close([*held, [c[:cut] for c in cols]])
                    held = []
                held.append([c[cut:] for c in cols])
        if held:
            yield close(held)

    dealt = rows.select("row", "i", value).repartition("row").sortWithinPartitions("row")
    return dealt.mapInArrow(pack, f"row long, {value} array<long>")


def suffix_ranks(store: Stored, strings: DataFrame, depth: int) -> DataFrame:
    """``row, rank``: for every position of every string the rank of its suffix among all.

    ``strings`` holds ``row, symbols``. Ranks are all different; suffixes that agree in their
    first ``depth`` symbols may stand in any order. Strings are compared as if each ended in a
    symbol less than all others.
    """
    triple = "row long, i int, a long, b long, c long"
    strings = strings.select("row", "symbols").filter("size(symbols) > 0")
    if depth <= 3:
        # Three symbols are all that counts.
        named = ordered(store, strings.mapInArrow(_triples(True), triple), ["a", "b", "c"], ["row", "i"], ["row", "i"])
        out = store.write(_per_string(named.select("row", "i", F.col("pos").alias("rank")), "rank"))
        store.drop(named)
        return out
    # 1. Triples at the positions not divisible by three, sorted and named.
    sample = strings.filter("size(symbols) > 1").mapInArrow(_triples(False), triple)
    named = ordered(store, sample, ["a", "b", "c"], ["row", "i"], ["row", "i"])
    spent = [named]
    if named.n_names == named.n_rows:
        ranks = _per_string(named.select("row", "i", F.col("pos").alias("r")), "r", sampled=True)
    else:
        # 2. The names are the symbols of a shorter string: first those after a multiple of three,
        # then, past a gap, the others. Its suffix ranks order the sampled suffixes.
        shorter = store.write(_per_string(named.select("row", "i", F.col("name").alias("symbols")), "symbols", sampled=True, gap=True))
        cuts = shorter.count()
        below = suffix_ranks(store, shorter, -(-depth // 3))
        spent += [shorter, below]
        # Gaps are the least symbol, so they hold the first ranks.
        clean = F.filter(F.transform("rank", lambda x: x - cuts), lambda x: x >= 0)
        ranks = below.select("row", clean.alias("r"))
    # 3. Merge: a suffix at a multiple of three is compared with the others by one or two symbols and a rank.
    both = store.write(strings.join(ranks, "row", "left").select("row", "symbols", "r"))
    store.drop(*spent)
    zero, keep = "i % 3 = 0", ["row", "i", "r"]
    first = both.mapInArrow(_halves(2), "row long, i int, a long, r1 long, r long")
    first = ordered(store, first, ["a", "r1"], ["row", "i"], keep, zero)
    second = both.mapInArrow(_halves(1), "row long, i int, a long, b long, r2 long, r long")
    second = ordered(store, second, ["a", "b", "r2"], ["row", "i"], keep, zero)
    parts = first.select("row", "i", F.expr(f"CASE WHEN {zero} THEN pos - before ELSE r + before END AS rank")).unionByName(
        second.select("row", "i", F.expr(f"CASE WHEN {zero} THEN pos ELSE r + before END AS rank"))
    )
    out = store.write(_per_string(parts, "rank"))
    store.drop(both, first, second)
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """``row, doc, text, rest``: rows are numbered by their place in the scan, null ids come last.

    ``rest`` holds all columns, so that their names cannot clash with others.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"),
        "text",
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"),
    )


def _asked(row: tuple) -> tuple[Parsed, np.ndarray, np.ndarray]:
    """Anchors whose windows are compared one by one, and their hashes.

    These are the first places of passages, and repeated anchors that are in none.
    """
    n, places, firsts, repeated, hashes, suffix, open_ = row
    rep = np.flatnonzero(np.frombuffer(repeated, dtype=bool))
    own = np.frombuffer(suffix, dtype="<i4")[rep]
    asked = (own < 0) | _among(own, open_)
    return Parsed(n, places, firsts), rep[asked], np.frombuffer(hashes, dtype="<u8")[asked]


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the asked anchors, once per text and a second time if one occurs again."""
    for batch in batches:
        blobs = [batch.column(i).to_pylist() for i in range(7)]
        for row, *rest in zip(*blobs, _lists(batch.column(7)), strict=True):
            yield _once_or_twice(_asked(tuple(rest))[2], row)


def _surroundings(raw: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The AROUND bytes from each ``at`` on, 0 where none of the windows ``lo`` to ``hi`` covers them."""
    around = np.lib.stride_tricks.sliding_window_view(raw, AROUND)[at]
    k = np.arange(AROUND)
    return np.where((k >= lo[:, None]) & (k < (hi + LENGTH)[:, None]), around, np.uint8(0))


def _runs(place: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Windows ``from_`` to ``to`` of packed anchors, packed as first start and further starts."""
    return ((place >> 12) - WINDOW + 1 + from_) << 6 | (to - from_)


def _sums(around: np.ndarray) -> np.ndarray:
    values = (around.astype(np.uint64) + np.uint64(1)) * _powers()[0][:AROUND]
    return np.concatenate((np.zeros((len(around), 1), dtype=np.uint64), np.cumsum(values, axis=1)), axis=1)


def _windows_around(place: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor number, window number and hash of every window of packed anchors, in that order."""
    sums = _sums(around)
    found = _mix((sums[:, LENGTH:] - sums[:, :-LENGTH]) * _powers()[1][:WINDOW])
    j = np.arange(WINDOW)
    row, j = np.nonzero((j >= (place >> 6 & 63)[:, None]) & (j <= (place & 63)[:, None]))
    return row, j, found[row, j]


def _first_seen(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands there for the first time."""
    first = np.zeros(len(keys), dtype=bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def _same_around(h: np.ndarray, place: np.ndarray, around: np.ndarray) -> np.ndarray:
    """A key that anchors with equal windows have in common."""
    return _mix(_sums(around)[:, -1] ^ _mix(h.view(np.uint64) + (place & 4095).astype(np.uint64)))


_AROUND = "h long, no long, place long, around binary"


def _rows(h: np.ndarray, no: np.ndarray, place: np.ndarray, around: np.ndarray | None = None) -> pa.RecordBatch:
    """A batch of ``h, no, place, around``; without bytes, ``place`` is a packed run of windows."""
    if around is None:
        data = pa.nulls(len(no), pa.binary())
    else:
        offsets = np.arange(len(no) + 1, dtype=np.int32) * AROUND
        data = pa.Array.from_buffers(pa.binary(), len(no), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(around))])
    return pa.record_batch([pa.array(h), pa.array(no), pa.array(place), data], ["h", "no", "place", "around"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asked anchors that others share, with the bytes around them: ``h, no, place, around``.

    ``place`` packs the anchor's place p and its windows; window j begins at p - WINDOW + 1 + j,
    where the bytes begin. An anchor whose windows all stand earlier in the same text is decided
    here: its run of windows is passed on without bytes, under any ``h``. So a text of one period
    is spread.
    """
    margin = bytes(LENGTH)
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in (0, 1, *range(3, 9))]
        parts: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(6)]
        texts, begin = [margin], LENGTH
        for shared, open_, no, text, *rest in zip(_lists(batch.column(2)), _lists(batch.column(9)), *cols, strict=True):
            t, ask, hashes = _asked((*rest, open_))
            keep = np.flatnonzero(_among(hashes.view(np.int64), shared) & (t.last[ask] >= t.first[ask]))
            if len(keep):
                ask = ask[keep]
                place = t.place[ask]
                texts += [_bytes_of(text), margin]
                values = (hashes[keep].view(np.int64), np.full(len(ask), no), place, t.first[ask], t.last[ask], place + begin)
                for c, v in zip(parts, values, strict=True):
                    c.append(v)
                begin += len(texts[-2]) + LENGTH
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        every = [np.concatenate(c) for c in parts]
        for k in range(0, len(every[0]), 4 * HELD):
            h, no, place, lo, hi, at = (c[k : k + 4 * HELD] for c in every)
            lo, hi = lo - place + WINDOW - 1, hi - place + WINDOW - 1
            around = _surroundings(raw, at - WINDOW + 1, lo, hi)
            place = place << 12 | lo << 6 | hi
            new = _first_seen(_mix(_same_around(h, place, around) + no.view(np.uint64)))
            yield _rows(h[new], no[new], place[new], around[new])
            if not new.all():
                old = place[~new]
                yield _rows(_mix(old.view(np.uint64)).view(np.int64), no[~new], _runs(old, lo[~new], hi[~new]))


def _compare(batches: Iterator[pa.RecordBatch], limit: int = HELD) -> Iterator[pa.RecordBatch]:
    """Runs of windows that stand earlier, out of rows sorted by ``h, no, place``.

    Of one hash only anchors with different surroundings are held. If there are more than ``limit``,
    they and what follows of the hash are passed on with their bytes, to be dealt by window.
    """
    held = None  # different anchors of the last hash
    many = None  # the hash that has too many
    for batch in itertools.chain(batches, [None]):
        rows = None if batch is None else _with_bytes(batch)
        if batch is not None and batch.column(3).null_count:
            done = batch.filter(batch.column(3).is_null())
            yield _rows(*[done.column(i).to_numpy() for i in range(3)])
        if rows is None:
            rows, held, batch = held, None, None
        elif held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        if rows is None or not len(rows[0]):
            continue
        over = rows[0] == many if many is not None else np.zeros(len(rows[0]), dtype=bool)
        if over.any():
            yield _rows(*[c[over] for c in rows])
            rows = tuple(c[~over] for c in rows)
            if not len(rows[0]):
                continue
        h, no, place, around = rows
        new = _first_seen(_same_around(h, place, around))
        old = place[~new]
        if len(old):
            yield _rows(h[~new], no[~new], _runs(old, old >> 6 & 63, old & 63))
        h, no, place, around = (c[new] for c in rows)
        last = int(np.searchsorted(h, h[-1])) if batch is not None else len(h)
        held, many = tuple(c[last:] for c in (h, no, place, around)), None
        if len(held[0]) > limit:
            yield _rows(*held)
            held, many = None, h[-1]
        if last:
            no, place = no[:last], place[:last]
            row, j, found = _windows_around(place, around[:last])
            later = np.zeros((last, WINDOW + 2), dtype=np.int8)
            later[row, j + 1] = ~_first_seen(found)
            step = np.diff(later, axis=1)
            (row, from_), to = np.nonzero(step > 0), np.nonzero(step < 0)[1]
            yield _rows(h[row], no[row], _runs(place[row], from_, to - 1))


def _with_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    rows = batch.filter(batch.column(3).is_valid())
    around = np.frombuffer(b"".join(rows.column(3).to_pylist()), dtype=np.uint8).reshape(-1, AROUND)
    return (*[rows.column(i).to_numpy() for i in range(3)], around)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, no, at`` of every window of the given anchors; h is the window's own hash."""
    for batch in batches:
        _, no, place, around = _with_bytes(batch)
        row, j, found = _windows_around(place, around)
        at = (place[row] >> 12) - WINDOW + 1 + j
        yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(no[row]), pa.array(at)], ["h", "no", "at"])


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h those that are not the first of their h by text and place, as packed runs of one."""
    held = np.zeros((3, 0), dtype=np.int64)  # the first of the last h, as far as seen
    for batch in batches:
        own = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1)
        own = own[:, np.lexsort(own[::-1])]
        first = np.append(True, own[0, 1:] != own[0, :-1])[: own.shape[1]]
        held = own[:, first][:, -1:]
        out = own[1:, ~first]
        if out.shape[1]:
            yield pa.record_batch([pa.array(out[0]), pa.array(out[1] << 6)], ["no", "place"])


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals that overlap or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def repeats(docs: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Every document's other columns as ``rest``, and ``finish`` of its bytes and repeated spans.

    ``finish`` takes the text's bytes and the starts and ends of the maximal runs of repeated
    bytes, and returns values for the columns of ``schema``. ``docs`` has to be a stored table,
    whose scan gives rows in the same order each time. Null and empty texts have no bytes,
    and texts under LENGTH bytes no repeats. Rows that repeat an id count in scan order.
    """
    spark = docs.sparkSession
    # Each step ends in a stored table, so its shuffle files can go when it is written.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    # How a scan is split depends on the cores at hand, and rows are numbered by it: keep the split
    # of now for all scans, also if executors are lost in between.
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))
    store = Stored(spark, "suffixes")
    texts = _numbered(docs)
    parsed = store.write(texts.select("row", "doc", "text").mapInArrow(_parse, _PARSED))
    # Of copies of a whole text only the first takes part from here on.
    whole = parsed.withColumn("anchors", F.octet_length("places")).filter(f"n >= {LENGTH}").groupBy("digest").agg(F.min(F.struct("doc", "row", "anchors")).alias("f"))
    firsts = store.write(whole.select("f.row", "f.anchors"))
    # Anchors that occur again, in this text or another.
    buckets = _buckets(parsed, firsts.agg(F.sum("anchors")).first()[0] or 0)
    known = _recurring(parsed.select("row", "hashes").join(firsts, "row", "left_semi"), _emit_hashes, "known", buckets)
    columns = ["row", "doc", "n", "hashes", "places", "firsts", "known"]
    live = store.write(parsed.join(known, "row").select(*columns).mapInArrow(_strings, _LIVE))
    store.drop(parsed)
    depth = live.agg(F.max(F.array_max("need")).alias("d")).first().d or 0
    marks = spark.createDataFrame([], "row long, open array<int>, gone array<int>")
    if depth:
        ranks = suffix_ranks(store, live.select("row", "symbols"), depth)
        zipped = F.posexplode(F.arrays_zip("rank", "digest")).alias("i", "x")
        suffix = live.select("row", "doc", "digest").join(ranks, "row").select("row", "doc", zipped)
        suffix = suffix.select("row", "doc", "i", "x.*").filter("digest <> 0")
        # Neighbours in the suffix array with equal prefixes are one passage.
        array = ordered(store, suffix, ["rank"], [], ["row", "doc", "i"], names=["digest"])
        lead = array.groupBy("name").agg(F.min(F.struct("doc", "row", "i")).alias("f"))
        lead = lead.select("name", "f.row", "f.i", F.lit(True).alias("lead"))
        marked = array.select("name", "row", "i").join(lead, ["name", "row", "i"], "left")
        marks = store.write(
            marked.groupBy("row").agg(
                F.collect_list(F.when(F.col("lead"), F.col("i"))).alias("open"),
                F.collect_list(F.when(F.col("lead").isNull(), F.col("i"))).alias("gone"),
            )
        )
        store.drop(array, ranks)
    # Rows get numbers in the order that decides which place is first.
    order = ordered(store, live.select("row", "doc"), ["doc", "row"], [], ["row"]).select("row", F.col("pos").alias("no"))
    string = ["n", "places", "firsts", "repeated", "hashes", "suffix", "open"]
    judged = live.join(marks, "row", "left").join(order, "row").select("row", "no", *string, "gone")
    judged = store.write(judged)
    store.drop(live)
    # Windows that begin or end outside a passage's agreed part: compared one by one, if another
    # such window has the same anchor.
    buckets = _buckets(judged, (judged.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 8)
    shared = _recurring(judged.select("row", *string), _ask, "shared", buckets)
    edge = judged.select("row", "no", *string).join(shared, "row")
    edge = texts.select("row", "text").join(edge, "row").select("no", "text", "shared", *string)
    asked = edge.mapInArrow(_edges, _AROUND).repartition("h").sortWithinPartitions("h", "no", "place")
    compared = store.write(asked.mapInArrow(_compare, _AROUND))
    # Hashes with very many different surroundings: every window goes its own way.
    single = compared.filter("around IS NOT NULL").mapInArrow(_single_windows, "h long, no long, at long")
    single = single.repartition("h").sortWithinPartitions("h").mapInArrow(_again, "no long, place long")
    runs = compared.filter("around IS NULL").select("no", "place").unionByName(single)
    later = store.write(runs.groupBy("no").agg(F.collect_list("place").alias("at")))
    store.drop(compared)
    found = judged.join(later, "no", "left").select("row", "n", "places", "firsts", "suffix", "gone", "at")
    every = texts.join(firsts.select("row", F.lit(True).alias("leads")), "row", "left").join(found, "row", "left")
    fields = [f.strip().split()[0] for f in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(f.strip().split()[0], kinds[f.strip().split()[1]]) for f in schema.split(",")])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            lists = [cols[name].to_pylist() for name in ("leads", "n", "places", "firsts", "suffix")]
            out = []
            for text, gone, at, *row in zip(cols["text"].to_pylist(), _lists(cols["gone"]), _lists(cols["at"]), *lists, strict=True):
                raw = _bytes_of(text)
                out.append(finish(raw, *_spans(raw, gone, at, *row)))
            made = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), arrow.types, strict=True)] if out else []
            if made:
                yield pa.record_batch([cols["rest"], *made], ["rest", *fields])

    rest = every.schema["rest"].dataType.simpleString()
    return every.select("text", "leads", "n", "places", "firsts", "suffix", "gone", "at", "rest").mapInArrow(
        finished, f"rest {rest}, {schema}"
    )


def _spans(
    raw: bytes, gone: np.ndarray, at: np.ndarray, leads: bool | None, n: int, places: bytes | None, firsts: bytes, suffix: bytes
) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of repeated bytes of a text."""
    none = np.zeros(0, dtype=np.int64)
    if len(raw) >= LENGTH and not leads:
        return np.array([0]), np.array([len(raw)])
    if places is None or not (len(gone) or len(at)):
        return none, none
    t = Parsed(n, places, firsts)
    covers = np.frombuffer(suffix, dtype="<i4")
    u = np.flatnonzero((covers >= 0) & _among(covers, gone) & (t.last >= t.first))
    return _union(np.concatenate((t.first[u], at >> 6)), np.concatenate((t.last[u], (at >> 6) + (at & 63))) + LENGTH)


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    edges = [0, *np.stack((starts, ends), 1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document; see :func:`repeats`."""

    def finish(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
        digest = hashlib.sha256(_kept(raw, starts, ends)).hexdigest()
        return len(raw), int((ends - starts).sum()), len(starts), digest

    found = repeats(column_named(docs, "doc_id", "text"), finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Documents without repeated bytes, with all their columns; ``n_chars`` is counted anew.

    A character that loses some of its bytes goes whole. A document whose bytes are all
    repeated goes; null texts and others that lost nothing stay as they are.
    """

    def finish(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
        return len(starts), _kept(raw, starts, ends).decode("utf-8", "ignore") if len(starts) else None

    was = free_name(docs, "_was")
    found = repeats(docs.withColumn(was, F.col("text")), finish, "n_spans long, left string")
    found = found.filter("n_spans = 0 OR left <> ''")
    text = F.when(F.col("n_spans") == 0, F.col(f"rest.`{was}`")).otherwise(F.col("left"))
    columns = []
    for c in docs.columns:
        value = text if c == "text" else F.col(f"rest.`{c}`")
        if c == "n_chars":
            value = F.when(F.col("n_spans") == 0, value).otherwise(F.length(text)).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return found.select(*columns)
