"""SentencePiece encoding by suffix-array matching, and decoding.

For a BPE model. The texts of a batch are cut into units that no piece crosses, and the
distinct units are joined into one string with a suffix array. Each piece of the vocabulary
is looked up by binary search, which gives every place where it occurs. These edges, sorted
by their end, are relaxed from left to right: the last piece of a prefix is the one whose
predecessor goes with it, that is, where merging both together gives the same two pieces. For
BPE exactly one piece does, so the result equals the merges', without running them.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import column_named, lean

# Where the vocabulary lies; a setting of the cluster, never part of the repository.
MODEL = os.environ.get("DOSSIER_PIECES", "/opt/tokenizers/piece_bpe_32k.model")

SPACE = "▁"
# Characters of text cut into units at once, and of new units indexed at once; they bound memory,
# not results.
INDEX_CHARS = 4_000_000
INDEX_UNIT_CHARS = 1 << 18
# Encoded units a worker keeps for later batches and, as other operators run in it too, for later
# tasks, and pairs of pieces it remembers; they bound memory, not results.
KEPT_UNITS = 500_000
KEPT_LATER = 100_000
KEPT_PAIRS = 300_000


class Vocabulary:
    """Pieces of a BPE model with byte fallback, read from its file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.pieces.items()}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces cross spaces")
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.size = n
        self.longest = max(map(len, self.pieces))
        self.bytes = [b""] * n
        for p, i in self.pieces.items():
            self.bytes[i] = p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        # White space that no piece holds parts units as well.
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if not any(c in p for p in self.pieces))
        held = re.escape(alone)
        self.unit = re.compile(f"[{held}]|{SPACE}*[^{SPACE}{held}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.characters = np.unique(np.frombuffer("".join(self.pieces).encode("utf-32-le"), dtype=np.uint32))
        self.ids = np.array(list(self.pieces.values()))
        self.lengths = np.array([len(p) for p in self.pieces])
        # Code points of each piece, filled up with 0.
        self.spelled = np.array([[*map(ord, p), *[0] * (self.longest - len(p))] for p in self.pieces])
        self.units = Units()
        self._goes: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short string: best pair first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def goes(self, key: int) -> bool:
        """Whether the second piece may follow the first; kept once found out.

        ``key`` is first * size + second; the first is ``size`` at the start of a unit.
        """
        known = self._goes.get(key)
        if known is None:
            a, b = divmod(key, self.size)
            second = self.text[b]
            known = self.merge(second) == [second] if a == self.size else self.merge(self.text[a] + second) == [self.text[a], second]
            self._goes[key] = known
        return known

    def trim(self, units: int = KEPT_UNITS, pairs: int | None = None) -> None:
        """Forget what is kept if it is more than a worker may keep."""
        if len(self.units) > units:
            self.units.clear()
        if len(self._goes) > (KEPT_PAIRS if pairs is None else pairs):
            self._goes.clear()


_LOADED: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    """The vocabulary, read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def forget(path: str, most: int) -> None:
    """Drop the units and pairs that this worker keeps if they are more than ``most``.

    Steps are sent to workers with copies of the globals they name, so that only a function of
    this module sees what ``load`` has read there.
    """
    if path in _LOADED:
        _LOADED[path].trim(most, most)


def _packed(points: np.ndarray, width: int, pack: int) -> list[np.ndarray]:
    """Keys of the ``width`` characters from each position on, ``pack`` to a number."""
    padded = np.concatenate((points.astype(np.uint64), np.zeros(width + pack, dtype=np.uint64)))
    return [_key([padded[at + k : at + k + len(points)] for k in range(pack)]) for at in range(0, width, pack)]


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """Columns of character ranks as one number, the first most significant."""
    out, bits = np.zeros(len(columns[0]), dtype=np.uint64), np.uint64(64 // len(columns))
    for c in columns:
        out = (out << bits) | c
    return out


def _lower_bound(keys: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """First suffix not smaller than each wanted key, by bisection of all at once."""
    lo = np.zeros(len(wanted[0]), dtype=np.int64)
    hi = np.full(len(wanted[0]), len(keys[0]), dtype=np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.minimum((lo + hi) // 2, len(keys[0]) - 1)
        less = np.zeros(len(lo), dtype=bool)
        same = np.ones(len(lo), dtype=bool)
        for k, w in zip(keys, wanted, strict=True):
            here = k[mid]
            less |= same & (here < w)
            same &= here == w
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


def edges(joined: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and id of every occurrence of a piece in the joined units.

    Characters become ranks first (0 parts units, 1 is a character that no piece holds), so
    that eight of them fit one key, or four where a batch has very many characters.
    """
    here = np.unique(joined)
    known = here[np.isin(here, v.characters)]
    rank = np.zeros(0x110000, dtype=np.uint16)
    rank[1:] = 1
    rank[known] = np.arange(2, len(known) + 2)
    pack = 8 if len(known) < 250 else 4
    top = np.uint64((1 << (64 // pack)) - 1)
    # One character more than the longest piece, so that every piece has a greatest key.
    width = -(-(v.longest + 1) // pack) * pack
    keys = _packed(rank[joined], width, pack)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    ranks = rank[v.spelled]
    possible = ((ranks > 1) | (v.spelled == 0)).all(axis=1)
    length, ids = v.lengths[possible], v.ids[possible]
    low = np.zeros((len(ids), width), dtype=np.uint64)
    low[:, : v.longest] = ranks[possible]
    high = np.where(np.arange(width)[None, :] < length[:, None], low, top)
    bounds = [
        _lower_bound(keys, [_key(list(m[:, at : at + pack].T)) for at in range(0, width, pack)]) for m in (low, high)
    ]
    first, count = bounds[0], np.maximum(bounds[1] - bounds[0], 0)
    which = np.repeat(np.arange(len(ids)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return order[np.repeat(first, count) + inside], length[which], ids[which]


def encode_units(units: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units one after the other, and where each begins."""
    joined = np.frombuffer(("\0".join(u.replace("\0", "﷐") for u in units) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    offset = np.arange(len(joined)) - np.repeat(begin, sizes + 1)
    start, length, piece = edges(joined, v)
    # Last piece of the prefix that ends before a position, and its length. A character that
    # is no piece stands alone, and anything may follow it.
    start_of, free = v.size, -1
    last = np.full(len(joined) + 1, -2, dtype=np.int64)
    back = np.ones(len(joined) + 1, dtype=np.int64)
    last[begin] = start_of
    end = offset[start] + length
    turn = end * (v.longest + 1) + (v.longest - length)
    order = np.argsort(turn, kind="stable")
    start, length, piece, turn = start[order], length[order], piece[order], turn[order]
    covered = np.zeros(len(joined), dtype=bool)
    covered[start[length == 1]] = True
    lone = np.flatnonzero(~covered & (joined != 0))
    lone = lone[np.argsort(offset[lone], kind="stable")]
    lone_end = offset[lone] + 1
    cuts = np.append(np.flatnonzero(np.append(True, turn[1:] != turn[:-1])), len(turn)) if len(turn) else np.zeros(1, dtype=np.int64)
    ends = turn[cuts[:-1]] // (v.longest + 1)
    lone_at = 0
    marks = np.append(ends, np.iinfo(np.int64).max)
    for g in range(len(marks)):
        # Lone characters that end before this group's end are settled first.
        upto = np.searchsorted(lone_end, marks[g], side="left") if lone_at < len(lone) else lone_at
        while lone_at < upto:
            stop = np.searchsorted(lone_end, lone_end[lone_at], side="right")
            last[lone[lone_at:stop] + 1] = free
            lone_at = stop
        if g == len(ends):
            break
        s = slice(cuts[g], cuts[g + 1])
        at, n, p = start[s], length[s], piece[s]
        todo = last[at + n] == -2
        # The place after a unit's last character is its separator, which nothing else sets.
        before = last[at]
        todo &= before != -2
        at, n, p, before = at[todo], n[todo], p[todo], before[todo]
        ok = before == free
        # After a lone character a piece begins afresh.
        key = np.where(ok, start_of, before) * v.size + p
        asked, inverse = np.unique(key, return_inverse=True)
        fits = np.fromiter(map(v.goes, asked.tolist()), dtype=bool, count=len(asked))[inverse]
        last[at[fits] + n[fits]] = p[fits]
        back[at[fits] + n[fits]] = n[fits]
    # Walk back from the end of every unit, all units in step.
    place = begin + sizes
    unit = np.flatnonzero(sizes > 0)
    place = place[unit]
    seen_unit, seen_place, seen_id = [], [], []
    while len(unit):
        seen_unit.append(unit)
        seen_place.append(place)
        seen_id.append(last[place])
        place = place - back[place]
        more = place > begin[unit]
        unit, place = unit[more], place[more]
    if not seen_unit:
        return np.zeros(0, dtype=np.int32), np.zeros(len(units) + 1, dtype=np.int64)
    unit, place, ids = map(np.concatenate, (seen_unit, seen_place, seen_id))
    order = np.argsort(place, kind="stable")
    unit, place, ids = unit[order], place[order], ids[order]
    alone = ids == free
    if alone.any():
        # Byte fallback: a lone character becomes the ids of its bytes.
        chars = [units[u][o - 1].encode("utf-8", "surrogatepass") for u, o in zip(unit[alone], place[alone] - begin[unit[alone]], strict=True)]
        many = np.ones(len(ids), dtype=np.int64)
        many[alone] = [len(c) for c in chars]
        spread = np.repeat(ids, many)
        spread[np.repeat(alone, many)] = [v.byte[b] for c in chars for b in c]
        unit, ids = np.repeat(unit, many), spread
    starts = np.searchsorted(unit, np.arange(len(units) + 1))
    return ids.astype(np.int32), starts


class Units(dict):
    """Numbers of units in the order of their first use, and the ids of those encoded so far."""

    def __init__(self):
        super().__init__()
        self.clear()

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n

    def clear(self) -> None:
        super().clear()
        self.done = 0
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def encode_new(self, v: Vocabulary) -> None:
        """Index and encode the units that came up since the last call."""
        fresh = list(islice(self, self.done, None))
        if fresh:
            starts, ids = [self.starts], [self.ids]
            size = len(self.ids)
            for block in _blocks(fresh):
                found, begin = encode_units(block, v)
                starts.append(begin[1:] + size)
                ids.append(found)
                size += len(found)
            self.starts, self.ids = np.concatenate(starts), np.concatenate(ids)
            self.done = len(self)


def _blocks(units: list[str]) -> Iterator[list[str]]:
    """The units in order, in blocks of up to INDEX_UNIT_CHARS characters; a longer unit is a block of its own."""
    start = size = 0
    for k, unit in enumerate(units):
        if k > start and size + len(unit) > INDEX_UNIT_CHARS:
            yield units[start:k]
            start, size = k, 0
        size += len(unit)
    if units:
        yield units[start:]


def encode_texts(texts: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each text. An empty text has none; otherwise it begins with a space of its own."""
    units = v.units
    v.trim()
    rows = [
        np.array([units[u] for u in v.unit.findall(SPACE + t.replace(" ", SPACE))] if t else [], dtype=np.int64)
        for t in texts
    ]
    units.encode_new(v)
    out = []
    for row in rows:
        begin = units.starts[row]
        count = units.starts[row + 1] - begin
        ends = np.cumsum(count)
        out.append(units.ids[np.repeat(begin - ends + count, count) + np.arange(count.sum())])
    return out


def decode_ids(ids: np.ndarray, v: Vocabulary) -> str:
    """Text of a row of ids, without the space put before it."""
    table = v.bytes
    raw = b"".join([table[i] for i in ids.tolist()])
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_pieces, ids, ids_sha256, decoded, exact`` per document.

    ``ids_sha256`` is over the ids as little-endian 32-bit numbers. ``decoded`` is the text
    decoded from the ids, ``exact`` whether it is the text (the space sign U+2581 itself comes
    back as a space). Null and empty texts have no ids and are exact; repeated rows are encoded
    one by one; whole texts are encoded, however long.
    """
    rows = column_named(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_pieces", "ids", "ids_sha256", "decoded", "exact"]

    def coded(ids_in: list, texts: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        v = load(model)
        found = encode_texts(texts, v)
        back = [decode_ids(x, v) for x in found]
        flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        cols = [
            pa.array(ids_in, id_type),
            pa.array([len(x) for x in found], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
            pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found]),
            pa.array(back),
            pa.array([a == b for a, b in zip(back, texts, strict=True)]),
        ]
        return pa.record_batch(cols, names)

    def batches_of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_in: list = []
        texts: list[str] = []
        size, id_type = 0, pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids_in.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= INDEX_CHARS:
                    yield coded(ids_in, texts, id_type)
                    ids_in, texts, size = [], [], 0
        if texts:
            yield coded(ids_in, texts, id_type)
        forget(model, KEPT_LATER)

    schema = f"doc_id {kind}, n_pieces long, ids array<int>, ids_sha256 string, decoded string, exact boolean"
    return rows.mapInArrow(lean(batches_of_text), schema)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``; null ids give an empty text."""
    rows = column_named(rows, "doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            texts = [decode_ids(np.array(x or [], dtype=np.int64), v) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(back, f"doc_id {kind}, text string")
