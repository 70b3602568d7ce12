"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A letter triple is the product of its
letters' vectors, each shifted by its place; a text is the sum of its triples; a language is
the sum of its texts. A text belongs to the language whose profile has the largest cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_named, lean

DIMENSIONS = 1024
GRAM = 3
SEED = 20

# Codes of letters: 0 parts words, a-z have their own, all others share the rest by a fixed rule.
CODES = 96
# Letters counted at once, and texts per block; they bound memory, not results.
SPAN = 1 << 20
BLOCK_CHARS = 1 << 20
BLOCK_TEXTS = 256

# A text whose score is lower is not in any learned language. A cosine's noise is larger than
# this, so it is the share of known triples that decides about languages not learned.
FLOOR = 0.02
# A triple is known in a language if it is at least this share of the triples of its texts.
KNOWN = 1e-5
# A text is in a language if at least this share of its triples is known there, less one
# standard deviation of a share of so many triples (short texts are noisy).
KNOWN_SHARE = 0.5


def _code_table() -> np.ndarray:
    """Code of each code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            table[point] = 27 + (point * 2654435761 >> 7) % (CODES - 27)
    for k in range(26):
        table[0x61 + k] = k + 1
    return table


_TABLE: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Letter codes of a lower-cased text."""
    if not _TABLE:
        _TABLE.append(_code_table())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _TABLE[0][points]


def triples(letters: np.ndarray) -> np.ndarray:
    """Numbers of the letter triples, with gaps between words as a letter; runs of gaps count once."""
    if not len(letters):
        return np.zeros(0, dtype=np.int32)
    keep = (letters != 0) | np.append(True, letters[:-1] != 0)
    c = np.concatenate(([0], letters[keep], [0])).astype(np.int32)
    return (c[:-2] * CODES + c[1:-1]) * CODES + c[2:]


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(CODES, dimensions))


def bind(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Vectors of letter triples: shifted by 2, by 1, and as they are, multiplied."""
    a, b, c = grams // (CODES * CODES), grams // CODES % CODES, grams % CODES
    return (np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]).astype(np.float32)


def bundles(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vector of each text, and whether it has a letter."""
    out = np.zeros((len(texts), letters.shape[1]), dtype=np.float32)
    has = np.zeros(len(texts), dtype=bool)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < BLOCK_TEXTS and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
            size += len(texts[end])
            end += 1
        pieces, owner = [], []
        for k in range(at, end):
            for start in range(0, len(texts[k]), SPAN):
                g = triples(codes(texts[k][start : start + SPAN]))
                g = g[g // CODES % CODES != 0]  # a triple around a gap alone tells nothing
                has[k] |= len(g) > 0
                pieces.append(g)
                owner.append(np.full(len(g), k - at, dtype=np.int64))
        if pieces:
            grams, row = np.concatenate(pieces), np.concatenate(owner)
            used = np.flatnonzero(np.bincount(grams, minlength=1))
            place = np.zeros(CODES**3, dtype=np.int32)
            place[used] = np.arange(len(used))
            for start in range(0, len(used), 8192):
                part = used[start : start + 8192]
                inside = (place[grams] >= start) & (place[grams] < start + len(part)) if len(used) > 8192 else slice(None)
                flat = row[inside] * len(part) + (place[grams[inside]] - start)
                counts = np.bincount(flat, minlength=(end - at) * len(part)).reshape(end - at, len(part))
                out[at:end] += counts.astype(np.float32) @ bind(part, letters)
        at = end
    return out, has


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Profiles of the languages in ``text, lang``, learned from every row with both.

    Tasks bundle their texts; one vector per task and language is shuffled. The driver gets
    the profiles, whose number is that of the languages. What all languages have in common is
    taken out of the profiles, so that only what sets them apart counts.
    """
    letters = letter_vectors(dimensions, seed)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            vectors, _ = bundles(batch.column(0).to_pylist(), letters)
            for lang in sorted(set(langs)):
                own = vectors[[k for k, x in enumerate(langs) if x == lang]].sum(axis=0, dtype=np.float64)
                total[lang] = total.get(lang, 0) + own
        for lang, v in total.items():
            place = pa.array(np.arange(len(v), dtype=np.int32))
            yield pa.record_batch([pa.array([lang] * len(v)), place, pa.array(v)], ["lang", "d", "v"])

    rows = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    parts = rows.mapInArrow(lean(bundle), "lang string, d int, v double")
    # Sums of whole numbers: exact, so the order of the parts does not matter.
    sums = parts.groupBy("lang", "d").agg(F.sum("v").alias("v"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("p")).collect()
    found.sort(key=lambda r: r.lang)
    profiles = np.array([[x.v for x in r.p] for r in found]).reshape(len(found), dimensions)
    unit = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
    if len(unit) > 1:
        unit = unit - unit.mean(axis=0)
    return [r.lang for r in found], unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)


def _text_triples(text: str | None) -> Iterator[np.ndarray]:
    """Triples of a text span by span, without those around a gap alone."""
    for start in range(0, len(text or ""), SPAN):
        g = triples(codes(text[start : start + SPAN]))
        yield g[g // CODES % CODES != 0]


def known_triples(labelled: DataFrame, least: float = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """Triples known in a language of ``text, lang``, and for each in which languages.

    The driver gets at most ``1 / least`` triples a language, so also the languages' number
    bounds it. Languages are in order; one without any triple has no column.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for g in _text_triples(text):
                    own = total.setdefault(lang, np.zeros(CODES**3, dtype=np.int64))
                    np.add.at(own, g, 1)
        for lang, times in total.items():
            at = np.flatnonzero(times)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at), pa.array(times[at])], ["lang", "gram", "n"])

    rows = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    whole = sums.groupBy("lang").agg(F.sum("n").alias("whole"))
    found = sums.join(F.broadcast(whole), "lang").filter(F.col("n") >= F.col("whole") * F.lit(least)).collect()
    langs = {lang: k for k, lang in enumerate(sorted({r.lang for r in found}))}
    grams = np.unique(np.array([r.gram for r in found], dtype=np.int64))
    within = np.zeros((len(grams), len(langs)), dtype=bool)
    for r in found:
        within[np.searchsorted(grams, r.gram), langs[r.lang]] = True
    return grams, within


def is_known(text: str | None, place: np.ndarray, within: np.ndarray, share: float = KNOWN_SHARE) -> bool:
    """Whether one language knows enough of a text's triples.

    ``place`` gives each triple's row in ``within``, whose first row is that of unknown ones.
    """
    seen, total = np.zeros(within.shape[1], dtype=np.int64), 0
    for g in _text_triples(text):
        seen += within[place[g]].sum(axis=0, dtype=np.int64)
        total += len(g)
    noise = math.sqrt(share * (1 - share) * total)
    return total > 0 and len(seen) > 0 and bool(seen.max() >= share * total - noise)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], seed: int = SEED) -> DataFrame:
    """``doc_id, lang_pred, score`` for every document, from its text alone.

    ``score`` is the cosine, not below 0. ``und`` with score 0 where the text is null or has
    no letter, and where nothing was learned. Ties go to the first language in order.
    """
    langs, profiles = model
    letters = letter_vectors(profiles.shape[1], seed) if langs else None
    rows = column_named(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if langs:
                vectors, has = bundles(texts, letters)
                norm = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
                cosine = vectors @ profiles.T.astype(np.float32) / norm[:, None]
                best = cosine.argmax(axis=1)
                score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                pred = [langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(lean(judge), f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Documents that take no part in training. A null id is trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the documents not held out."""
    model = train(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame, floor: float = FLOOR, share: float = KNOWN_SHARE) -> DataFrame:
    """Documents in one of the languages learned from them; all columns stay.

    Rejected are texts that are null, have no letter, whose score is below ``floor``, or of
    whose letter triples no language knows ``share``, less the noise at their number. A table
    from which no language can be learned is an error, unless it has no rows.
    """
    if docs.isEmpty():
        return docs
    learned = docs.filter(~held_out())
    langs, profiles = train(learned)
    letters = letter_vectors(profiles.shape[1]) if langs else None
    grams, within = known_triples(learned) if langs else (None, None)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(CODES**3, dtype=np.int32)
        place[grams] = np.arange(1, len(grams) + 1)
        table = np.concatenate((np.zeros((1, within.shape[1]), dtype=bool), within))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            vectors, has = bundles(texts, letters)
            norm = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
            best = (vectors @ profiles.T.astype(np.float32) / norm[:, None]).max(axis=1)
            known = np.array([is_known(t, place, table, share) for t in texts], dtype=bool)
            yield batch.filter(pa.array(has & (best >= floor) & known))

    if not langs:
        # Nothing is learned, so nothing can be told unknown: rejecting all would lose the table.
        raise ValueError("no document has both a text and a language to learn from")
    return docs.mapInArrow(lean(keep), docs.schema)
