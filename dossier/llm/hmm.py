"""Hidden Markov language model.

Tokens are words and one end per text. The hidden chain emits classes: each of the most
frequent words is a class of its own, the end is one, and all other words fall into classes
by their last letters. A word's share of its class comes from counts over the whole corpus:

    P(text) = P(classes of its tokens) * product of P(word | class)

The first factor is computed exactly by the scaled forward recursion, and its parameters are
trained by Baum-Welch, with expected counts summed over all partitions.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, column_named, token_list

STATES = 8
OWN_CLASS = 8192  # words with a class of their own
SHARED_CLASSES = 2048
# Words whose counts every task gets, and their longest length; others are joined.
KNOWN_WORDS = 200_000
KNOWN_BYTES = 64
# Baum-Welch passes, each over every training text.
PASSES = 5
# Added to every expected emission, times the class's share of the corpus.
SMOOTH = 50.0
SEED = 6

# Words counted before a task hands its counts on, and tokens trained on at once: memory only.
FLUSH_WORDS = 300_000
BLOCK_TOKENS = 600_000

END = OWN_CLASS
CLASSES = OWN_CLASS + 1 + SHARED_CLASSES


def shared_class(word: bytes) -> int:
    return END + 1 + zlib.crc32(word[-3:]) % SHARED_CLASSES


@dataclass
class Vocabulary:
    """Counts the tasks need: of frequent words, of classes, and the totals."""

    words: dict[bytes, tuple[int, int]]  # class, count
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int  # N
    types: int  # V
    texts: int


def held_out(doc_id: str = "doc_id"):
    """Documents that are only scored. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts. Tasks add up what they read before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                total.update(token_list(text.as_py()))
                if len(total) > FLUSH_WORDS:
                    yield out()
                    total.clear()
        yield out()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_level(n: str):
    """A number that never falls as the count grows: few thousand levels, single counts up to 4096."""
    steps = F.floor(F.log2(F.col(n) / 4096) * 256)
    return F.when(F.col(n) <= 4096, F.col(n)).otherwise(4097 + steps).cast("int")


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """What the tasks need of the stored counts: a bounded number of words, and class totals."""
    short = counts.filter(F.octet_length("word") <= KNOWN_BYTES).withColumn("level", count_level("n"))
    # The lowest level whose words, with those of all levels above, are few enough. Only they
    # leave the tasks, so what reaches the driver has the same bound however many tasks there are.
    levels = sorted(((r.level, r["count"]) for r in short.groupBy("level").count().collect()), reverse=True)
    lowest, held = None, 0
    for level, n in levels:
        held += n
        if held > KNOWN_WORDS:
            break
        lowest = level
    top = [] if lowest is None else short.filter(F.col("level") >= lowest).select("word", "n").collect()
    top.sort(key=lambda r: (-r.n, bytes(r.word)))
    words = {}
    for rank, r in enumerate(top):
        w = bytes(r.word)
        words[w] = (rank if rank < OWN_CLASS else shared_class(w), r.n)
    last = F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")
    grouped = counts.withColumn("k", (F.crc32(last) % SHARED_CLASSES).cast("int"))
    tokens = np.zeros(CLASSES, dtype=np.int64)
    types = np.zeros(CLASSES, dtype=np.int64)
    for r in grouped.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[END + 1 + r.k], types[END + 1 + r.k] = r.n, r.v
    n_types = int(types.sum()) + (texts > 0)
    n_tokens = int(tokens.sum()) + texts
    for rank, r in enumerate(top[:OWN_CLASS]):
        k = shared_class(bytes(r.word))
        tokens[k] -= r.n
        types[k] -= 1
        tokens[rank], types[rank] = r.n, 1
    tokens[END], types[END] = texts, int(texts > 0)
    return Vocabulary(words, tokens, types, n_tokens, n_types, texts)


ENCODED = (
    "classes binary, n_tokens long, n_known long, counted double, in_class double, rare array<struct<word:binary,n:long>>"
)


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Texts as classes, with the sums that known words give and a list of the other words.

    ``counted`` adds log10(c + 1) over words whose count is known here; ``in_class`` subtracts
    log10 of the class total for every word of a shared class. ``docs`` holds ``row, doc_id,
    held_out, text``; the first three are kept.
    """
    share = spark_broadcast(docs, v)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "classes", "n_tokens", "n_known", "counted", "in_class", "rare"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = share.value
        # log10 of the denominator of P(word | class); 0 for a class of one word.
        total = np.log10(v.class_tokens + v.class_words + 1.0)
        total[: END + 1] = 0.0
        # Per known word: class, log10(c + 1), and what of it is the share of its class.
        number = {w: i for i, w in enumerate(v.words)}
        klass = np.array([k for k, _ in v.words.values()] or [0], dtype=np.int64)
        logs = np.log10(np.array([n for _, n in v.words.values()] or [0]) + 1.0)
        own = np.where(klass <= END, logs, 0.0)
        end_log = math.log10(v.texts + 1)
        find = number.get
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            rare_words: list[bytes] = []
            rare_times: list[int] = []
            offsets = [0]
            for text in batch.column(3):
                w = token_list(text.as_py())
                ids = np.fromiter((find(x, -1) for x in w), dtype=np.int64, count=len(w))
                seen = ids >= 0
                ks = klass[ids]
                if not seen.all():
                    others = np.flatnonzero(~seen)
                    unknown = [w[i] for i in others]
                    ks[others] = [shared_class(x) for x in unknown]
                    rare = Counter(unknown)
                    rare_words.extend(rare)
                    rare_times.extend(rare.values())
                offsets.append(len(rare_words))
                hit = ids[seen]
                cols[0].append(np.append(ks, END).astype("<u2").tobytes())
                cols[1].append(len(w) + 1)
                cols[2].append(int(seen.sum()) + (v.texts > 0))
                cols[3].append(float(logs[hit].sum()) + end_log)
                # Words of a class of their own, and the end, are the whole of it: P = 1.
                cols[4].append(-float(own[hit].sum()) - end_log - float(total[ks].sum()))
            types = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int64())], ["word", "n"])
            rares = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.record_batch([*[batch.column(i) for i in range(3)], *made, rares], names)

    rows = docs.select("row", "doc_id", "held_out", "text")
    return rows.mapInArrow(coded, f"row long, doc_id {kind}, held_out boolean, {ENCODED}")


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def first_model(v: Vocabulary, states: int = STATES, seed: int = SEED) -> Model:
    """Unigram emissions with a random tilt, and states that like to stay."""
    rng = np.random.default_rng(seed)
    share = (v.class_tokens + 1.0) / (v.class_tokens.sum() + len(v.class_tokens))
    emit = share[:, None] * rng.dirichlet(np.full(states, 2.0), size=len(share)) * states
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows of a task in blocks of texts of similar length: their first column, their classes."""
    held: list[tuple] = []
    size = 0

    def cut() -> Iterator[tuple]:
        held.sort(key=lambda x: -len(x[1]))
        at = 0
        while at < len(held):
            end, total = at, 0
            while end < len(held) and (end == at or total + len(held[end][1]) <= BLOCK_TOKENS):
                total += len(held[end][1])
                end += 1
            yield [x[0] for x in held[at:end]], [x[1] for x in held[at:end]]
            at = end

    for batch in batches:
        for key, raw in zip(batch.column(0), batch.column(column), strict=True):
            c = np.frombuffer(raw.as_buffer() or b"", dtype="<u2")
            held.append((key.as_py(), c))
            size += len(c)
        if size > 12 * BLOCK_TOKENS:
            yield from cut()
            held, size = [], 0
    yield from cut()


def _by_time(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts (longest first) one time step after the other, and where steps begin."""
    lengths = np.array([len(s) for s in seqs])
    active = np.cumsum(np.bincount(lengths, minlength=lengths[0] + 1)[::-1])[::-1][1:]
    offset = np.concatenate(([0], np.cumsum(active)))
    flat = np.empty(offset[-1], dtype=np.int64)
    for k, s in enumerate(seqs):
        flat[offset[: len(s)] + k] = s
    return flat, offset


def _forward(m: Model, flat: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables of all tokens, and their scales."""
    alpha = m.emit[flat]
    scale = np.empty(len(flat))
    for t in range(len(offset) - 1):
        now = alpha[offset[t] : offset[t + 1]]
        if t:
            before = offset[t - 1]
            now *= alpha[before : before + len(now)] @ m.move
        else:
            now *= m.start
        s = now.sum(axis=1)
        scale[offset[t] : offset[t + 1]] = s
        now /= s[:, None]
    return alpha, scale


def log10_likelihood(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of class sequences, longest first."""
    flat, offset = _by_time(seqs)
    _, scale = _forward(m, flat, offset)
    step = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    return np.bincount(np.arange(len(flat)) - offset[step], weights=np.log10(scale), minlength=len(seqs))


def expected_counts(m: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (one Baum-Welch step) of class sequences."""
    flat, offset = _by_time(seqs)
    alpha, scale = _forward(m, flat, offset)
    gamma = np.ones_like(alpha)
    ahead = m.emit[flat] / scale[:, None]
    back = m.move.T.copy()
    for t in range(len(offset) - 3, -1, -1):
        nxt = slice(offset[t + 1], offset[t + 2])
        n = offset[t + 2] - offset[t + 1]
        gamma[offset[t] : offset[t] + n] = (ahead[nxt] * gamma[nxt]) @ back
    step = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    later = step > 0
    before = np.arange(len(flat))[later] - offset[step[later]] + offset[step[later] - 1]
    moves = m.move * (alpha[before].T @ (ahead[later] * gamma[later]))
    gamma *= alpha
    emits = np.stack([np.bincount(flat, weights=gamma[:, k], minlength=len(m.emit)) for k in range(m.move.shape[0])], 1)
    return gamma[: offset[1]].sum(axis=0), moves, emits


def baum_welch(coded: DataFrame, m: Model, v: Vocabulary) -> Model:
    """One pass: tasks compute expected counts, one row per parameter and task is shuffled."""
    k = m.move.shape[0]
    share = spark_broadcast(coded, m)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, seqs in _blocks(batches, 1):
            parts = [x.ravel() for x in expected_counts(share.value, seqs)]
            total = parts if total is None else [a + b for a, b in zip(total, parts, strict=True)]
        if total is not None:
            flat = np.concatenate(total)
            at = np.flatnonzero(flat)
            yield pa.record_batch([pa.array(at), pa.array(flat[at])], ["i", "x"])

    parts = coded.select("row", "classes").mapInArrow(expect, "i long, x double")
    sums = parts.groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(k + k * k + len(m.emit) * k)
    flat[sums.i.to_numpy(dtype=np.int64)] = sums.x.to_numpy(dtype=float)
    start, move, emit = np.split(flat, [k, k + k * k])
    prior = (v.class_tokens + 1.0) / (v.class_tokens.sum() + len(v.class_tokens))
    emit = emit.reshape(-1, k) + SMOOTH * prior[:, None]
    move = move.reshape(k, k) + 0.1
    start = start + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document.

    Learned from the documents not held out, all of them in every pass, so the scores depend on
    the rows alone and not on how they are split over files or tasks. ``score`` is the model's log10 probability of
    the text, ``base_score`` that of add-one word counts. A null or empty text is an end
    alone. Counts cover every training text, also of repeated rows; words too rare or too
    long to be known in every task meet their counts in a join. Without training texts every
    word is unknown. An empty table gives no rows.
    """
    spark = docs.sparkSession
    store = Stored(spark, "hmm")
    rows = column_named(docs, "doc_id", "text").withColumn("held_out", held_out())
    trained = rows.filter("NOT held_out")
    counts = store.write(count_words(trained))
    v = vocabulary(counts, trained.count())
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    coded = store.write(encode(numbered, v))
    model = first_model(v)
    learn = coded.filter("NOT held_out")
    if v.texts:
        for _ in range(PASSES):
            model = baum_welch(learn, model, v)

    share = spark_broadcast(docs, model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, seqs in _blocks(batches, 1):
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(log10_likelihood(share.value, seqs))], ["row", "chain"])

    chain = coded.select("row", "classes").mapInArrow(judge, "row long, chain double")
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    found = rare.join(counts, "word", "left").select(
        "row",
        (F.log10(F.coalesce("n", F.lit(0)) + 1) * F.col("times")).alias("counted"),
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"),
    )
    # The parts of a row meet in one exchange, each already summed where it was made.
    own = coded.select(
        "row", "doc_id", "held_out", "n_tokens", "n_known", "counted", "in_class", F.lit(None).cast("double").alias("chain")
    )
    parts = own.unionByName(chain.select("row", "chain"), allowMissingColumns=True).unionByName(
        found.select("row", F.col("known").cast("long").alias("n_known"), "counted"), allowMissingColumns=True
    )
    base = math.log10(v.tokens + v.types + 1)
    return (
        parts.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.sum("counted").alias("counted"),
            F.sum("in_class").alias("in_class"),
            F.sum("chain").alias("chain"),
        )
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(v.tokens).cast("long").alias("train_tokens"),
            (F.col("counted") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
            (F.col("chain") + F.col("counted") + F.col("in_class")).alias("score"),
        )
    )
