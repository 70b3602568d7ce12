"""The hidden Markov model against a plain one: a step of training, whole scores, any split."""

import collections
import itertools
import math
import zlib

import numpy as np

from dossier.llm import hmm
from dossier.llm.common import token_list


def by_enumeration(m, seqs):
    """Expected starts, moves and emissions as sums over all paths."""
    k = len(m.start)
    start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for s in seqs:
        chances = {}
        for path in itertools.product(range(k), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            chances[path] = p
        total = sum(chances.values())
        for path, p in chances.items():
            start[path[0]] += p / total
            for t, state in enumerate(path):
                emits[s[t], state] += p / total
                if t:
                    moves[path[t - 1], state] += p / total
    return start, moves, emits


def test_expected_counts_are_sums_over_paths():
    rng = np.random.default_rng(8)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), size=3), rng.dirichlet(np.ones(4), size=3).T)
    seqs = [rng.integers(0, 4, size=n) for n in (7, 7, 4, 2, 1)]
    for got, want in zip(hmm.expected_counts(m, seqs), by_enumeration(m, seqs), strict=True):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def plain_scores(rows):
    """Scores of ``{doc_id: text}`` from one text at a time, with unscaled recursions."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in rows}
    words = {d: token_list(t) for d, t in rows.items()}
    counts = collections.Counter(w for d in rows if not held[d] for w in words[d])
    texts = sum(not h for h in held.values())
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    klass = {w: rank if rank < hmm.OWN_CLASS else hmm.shared_class(w) for rank, w in enumerate(ranked)}
    tokens, types = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, n in counts.items():
        tokens[klass[w]] += n
        types[klass[w]] += 1
    tokens[hmm.END], types[hmm.END] = texts, 1
    m = hmm.first_model(hmm.Vocabulary({}, tokens.astype(np.int64), types.astype(np.int64), 0, 0, texts))
    seqs = {d: [klass.get(w, hmm.shared_class(w)) for w in ws] + [hmm.END] for d, ws in words.items()}

    def forward(s):
        rows = [m.start * m.emit[s[0]]]
        for c in s[1:]:
            rows.append(rows[-1] @ m.move * m.emit[c])
        return rows

    for _ in range(hmm.PASSES):
        start, move, emit = np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit)
        for d, s in seqs.items():
            if held[d]:
                continue
            ahead, total = forward(s), forward(s)[-1].sum()
            back = np.ones_like(m.start)
            for t in range(len(s) - 1, -1, -1):
                emit[s[t]] += ahead[t] * back / total
                if t == 0:
                    start += ahead[t] * back / total
                else:
                    move += np.outer(ahead[t - 1], m.emit[s[t]] * back) * m.move / total
                    back = m.move @ (m.emit[s[t]] * back)
        prior = (tokens + 1.0) / (tokens.sum() + len(tokens))
        emit += hmm.SMOOTH * prior[:, None]
        move, start = move + 0.1, start + 0.1
        m = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def in_class(w):
        k = klass.get(w, hmm.shared_class(w))
        return 0.0 if k <= hmm.END else math.log10((counts[w] + 1) / (tokens[k] + types[k] + 1))

    return {d: math.log10(forward(s)[-1].sum()) + sum(map(in_class, words[d])) for d, s in seqs.items()}


def test_scores_equal_plain_ones_for_any_split(spark, tmp_path, monkeypatch):
    """More words than classes of their own; with a lower bound single words meet their counts in the join."""
    rng = np.random.default_rng(2)
    vocabulary = [f"word{k}" for k in range(9000)]
    stream = [w for w in vocabulary[:8400] for _ in range(4)] + vocabulary[8400:]
    rng.shuffle(stream)
    rows, at = {0: None, 1: "", 2: "never seen words"}, 0
    while at < len(stream):
        n = int(rng.integers(1, 40))
        rows[len(rows)] = " ".join(stream[at : at + n])
        at += n
    want = plain_scores(rows)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for known, files in ((200_000, 1), (8700, 5)):
        monkeypatch.setattr(hmm, "KNOWN_WORDS", known)
        path = str(tmp_path / f"{known}-{files}")
        docs.repartition(files).write.parquet(path)
        got = {r.doc_id: r.score for r in hmm.score(spark.read.parquet(path)).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)


def test_known_words_are_bounded_by_a_level_of_counts(spark, monkeypatch):
    """Words of one count are known together or not at all, so no task hands on more than it must."""
    monkeypatch.setattr(hmm, "KNOWN_WORDS", 5)
    rows = [(bytes([97 + k]), n) for k, n in enumerate((9000, 700, 700, 5, 4, 4, 4, 1))]
    v = hmm.vocabulary(spark.createDataFrame(rows, "word binary, n long"), 3)
    assert list(v.words) == [b"a", b"b", b"c", b"d"]
    assert v.tokens == sum(n for _, n in rows) + 3 and v.types == len(rows) + 1
    levels = spark.range(1, 100_000).select(hmm.count_level("id").alias("x")).collect()
    assert all(a.x <= b.x for a, b in zip(levels, levels[1:]))
