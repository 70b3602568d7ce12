"""Each operator on small fixtures against brute force: nulls, empty and long texts, ties, clashes."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dossier.llm import decontaminate, extract, hmm, langid, licenses, pieces, shards, simhash, spots, suffixes
from dossier.llm.common import token_list, word_list

EN = "the river and the old bridge of stone that stands by it is not far from this quiet town"
DE = "der alte Fluss und die Brücke aus Stein die nicht weit von der kleinen Stadt für uns steht"

TEXTS = [
    None,
    "",
    "   \n\t ",
    EN,
    EN,
    EN.upper(),
    EN.replace("quiet", "noisy"),
    DE,
    DE + " " + EN,
    "12345 !!! ---",
    "one",
    "one two",
    (EN + " ") * 40,
    "x" * 5000,
    "the the the the " * 60,
    "日本語 の テキスト 😀 " * 12,
    "a\x00b c",
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Documents with ties, repeated rows, a null id and columns that clash with the operators' own."""
    rows = [(i, t, "en" if t and t.startswith("the") else None, "n", 1, "h") for i, t in enumerate(TEXTS)]
    rows += [(3, EN, "en", "n", 1, "h"), (None, DE, "de", "n", 1, "h"), (90, DE, "de", "n", 1, "h")]
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, key int, fp string").coalesce(
        2
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- sharding


def test_shards(docs, empty):
    found = shards.shard(docs, 4).collect()
    assert sorted((r.size, r.text_crc32) for r in found) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows_of(docs)
    )
    held = collections.defaultdict(list)
    for r in found:
        held[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in held.values()) and set(held) <= set(range(4))
    assert shards.shard(empty).count() == 0


def test_slot_map_versions(spark, tmp_path):
    sizes = [(i * 37) % 101 + 1 for i in range(512)]
    first = shards.first_map(sizes, 8)
    load = [sum(s for s, k in zip(sizes, first.owner) if k == j) for j in range(8)]
    assert max(load) - min(load) <= max(sizes)
    grown = shards.rebalance(first, sizes, 9)
    moved = [(a, b) for a, b in zip(first.owner, grown.owner) if a != b]
    assert moved and all(b == 8 for _, b in moved) and grown.version == 2
    load = [sum(s for s, k in zip(sizes, grown.owner) if k == j) for j in range(9)]
    assert max(load) - min(load) <= max(sizes)
    shards.save_map(spark, str(tmp_path / "map"), first)
    shards.save_map(spark, str(tmp_path / "map"), grown)
    assert shards.load_map(spark, str(tmp_path / "map"), 1).owner == first.owner
    assert shards.load_map(spark, str(tmp_path / "map"), 2).owner == grown.owner


# --- decontamination


def contaminated(docs, items):
    out = []
    for doc_id, text in docs:
        w = word_list(text)
        hit, ids = set(), set()
        for item, t in items:
            x = word_list(t)
            m = min(10, len(x))
            grams = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else set()
            for i in range(len(w) - m + 1):
                if m and tuple(w[i : i + m]) in grams:
                    hit |= set(range(i, i + m))
                    ids.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_set", [20_000, 3])
def test_decontamination(spark, docs, empty, max_set):
    items = [(1, EN), (2, "one two"), (3, None), (4, ""), (5, "nothing of the kind here at all my dear old friend today"), (6, "two")]
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id int, text string, gram int")
    found = decontaminate.contamination(docs, bench, max_set=max_set).drop("spans").collect()
    assert sorted(map(tuple, found), key=str) == contaminated(rows_of(docs), items)
    clean = decontaminate.clean_documents(docs, bench, max_set=max_set)
    assert clean.columns == docs.columns
    want = [(d, t) for d, t in rows_of(docs) if not contaminated([(d, t)], items)[0][5]]
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(want, key=str)
    assert decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.contaminated for r in none)


# --- SimHash


def plain_fingerprint(text):
    w = token_list(text)
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in found) == sorted(
        (str(d), plain_fingerprint(t)) for d, t in rows_of(docs)
    )
    fp = {r.doc_id: r.fp % 2**64 for r in found}
    for r in found:
        reach, todo = set(), [r.fp % 2**64]
        while todo:
            x = todo.pop()
            reach.add(x)
            todo += [y for y in fp.values() if y not in reach and (x ^ y).bit_count() <= 3]
        assert r.component_id == min(d for d, x in fp.items() if x in reach and d is not None)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found})
    assert simhash.near_duplicates(empty).count() == 0


def test_gray_index_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, size=40, dtype=np.uint64)
    flips = np.array([1 << int(b) for b in rng.integers(0, 64, size=(400, 3)).ravel()], dtype=np.uint64).reshape(400, 3)
    codes = np.unique(np.concatenate((base, np.bitwise_xor.reduce(flips, axis=1) ^ base[rng.integers(0, 40, 400)])))
    q, c = simhash.GrayIndex(codes).near(codes, 3)
    want = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 3}
    assert set(zip(q.tolist(), c.tolist())) == want
    steps = simhash.gray_rank(np.arange(1024, dtype=np.uint64) ^ (np.arange(1024, dtype=np.uint64) >> np.uint64(1)))
    assert steps.tolist() == list(range(1024))


def test_links_meet_in_a_bucket(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for k in range(60):
        a = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        b = a
        for bit in rng.choice(64, size=3, replace=False):
            b ^= 1 << int(bit)
        pairs += [(2 * k, a), (2 * k + 1, b)]
    signed = [(i, x - 2**64 if x >= 2**63 else x) for i, x in pairs]
    found = simhash.links(spark.createDataFrame(signed, "id long, fp long")).collect()
    assert {(r.a, r.b) for r in found} == {(2 * k + 1, 2 * k) for k in range(60)}


# --- licenses


def test_licenses(spark, empty):
    mit = licenses.TEMPLATES["notice-mit"]
    rows = [
        (1, None, 1), (2, "", 1), (3, "All Rights Reserved. cc-by CC BY all rights reserved", 1),
        (4, f"hello\n{mit.title()}!\nbye", 1), (5, " ".join(mit.split()[:10]), 1),
        (6, "GNU General Public\nLicense", 1), (7, "nothing " * 3000, 1), (7, "nothing", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = collections.defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r.doc_id].append(r)
    assert [got[k][0].n_words for k in (1, 2)] == [0, 0] and len(got[7]) == 2
    three = got[3][0]
    assert (three.n_base, three.first_word, three.last_word, three.base_labels) == (4, 0, 7, "cc-by,reserved")
    assert "notice-mit" in got[4][0].labels and got[4][0].base_labels == "" and got[4][0].score == 1.0
    assert got[5][0].labels == "" and got[5][0].first_word is None and got[5][0].score == 0.0
    assert got[6][0].base_labels == "gpl"
    assert licenses.scan(empty.select("doc_id", "text")).count() == 0


def test_similarity_join_is_exact(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    templates = {f"t{k}": " ".join(rng.choice(words, size=rng.integers(2, 12), replace=False)) for k in range(12)}
    docs = [(i, "\n".join(" ".join(rng.choice(words, size=rng.integers(1, 25))) for _ in range(3))) for i in range(150)]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), {}, templates, 0.7).collect()
    for r in got:
        want = set()
        for line in dict(docs)[r.doc_id].split("\n"):
            for label, t in templates.items():
                size = len(set(t.split()))
                if len(set(t.split()) & set(line.split())) >= 0.7 * size - 1e-9:
                    want.add(label)
        assert r.labels == ",".join(sorted(want))


# --- languages


def test_language(spark, docs, empty):
    found = {r.doc_id: r for r in langid.identify(docs).collect() if r.doc_id is not None}
    assert len(langid.identify(docs).collect()) == docs.count()
    for k in (0, 1, 2, 9):
        assert (found[k].lang_pred, found[k].score) == ("und", 0.0)
    assert found[7].lang_pred == "de" and found[6].lang_pred == "en"
    for r in found.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    kept = langid.in_known_language(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2, 9})
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    letters = langid.letter_vectors(64)
    text = "Straße über den Fluss, the end"
    got, has = langid.bundles([text, "", "12"], letters)
    want = np.zeros(64)
    c = [0, *[x for k, x in enumerate(langid.codes(text)) if x or (k and langid.codes(text)[k - 1])], 0]
    for a, b, d in zip(c, c[1:], c[2:]):
        if b:
            want += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[d]
    assert np.array_equal(got[0], want) and has.tolist() == [True, False, False]


# --- SpotSigs


def test_spots(docs, empty):
    got = sorted(map(tuple, spots.fingerprints(docs, buckets=5).collect()), key=str)
    order = sorted(rows_of(docs), key=lambda r: (-(r[0] if r[0] is not None else -(2**62)), r[1] is not None, r[1] or ""))
    want = []
    for k, (doc_id, text) in enumerate(order):
        own, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        new = spots.edited(own, nxt)
        s, e, n = (set(spots.signatures(x).tolist()) for x in (own, new, nxt))
        share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        prints = (spots.as_text(spots.signatures(own)), spots.as_text(spots.signatures(new)))
        want.append((doc_id, len(own), hashlib.sha256(new.encode()).hexdigest(), *prints, share(s, e), share(s, n)))
    assert got == sorted(want, key=str)
    assert spots.fingerprints(empty).count() == 0


def test_similar_spots(spark):
    base = [f"the {a} {b} and of {b} {a}" for a, b in zip("kappa lambda sigma omega".split(), "rho tau phi chi".split())]
    rows = [(i, " ".join(base * 6 + [f"the word{j} end{j}" for j in range(i % 7)])) for i in range(40)] + [(99, None), (98, "")]
    got = {(r.a, r.b) for r in spots.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for i, t in rows:
        sets.setdefault(tuple(spots.signatures(t).tolist()), i)
    reps = [(i, set(s)) for s, i in sets.items() if s]
    want = {
        frozenset((a, b)) for a, x in reps for b, y in reps if a < b and len(x & y) >= 0.8 * len(x | y)
    }
    assert {frozenset(p) for p in got} == want and want


# --- hidden Markov model


def test_hmm_base_and_known(docs, empty):
    got = hmm.score(docs).collect()
    c = collections.Counter()
    for d, t in rows_of(docs):
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(token_list(t))
            c["END"] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows_of(docs):
        w = [*token_list(t), "END"]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want.append((str(d), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm.score(empty).count() == 0


def test_rare_words_meet_their_counts(docs, monkeypatch):
    whole = {(r.doc_id, r.n_known): r.score for r in hmm.score(docs).collect()}
    monkeypatch.setattr(hmm, "KNOWN_BYTES", 10**6)
    again = {(r.doc_id, r.n_known): r.score for r in hmm.score(docs).collect()}
    assert whole.keys() == again.keys() and all(math.isclose(whole[k], again[k], rel_tol=1e-9) for k in whole)


def test_forward_sums_over_all_paths():
    rng = np.random.default_rng(5)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), size=3), rng.dirichlet(np.ones(4), size=3).T)
    seqs = [rng.integers(0, 4, size=n) for n in (6, 6, 3, 1)]
    got = hmm.log10_likelihood(m, seqs)
    grids = [np.array(np.meshgrid(*[range(3)] * len(s))).reshape(len(s), -1).T for s in seqs]
    for s, grid, g in zip(seqs, grids, got):
        total = sum(
            m.start[p[0]] * m.emit[s[0], p[0]] * math.prod(m.move[p[k - 1], p[k]] * m.emit[s[k], p[k]] for k in range(1, len(s)))
            for p in grid
        )
        assert math.isclose(g, math.log10(total), rel_tol=1e-9)
    start, moves, emits = hmm.expected_counts(m, seqs)
    assert math.isclose(start.sum(), 4) and math.isclose(moves.sum(), 12) and math.isclose(emits.sum(), 16)


# --- pieces


@pytest.fixture(scope="module")
def model():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_equal_merging(docs, empty, model):
    for r in pieces.encode(docs).collect():
        text = next(t or "" for d, t in rows_of(docs) if d == r.doc_id)
        assert list(r.ids) == model.encode(text) and r.n_pieces == len(r.ids)
        assert r.exact and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<i4").tobytes()).hexdigest()
    back = pieces.decode(pieces.encode(docs)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((d, t or "") for d, t in rows_of(docs)), key=str)
    assert pieces.encode(empty).count() == 0


def test_pieces_on_random_texts(model):
    rng = np.random.default_rng(6)
    letters = list("aeinstr  ..\n\té▁0-=") + ["the", "ing", "  ", "ß", "語"]
    texts = ["".join(rng.choice(letters, size=rng.integers(0, 60))) for _ in range(400)] + [" " * k for k in range(70)]
    got = pieces.encode_texts(texts, pieces.load(pieces.MODEL))
    assert [g.tolist() for g in got] == model.encode(texts)


# --- suffix array


def removed(rows):
    seen, out = set(), {}
    for k, (_, raw) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0])):
        mark = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                mark[i : i + 100] = True
            seen.add(w)
        out[k] = mark
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    blocks = ["".join(rng.choice(list("ab é"), size=n)) for n in (40, 99, 101, 150, 300, 700)]
    texts = ["".join(rng.choice(blocks, size=rng.integers(1, 6))) for _ in range(50)]
    texts += ["a" * 450, "ab" * 300, None, "", texts[0], texts[0], "the the " * 80 + texts[3], "z" * 99, "z" * 100, "z" * 100]
    rows = [(int(i), t, 5, len(t or "")) for i, t in zip(rng.permutation(len(texts)), texts)]
    spark.createDataFrame(rows, "doc_id long, text string, row int, n_chars int").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    raw = [(d, (t or "").encode()) for d, t in rows_of(docs)]
    want = removed(raw)
    kept = {}
    for k, (d, b) in enumerate(raw):
        mark = want[k]
        rest = np.frombuffer(b, dtype=np.uint8)[~mark].tobytes()
        runs = int((mark & ~np.append(False, mark[:-1])).sum()) if len(mark) else 0
        kept[d] = (len(b), int(mark.sum()), runs, hashlib.sha256(rest).hexdigest(), rest)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.report(docs).collect()}
    assert got == {d: v[:4] for d, v in kept.items()}
    left = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    assert suffixes.remove_repeats(docs).columns == docs.columns
    for d, b in raw:
        text = kept[d][4].decode("utf-8", "ignore")
        if kept[d][1] and not text:
            assert d not in left
        elif kept[d][1]:
            assert left[d].text == text and left[d].n_chars == len(text)
        else:
            assert (left[d].text or "").encode() == b
    assert suffixes.report(docs.limit(0)).count() == 0


# --- extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><div class="ad">Buy now &amp; save</div>
<article><h1>The  title &amp; more</h1><p>First <b>bold</b>
paragraph&nbsp;with &lt;tags&gt; and a long sentence of plain words, so it reads like prose.<p>Second paragraph,
also with a good number of words in it, and a <a href=x>link</a> inside.</article>
<div id="comments"><p>Nice one!</p></div><footer>&copy; 2020 somebody</footer></body></html>"""


def test_extraction(spark):
    pages = [(i, f"http://e/{i}", PAGE.replace("Second", f"Next {i}")) for i in range(30)]
    pages += [(90, "u", None), (91, "u", ""), (91, "u", ""), (92, "u", "<p>unclosed <b>text <!-- x"), (93, "u", "<" * 50)]
    got = collections.defaultdict(list)
    for r in extract.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")).collect():
        got[r.page_id].append(r)
    want = (
        "The title & more\nFirst bold paragraph with <tags> and a long sentence of plain words, so it reads like prose.\n"
        "Next 3 paragraph, also with a good number of words in it, and a link inside."
    )
    assert got[3][0].text == want and got[3][0].n_chars == len(want)
    assert got[90][0].text == "" and len(got[91]) == 2


def test_nothing_is_kept_below_a_dropped_node():
    nodes, _ = extract.parse(PAGE)
    rng = np.random.default_rng(7)
    for _ in range(50):
        kept = extract.decode(nodes, rng.normal(0, 3, size=len(nodes)))
        assert all(kept[n.parent] for n, k in zip(nodes, kept) if k and n.parent >= 0)
