"""Hard negatives, the Jaccard join and conversation repair against brute force."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import negatives, queries, repair, rtree

# Hard negatives


def mined(rows, every=50, k=5, m=3):
    """Plain answers for ``(id, label, vector)``."""
    rows = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if y is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    last = float("inf")
    out = []
    for n, (a, label, v) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), last if i is None else i, k, i, y) for k, (i, y, w) in enumerate(rows) if k != n]
        scored.sort()
        positives = [s for s in scored if s[4] == label][:k]
        for p in positives:
            fits = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:m]
            out += [(a, p[3], r + 1, s[3], -p[0], -s[0]) for r, s in enumerate(fits)]
    return collections.Counter(out)


SCHEMA = "vec_id long, label int, embedding array<double>, score string, rank int"


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(3)), (rng.normal(size=6) + 0.5).tolist()) for i in range(300)]
    rows += [(300 + i, 1, rows[7][2]) for i in range(40)]  # one very common vector: ties
    rows += [(50, 2, rows[9][2]), (None, 1, rows[7][2]), (None, 0, rows[50][2])]  # repeated and null ids
    rows += [(350, None, rows[1][2]), (400, 1, None), (450, 1, [1.0, None]), (500, 1, [float("nan")]), (550, 0, [float("inf"), 1.0])]
    rows += [(600, 0, []), (650, 0, [1.0]), (700, 1, [0.0] * 6), (750, 0, [-0.7] * 9)]  # other lengths, no direction
    found = negatives.mine(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert collections.Counter(map(tuple, found.collect())) == mined(rows)


def test_negatives_of_nothing(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0], "", 1)], SCHEMA)).count() == 0
    one = spark.createDataFrame([(0, 1, [1e300], "", 1), (1, 1, [1e300], "", 1), (2, 0, [1e300], "", 1)], SCHEMA)
    assert negatives.mine(one).count() == 0  # scores beyond 64 bits are cut, and equal scores are too high


def test_access_stops_early_and_loses_nothing():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, 16)) * 4
    m = np.floor(256 * (centre[rng.integers(8, size=3000)] + rng.normal(size=(3000, 16)) * 0.3)).astype(np.int64)
    block = negatives.Block(np.arange(3000), np.arange(3000), np.zeros(3000, dtype=np.int64), m)
    vector, best, met = m[17], negatives.Best(5), 0
    for rows, bound in negatives.sorted_access(block, vector):
        met += len(rows)
        best.add(block.scores(rows, vector), block.ids[rows], block.rows[rows])
        if bound < best.worst:
            break
    assert met < 3000
    assert best.row.tolist() == np.lexsort((np.arange(3000), -(m @ vector)))[:5].tolist()


# Jaccard join


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def joined(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if x and y and group[i] != group[j] and 100 * len(x & y) >= 80 * len(x | y):
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
    return collections.Counter((d, len(s), least[g]) for (d, _), s, g in zip(rows, sets, group))


def test_join_against_brute_force(spark):
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(5000)}"
    rows, base = [], [word() for _ in range(180)]
    passage = [word() for _ in range(40)]
    for k in range(90):  # a large group of near copies, some of which only chain
        copy = list(base)
        for _ in range(draw.randrange(6)):
            copy[draw.randrange(len(copy))] = word()
        rows.append((k, " ".join(copy[: draw.randrange(150, 181)])))
    rows += [(100 + k, " ".join([word() for _ in range(draw.choice([3, 60, 200]))] + passage)) for k in range(60)]
    rows += [(200, " ".join(base).upper()), (None, " ".join(base[:170])), (201, ""), (202, None), (203, " \t\n"), (204, "a b"), (205, "A  b")]
    rows += [(206, "a b c d e"), (206, "a b c d f"), (None, "x y"), (207, " ".join(f"v{i}" for i in range(9000)))]
    rows += [(208, rows[-1][1] + " tail"), (209, "same " * 3000), (210, "same " * 7)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, node int")
    found = rtree.near_duplicates(docs)
    assert collections.Counter(map(tuple, found.collect())) == joined(rows)
    assert rtree.near_duplicates(docs.limit(0)).count() == 0


def test_chain_through_a_row_without_id(spark):
    w = [f"t{i}" for i in range(120)]
    rows = [(1, " ".join(w[:84])), (None, " ".join(w[:100])), (3, " ".join(w))]
    assert joined(rows) == collections.Counter([(1, 80, 1), (None, 96, 1), (3, 116, 1)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, rtree.near_duplicates(docs).collect())) == joined(rows)


def test_bounds_never_lose_a_pair_and_do_prune():
    draw = random.Random(2)
    pages, sets = [], []
    for _ in range(40):
        own = np.unique(np.array([draw.getrandbits(63) for _ in range(draw.randrange(100, 140))], dtype=np.int64))
        near = np.unique(np.append(own[draw.randrange(12) :], [draw.getrandbits(63) for _ in range(draw.randrange(12))]).astype(np.int64))
        sets.append([own, near])
        width = rtree.width_of(len(own))
        counts = [rtree.counts_of(s, width if s is own else rtree.width_of(len(near))) for s in (own, near)]
        for s, c in zip((own, near), counts):
            pages.append((s, rtree.Page(len(c), np.array([len(pages)]), np.array([len(s)]), c.astype(np.uint8).tobytes(), None)))
    met = true = 0
    for (x, p), (y, q) in itertools.combinations(pages, 2):
        i, _, bound = rtree.meeting(p, q, 80)
        common = len(np.intersect1d(x, y))
        alike = common >= rtree.needed(len(x), len(y))
        assert not (alike and not len(i)) and (not len(i) or bound[0] >= common)
        met, true = met + len(i), true + alike
    assert true > 10 and met < 0.1 * math.comb(len(pages), 2)


# Conversation repair


def brute(codes):
    """Cost and audit by following every state row by row, without a grammar."""
    ways = {repair.START: (0, "")}
    for move in [*map(repair._row_matrix, codes), None]:
        for _, i in itertools.product(range(2), range(4)):
            if i in ways:
                j = repair.NEXT[i, repair.TURN[i]]
                path = ways[i][0] + 5, ways[i][1] + "I"
                ways[j] = min(ways.get(j, path), path)
        if move is None:
            break
        after = {}
        for (i, j), (cost, letter) in move.items():
            if i in ways:
                path = ways[i][0] + cost, ways[i][1] + letter
                after[j] = min(after.get(j, path), path)
        ways = after
    return min(ways[j] for j in (repair.START, repair.ANSWER) if j in ways)


def test_grammar_gives_the_same_as_row_by_row():
    draw, grammar = random.Random(4), repair.Grammar()
    for pair in (b"\x03\x05", b"\x09\x03", b"\x0a\x09", b"\x05\x00", b"\x0b\x0b"):
        grammar.add(pair)
    for _ in range(400):
        codes = bytes(draw.choice([3, 5, 3, 5, 0, 1, 2, 4, 6, 7, 8]) for _ in range(draw.randrange(14)))
        cost, rope, _ = repair.best_end(grammar.matrix(codes))
        assert (cost, repair.spell(rope)) == brute(codes)
        chain = repair.Chain()
        cuts = sorted(draw.randrange(len(codes) + 1) for _ in range(3))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        for part in parts:
            chain.feed(*repair._ranked(grammar.matrix(part)))
        cost, tail, states = chain.end()
        audit = "".join(repair.spell(grammar.matrix(p)[s][1]) for p, s in zip(parts, states)) + tail
        assert (cost, audit) == brute(codes)


def test_edits_against_every_possible_audit():
    """Tiny conversations: all audits up to a length, applied and judged by the definition alone."""
    allowed = ["", "ua", "sua", "uaua", "suaua", "uauaua"]
    for codes in itertools.product([0, 1, 3, 4, 5, 7], repeat=3):
        best = None
        for length in range(9):
            for audit in itertools.product("DIKR", repeat=length):
                if sum(x != "I" for x in audit) != 3 or audit.count("I") > 4:
                    continue
                for target in allowed:
                    rows, cost, out = iter(codes), 0, 0
                    for x in audit:
                        if x == "D":
                            next(rows)
                            cost += 2
                            continue
                        want = target[out] if out < len(target) else "!"
                        out += 1
                        if x == "I":
                            cost += 5 if want in "ua" else 1000
                            continue
                        code = next(rows)
                        cost += (5 if code and (code - 1) % 2 else 0) + (x == "R") + (1000 if code == 0 else 0)
                        cost += 0 if (want in "ua" if x == "R" else code and repair.INITIALS[(code - 1) // 2] == want) else 1000
                    if out == len(target) and cost < 1000:
                        best = min(best or (cost, "Z"), (cost, "".join(audit)))
            if length >= 6:
                break
        cost, rope, _ = repair.best_end(repair.Grammar().matrix(bytes(codes)))
        assert (cost, repair.spell(rope)) <= best and (best[0] != cost or best[1] == repair.spell(rope)), codes


def sql_rows(rows):
    import pandas as pd

    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM given")
    return collections.Counter(con.execute(queries.ORACLES["op13_conversation_repair"]).fetchall())


def test_repair_against_sql(spark, tmp_path):
    draw = random.Random(8)
    texts = ["Yes.", "No!", "", None, "cut", "Same.", "a b?", " \t", "Ends. "]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c, draw.choice([t, t, t, None, 3]), draw.choice(roles[: draw.choice([2, 3, 7])]), draw.choice(texts))
            for c in range(60) for t in range(draw.randrange(1, 9))]
    # One conversation longer than a piece, one without an id, one that is dropped as a whole.
    rows += [(900, t, ["user", "assistant"][t % 2 if t % 17 else 0], f"turn {t if t % 5 else 5}{'.' if t % 7 else ''}") for t in range(700)]
    rows += [(None, t, "user", "Hi.") for t in range(4)]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows += [(gone, 1, "user", "Lost.")]
    given = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, cost string, at int")
    found = repair.repair(repair.damaged(given.repartition(5)))
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = collections.Counter(map(tuple, found.select(*columns).collect()))
    assert got == sql_rows(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert (gone, 0, 0, 0, 0, 0, 0, "", empty) in got
    assert repair.repair(repair.damaged(given.limit(0))).count() == 0
    renamed = given.filter("conv_id < 9").withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert repair.repair(renamed).count() == 9


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_ngram_jaccard", "op13_conversation_repair"])
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    answer = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in answer.description]
    want = collections.Counter(answer.fetchall())
    got = queries.QUERIES[name](spark, sf_dir).select(*columns)
    assert want and collections.Counter(map(tuple, got.collect())) == want
