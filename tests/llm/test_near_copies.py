"""The near-duplicate stage against brute-force Jaccard over five-word shingles."""

import collections

import pytest

import corpus_pipeline
from dossier.llm import jaccard, simhash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def keepers(rows):
    """Places of the rows that stay of ``(doc_id, text)``."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if group[i] != group[j] and 10 * len(x & y) >= 8 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] or ""))
    first = {}
    for k in order:
        first.setdefault(group[k], k)
    return set(first.values())


def test_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.one_of_each(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[k][0] for k in keepers(rows))


def test_pairs_at_the_limit(spark, sf_dir):
    base = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:40])), (3, " ".join(base[:39])), (4, " ".join(base[:31] + ["x"]))]
    rows += [(5, "one two"), (6, "One  two"), (7, "one three"), (8, ""), (9, None), (10, "a b c d e f"), (11, "a b c d e g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()}
    assert kept == {rows[k][0] for k in keepers(rows)}
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("deduplicate", [simhash.deduplicate, jaccard.deduplicate])
def test_null_and_repeated_ids(spark, deduplicate):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"}
    rows = [
        (None, text["a"]), (None, text["b"]), (None, text["b"]),  # texts of their own, one twice
        (5, text["c"]), (5, text["d"]),  # a repeated id with different texts
        (3, text["e"]), (7, text["e"]), (7, text["f"]),  # first of its group, and a copy of document 3
        (None, text["f"]), (9, text["g"].upper()), (9, text["g"]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in deduplicate(docs).collect())
    assert got == collections.Counter(rows[k] for k in keepers(rows))
