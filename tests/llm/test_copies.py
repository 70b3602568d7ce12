"""The pipeline's near-duplicate stage links by fingerprints as well as by shingle sets."""

import os

import corpus_pipeline
from dossier.llm import copies, jaccard, simhash
from dossier.llm.common import Stored, scratch


def test_fingerprints_link_what_sets_do_not(spark, sf_dir):
    often = "a b c " * 200
    alike = [often + " ".join(f"{c}{i}" for i in range(10)) for c in "xy"]
    long = [f"w{i}" for i in range(49)]
    other = [" ".join(long), " ".join(long[:40])]
    assert simhash.fingerprint(alike[0]) == simhash.fingerprint(alike[1])
    assert bin(simhash.fingerprint(other[0]) ^ simhash.fingerprint(other[1])).count("1") > simhash.MAX_DIFF
    rows = list(zip((1, 2, 3, None), [*alike, *other], strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in jaccard.deduplicate(docs).collect()} == {1, 2, 3}
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == {1, 3, None}
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()} == {1, 3}


def test_both_kinds_of_links_make_one_chain(spark):
    """1 and 2 have one fingerprint, 2 and 3 similar sets: all are one group."""
    often = "a b c " * 200
    tail = [f"y{i}" for i in range(80)]
    rows = [(1, often + "x0 x1 x2"), (2, often + " ".join(tail)), (3, " ".join(tail))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.fingerprint(rows[0][1]) == simhash.fingerprint(rows[1][1])
    assert [r.doc_id for r in copies.deduplicate(docs).collect()] == [1]
    assert copies.deduplicate(docs.limit(0)).count() == 0


def test_scratch_removes_what_is_stored_inside(spark):
    outside = Stored(spark, "outside")
    with scratch():
        inside = Stored(spark, "inside").write(spark.range(3))
        kept = outside.write(inside)
        assert os.path.exists(inside.stored_at)
    assert not os.path.exists(inside.stored_at) and kept.count() == 3
