"""Columns named like the operators' own, and links through rows without an id."""

import pytest

from dossier.llm import decontaminate, jaccard, langid, simhash, suffixes

NAMES = ["_found", "_row", "__row", "_was", "rest", "row", "n", "node", "key", "component", "hits"]


@pytest.fixture
def docs(spark):
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, text[0]), (2, text[1]), (3, text[2] + " end")]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in NAMES]) for r in rows], schema).coalesce(1)


def unchanged(got, docs):
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("max_set", [0, decontaminate.MAX_SET])
def test_decontamination(spark, docs, max_set):
    items = spark.createDataFrame([(1, " ".join(f"z{i}" for i in range(12)))], "item_id long, text string")
    unchanged(decontaminate.clean_documents(docs, items, max_set=max_set), docs)


def test_repeats(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    unchanged(suffixes.remove_repeats(stored), stored)


@pytest.mark.parametrize("operator", [simhash, jaccard])
def test_deduplication(docs, operator):
    unchanged(operator.deduplicate(docs), docs)


def test_language_stage_without_labels(spark, docs):
    with pytest.raises(ValueError, match="language"):
        langid.in_known_language(docs.selectExpr("*", "CAST(NULL AS STRING) AS lang"))
    assert langid.in_known_language(docs.limit(0).selectExpr("*", "CAST(NULL AS STRING) AS lang")).count() == 0


def test_fingerprints_link_through_a_row_without_id(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0), (None, 7), (3, 63), (9, -1)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: rows)
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows.limit(1)).collect()}
    assert found == {(1, 1), (None, 1), (3, 1), (9, 9)}
