"""The similarity join on fingerprints without an id."""

from dossier.llm import spots


def test_similar_keeps_fingerprints_without_an_id(spark):
    base = " ".join(f"the kappa{i} rho{i} and of tau{i} phi{i}" for i in range(20))
    rows = [(None, base), (1, base + " the word1 end1"), (2, "the lambda sigma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {frozenset((r.a, r.b)) for r in spots.similar(docs).collect()} == {frozenset((None, 1))}
