from collections import Counter

from dossier.operators.contacts import contacts
from dossier.skew import with_group_size


def test_group_size_equals_a_count(spark):
    """One value holds more than a third of all rows, and several lie around the limit."""
    keys = ["hot"] * 500 + [f"v{i % 40}" for i in range(400)] + ["x" * 400] * 90 + [None] * 3
    frame = spark.createDataFrame([(i, k, 1) for i, k in enumerate(keys)], "id int, k string, c int")
    made = with_group_size(frame.repartition("id"), ["k", "c"], "id", "n")
    got = sorted((r.id, r.n) for r in made.collect())
    counts = Counter(keys)
    assert got == [(i, counts[k]) for i, k in enumerate(keys) if k is not None]


def test_a_long_run_is_searched_in_linear_time(spark):
    run = "aB3-_" * 200_000
    rows = [(1, run), (2, run + " me@x.org"), (3, "a@b.cc@d.ee a@b.c_d@e.f")]
    found = contacts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.value) for r in found} == {(2, "me@x.org"), (3, "a@b.cc"), (3, "a@b.c"), (3, "_d@e.f")}


def test_texts_are_searched_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = contacts(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Scan parquet") == 1 and text.count("ReusedExchange") >= 1
