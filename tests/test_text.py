import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import assemble, requests
from dossier.operators.contacts import contacts

FENCES = {
    "{}": "{}",
    "```json\n{}\n```": "{}",
    "```JSON{}```": "{}",
    "  ```\n{}\n\n``` \n": "{}",
    "```{}": "{}",
    "{}```": "{}",
    "Here: ```{}```": "Here: ```{}",
    "```jsonx```": "x",
    "``` ```": "",
    "```": "",
    " 　{}\x1f": "{}",
    "``````": "",
    "": "",
}


def test_fences(spark):
    frame = spark.createDataFrame([(t,) for t in FENCES], "t string")
    got = {r.t: r.s for r in frame.withColumn("s", X.strip_fences(F.col("t"))).collect()}
    assert got == FENCES


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=20), min_size=1, max_size=50))
def test_strip_equals_unicode_strip(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode().replace("\x00", "") for t in texts]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", X.strip(F.col("t")).alias("s"), X.has_text(F.col("t")).alias("h"))
    for row in rows.collect():
        assert row.s == texts[row.i].strip()
        assert row.h == bool(texts[row.i].strip())


def test_truncation_counts_code_points(spark):
    frame = spark.createDataFrame([("é😀x" * 5000,)], "t string")
    assert frame.select(X.truncate(F.col("t"))).first()[0] == ("é😀x" * 5000)[:12000]


def units(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, seq long, text string, kind string")


def test_pages_keep_blanks_and_paragraphs_drop_them(spark):
    rows = [(1, 2, "c", "page"), (1, 0, "a", "page"), (1, 1, " ", "page"), (1, 3, None, "page")]
    rows += [(2, 0, " a ", "paragraph"), (2, 1, " ", "paragraph"), (2, 2, "b", "paragraph")]
    rows += [(3, 0, "  ", "paragraph")]
    got = {r.doc_id: (r.text, r.n_units) for r in assemble.assemble_units(units(spark, rows)).collect()}
    assert got == {1: ("a\n \nc\n", 4), 2: (" a \nb", 2), 3: ("", 0)}


def test_a_document_is_one_row_at_any_size(spark):
    rows = [(1, i, f"p{i}", "page") for i in range(40_000)] + [(2, 7, "x", "page"), (2, 10**9, "y", "page")]
    texts = assemble.assemble_pages(units(spark, rows))
    got = {r.doc_id: (r.text, r.n_units) for r in texts.collect()}
    whole = "\n".join(f"p{i}" for i in range(40_000))
    assert got == {1: (whole, 40_000), 2: ("x\ny", 2)}
    lead = {r.doc_id: r.text for r in assemble.leading_text(texts).collect()}
    assert lead == {1: whole[:12_000], 2: "x\ny"}


def test_requests_take_text_as_data(spark):
    text = "100% $1 {x} \\d {{y}} 'q'"
    docs = spark.createDataFrame([(1, text), (2, "z" * 13000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in requests.extraction_requests(docs).collect()}
    t = requests.EXTRACTION
    assert rows[1].prompt == t.before + text + t.after
    assert rows[2].prompt == t.before + "z" * 13000 + t.after
    assert (rows[1].temperature, rows[1].max_tokens) == (0.1, 4096)


def test_skeleton_follows_the_schema():
    shape = requests.skeleton(requests.RESUME)
    assert shape["skills"] == [{"category": "string", "skills": ["string"]}]
    assert shape["experience"][0]["is_current"] is False
    assert shape["personal_info"]["email"] == "string or null"


@pytest.mark.parametrize("copies", [300])
def test_contacts_shared_by_many(spark, copies):
    rows = [(i, "mail hot@x.org hot@x.org now") for i in range(copies)]
    rows += [(1000, "one@y.net +1 (555) 123-4567"), (1001, "10.0.0.1 4111111111111111"), (1002, None)]
    found = contacts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == copies + 2
    assert {(r.value, r.n_docs) for r in found} == {
        ("hot@x.org", copies), ("one@y.net", 1), ("+1 (555) 123-4567", 1),
    }
