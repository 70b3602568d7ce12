"""Span removal on null and repeated ids."""

import collections

from dossier.llm import decontaminate


def test_span_removal_keeps_rows_apart(spark):
    item = " ".join(f"bench{i}" for i in range(12))
    rows = [(None, f"one {item} two"), (None, "three four"), (5, f"{item} five"), (5, "five six"), (5, f"six {item}"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in decontaminate.without_spans(docs, items).collect())
    assert got == collections.Counter((d, " ".join((t or "").replace(item, "").split())) for d, t in rows)
