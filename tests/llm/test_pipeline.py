"""The pipeline's stages on the smallest documents, each against brute force on its own input."""

import corpus_pipeline
from dossier.llm import langid, pieces
from tests.llm.test_near_copies import keepers
from tests.llm.test_small_ops import contaminated, removed


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(t.columns == columns for t in tables[:-1])
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]

    judged = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert set(rows[1]) == {d for d, r in judged.items() if r.lang_pred != "und" and r.score >= langid.FLOOR}

    entries = [(d, r.text) for d, r in rows[1].items()]
    assert set(rows[2]) == {entries[k][0] for k in keepers(entries)}

    raw = [(d, (r.text or "").encode()) for d, r in rows[2].items()]
    left = {}
    for k, mark in removed(raw).items():
        text = bytes(c for c, gone in zip(raw[k][1], mark) if not gone).decode("utf-8", "ignore")
        if text or not mark.any():
            left[raw[k][0]] = text
    assert {d: r.text or "" for d, r in rows[3].items()} == left
    assert all(r.n_chars == len(r.text) for r in rows[3].values())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(d, r.text) for d, r in rows[3].items()], items) if r[5]}
    assert set(rows[4]) == set(rows[3]) - bad

    ids = pieces.encode_texts([r.text for r in rows[4].values()], pieces.load(pieces.MODEL))
    assert {d: x.tolist() for d, x in zip(rows[4], ids)} == {d: list(r.ids) for d, r in rows[5].items()}
    assert all(r.exact for r in rows[5].values())
