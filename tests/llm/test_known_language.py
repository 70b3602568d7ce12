"""The language stage keeps every labelled document and drops texts in unlearned scripts."""

import numpy as np

import corpus_pipeline

SCRIPTS = {
    "Cyrillic": (0x430, 0x450), "Greek": (0x3B1, 0x3CA), "Hebrew": (0x5D0, 0x5EB), "Arabic": (0x627, 0x64B),
    "Hiragana": (0x3042, 0x3094), "random Latin": (0x61, 0x7B),
}


def test_unlearned_go_and_labelled_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = np.random.default_rng(20)
    foreign = []
    for low, high in SCRIPTS.values():
        for n in [300] * 20 + [10] * 5:
            text = " ".join("".join(map(chr, rng.integers(low, high, rng.integers(2, 9)))) for _ in range(n))
            foreign.append((10_000_000 + len(foreign), text))
    others = spark.createDataFrame(foreign, "doc_id long, text string")
    both = docs.unionByName(others, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, both, sf_dir).collect()}
    assert kept == {r.doc_id for r in docs.filter("lang IS NOT NULL").collect()}
