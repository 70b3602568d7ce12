"""Anchors found for many texts at once, and their hashes dealt in buckets."""

import collections

import numpy as np
import pyarrow as pa

from dossier.llm import suffixes


def test_anchors_of_texts_together():
    rng = np.random.default_rng(4)
    sizes = [0, 99, 100, 101, 5, *rng.integers(0, 900, 60), suffixes.TOGETHER, 0, suffixes.TOGETHER + 5, 300]
    texts = [rng.integers(97, 99, int(n), dtype=np.uint8).tobytes() for n in sizes] + [b"a" * 400, b"ab" * 200]
    for some in (texts, [], [b""], [b"a"] * 3):
        *found, count = suffixes.anchors_of(some)
        ends = np.cumsum(count)
        assert len(count) == len(some)
        for k, text in enumerate(some):
            for got, wanted in zip(found, suffixes.anchors(np.frombuffer(text, dtype=np.uint8)), strict=True):
                assert np.array_equal(got[ends[k] - count[k] : ends[k]], wanted)


def test_pairs_are_dealt_in_few_rows():
    rng = np.random.default_rng(5)
    pairs = [(rng.integers(0, 900, 50), np.full(50, row)) for row in range(40)] + [(np.zeros(0, dtype=np.int64),) * 2]
    dealt = list(suffixes._dealt(iter(pairs), 8))
    assert sum(b.num_rows for b in dealt) <= 8
    rows = sorted((r for b in dealt for r in b.to_pylist()), key=lambda r: r["bucket"])
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 3], schema=dealt[0].schema) for k in range(0, len(rows), 3)]
    found = [(r["h"], r["row"]) for b in suffixes._repeated(iter(batches)) for r in b.to_pylist()]
    times = collections.Counter(int(h) for x, _ in pairs for h in x)
    assert sorted(found) == sorted({(int(h), int(r)) for x, y in pairs for h, r in zip(x, y) if times[int(h)] > 1})
    assert not list(suffixes._dealt(iter(pairs[-1:]), 8))


def test_dealt_rows_do_not_grow_with_tasks_and_partitions(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 123, 3000, dtype=np.uint8).tobytes().decode() for _ in range(64)]
    rows = [(k, text + texts[k - 1][500:900]) for k, text in enumerate(texts)] + [(90, None), (91, ""), (92, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    sent, dealt = spark.sparkContext.accumulator(0), suffixes._dealt

    def counted(found, buckets):
        for batch in dealt(found, buckets):
            sent.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(suffixes, "_dealt", counted)
    was, found, counts = spark.conf.get("spark.sql.shuffle.partitions"), [], []
    try:
        for partitions in (2, 100):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            before = sent.value
            found.append(sorted(suffixes.report(docs).collect()))
            counts.append(sent.value - before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1] and sum(r.n_removed for r in found[0]) > 64 * 300
    pairs = sum(len(suffixes.anchors(np.frombuffer(text.encode(), dtype=np.uint8))[0]) for _, text in rows if text)
    tasks = 100  # of each of the two steps that deal pairs, at most
    assert 0 < max(counts) <= 2 * (tasks + pairs // 64)
