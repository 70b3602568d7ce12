"""What steps hold at once and keep for later tasks; neither changes a result."""

import os

import numpy as np
import pyarrow as pa

from dossier.llm import pieces
from dossier.llm.common import lean, small_batches


def test_new_units_are_indexed_in_blocks(monkeypatch):
    texts = [" ".join(f"unit{i * k}" for i in range(300)) for k in range(1, 9)] + ["", "x" * 500]
    whole = pieces.encode_texts(texts, pieces.Vocabulary(pieces.MODEL))
    sizes, encode = [], pieces.encode_units
    monkeypatch.setattr(pieces, "INDEX_UNIT_CHARS", 400)
    monkeypatch.setattr(pieces, "encode_units", lambda units, v: sizes.append(sum(map(len, units))) or encode(units, v))
    found = pieces.encode_texts(texts, pieces.Vocabulary(pieces.MODEL))
    assert [x.tolist() for x in found] == [x.tolist() for x in whole]
    assert len(sizes) > 10 and sorted(sizes)[-2] <= 400  # but for the one unit that is longer


def test_a_worker_keeps_little_for_later_tasks(monkeypatch):
    v = pieces.Vocabulary(pieces.MODEL)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 10)
    first = pieces.encode_texts(["some words of a text", "and others"], v)
    v.trim(3)
    assert not v.units and not v._goes
    again = pieces.encode_texts(["some words of a text", "and others"], v)
    assert [x.tolist() for x in again] == [x.tolist() for x in first]


def test_units_do_not_stay_in_the_worker_that_encoded_them(spark, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_LATER", 0)
    docs = spark.createDataFrame([(1, "words and zqxunitzqx")], "doc_id long, text string")
    assert [r.exact for r in pieces.encode(docs).collect()] == [True]

    def held(batches):
        list(batches)
        from dossier.llm import pieces as there

        found = [u for v in there._LOADED.values() for u in v.units if "zqxunitzqx" in u]
        yield pa.record_batch([pa.array(found, pa.string())], ["unit"])

    assert spark.range(64, numPartitions=64).mapInArrow(held, "unit string").collect() == []


def test_a_lean_step_gives_free_memory_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def step(batches):
        blocks = [np.ones(12_500) for _ in range(3_000)]  # 300 MB, each block too small for a mapping of its own
        last.append(blocks[-1])
        blocks.clear()
        yield from batches

    last: list = []
    before = resident()
    assert list(lean(step)(iter([1, 2]))) == [1, 2]
    assert resident() < before + 100


def test_long_texts_come_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    long = small_batches(spark).range(0, 600, numPartitions=1).selectExpr("repeat('x', 50000) AS text")
    found = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 600 and max(r.size for r in found) < 3e6
