"""License notices wrapped over lines or inside long lines, against brute force over runs of words."""

import textwrap

import numpy as np
import pytest

from dossier.llm import licenses, queries

WRAPPED = ["notice-mit", "notice-gpl-header", "notice-bsd", "notice-apache-2.0-header"]


@pytest.mark.parametrize("width", [30, 60, 76])
def test_wrapped_notices(spark, tmp_path, width):
    rows = []
    for k, label in enumerate(WRAPPED):
        notice = textwrap.fill(licenses.TEMPLATES[label].capitalize() + ".", width)
        comment = "\n".join(f" * {line}" for line in notice.split("\n"))
        rows += [(2 * k, f"Some code\n\n{notice}\n\nmore text"), (2 * k + 1, f"/*\n{comment}\n */")]
    words = licenses.TEMPLATES["notice-mit"].split()
    rows.append((100, "\n".join(x + " other" * 40 for x in words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.op10_licenses(spark, str(tmp_path)).collect()}
    for k, label in enumerate(WRAPPED):
        for row in (found[2 * k], found[2 * k + 1]):
            assert label in row.labels.split(",") and row.score == 1.0
    assert found[100].labels == ""


def test_runs_are_exact():
    rng = np.random.default_rng(4)
    vocabulary = [b"w%d" % i for i in range(25)]
    for _ in range(400):
        members = frozenset(rng.choice(vocabulary, size=6, replace=False).tolist())
        w = rng.choice(vocabulary, size=rng.integers(0, 60)).tolist()
        need, length = int(rng.integers(2, 6)), int(rng.integers(6, 12))
        shares = [len(members.intersection(w[i : i + length])) for i in range(len(w))]
        got = licenses.best_runs(w, members, need, length)
        assert bool(got) == (max(shares, default=0) >= need)
        assert max((g[2] for g in got), default=0) == (max(shares, default=0) if got else 0)


def plain_scan(text):
    """Labels and score of the registered form, from every run of every length a template allows."""
    w = licenses.split_words((text or "").lower().encode())
    line = b" " + b" ".join(w) + b" "
    labels = {v for k, v in licenses.PHRASES.items() if b" " + b" ".join(licenses.split_words(k.encode())) + b" " in line}
    score = 1.0 if labels else 0.0
    for label, template in licenses.TEMPLATES.items():
        words = licenses.split_words(template.encode())
        members, length = set(words), int(len(words) / licenses.CONTAINMENT + 1e-9)
        best = max((len(members & set(w[i : i + length])) for i in range(len(w))), default=0) / len(members)
        if best >= licenses.CONTAINMENT - 1e-9:
            labels.add(label)
            score = max(score, best)
    return ",".join(sorted(labels)), score


def test_long_lines_are_judged_by_their_runs(spark, tmp_path):
    """One line of thousands of words: strewn template words are no notice, a dense run is one."""
    rng = np.random.default_rng(11)
    rows = [(0, None), (1, ""), (2, "  \n ")]
    for label in licenses.TEMPLATES:
        words = licenses.TEMPLATES[label].split()
        rows.append((len(rows), " ".join(x + " other" * 400 for x in words)))
        rows.append((len(rows), "other " * 900 + " ".join(words) + " other" * 900))
        for gap in (1, 2, 3):
            mixed = [y for x in words for y in [x, *["other"] * int(rng.integers(0, gap + 1))]]
            rows.append((len(rows), "other " * 50 + " ".join(mixed) + " other" * 50))
            kept = [x for x in mixed if rng.random() > 0.15]
            rows.append((len(rows), "other " * 20 + " ".join(kept).replace("the", "the\n")))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.labels, r.score) for r in queries.op10_licenses(spark, str(tmp_path)).collect()}
    assert found == {k: plain_scan(text) for k, text in rows}
    strewn = found[3 + 8 * list(licenses.TEMPLATES).index("notice-mit")]
    assert strewn == ("", 0.0)
    assert sum(bool(labels) for labels, _ in found.values()) > len(licenses.TEMPLATES)
