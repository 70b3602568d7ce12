"""License scans: fixed phrases, and an exact set-similarity join with license templates."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, column_named

# Phrases looked for and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Templates of license notices; labels of the similarity join.
TEMPLATES = {
    "notice-apache-2.0": "licensed under the apache license version 2.0",
    "notice-apache-2.0-header": (
        "licensed under the apache license version 2.0 the license you may not use this file "
        "except in compliance with the license"
    ),
    "notice-cc-by": "licensed under cc by",
    "notice-gpl": "this work is licensed under the gnu general public license version",
    "notice-gpl-header": (
        "this program is free software you can redistribute it and or modify it under the terms of "
        "the gnu general public license as published by the free software foundation"
    ),
    "notice-mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files"
    ),
    "notice-bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met"
    ),
    "notice-mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "notice-reserved": "copyright all rights reserved",
}

# Share of a template's words that a text block must hold.
CONTAINMENT = 0.8


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def template_sets(templates: dict[str, str]) -> dict[str, frozenset[bytes]]:
    """Word set of each template; templates are part of the call, so they are small."""
    sets = {label: frozenset(split_words(text.encode())) for label, text in templates.items()}
    if not all(sets.values()):
        raise ValueError("a template without words")
    return sets


def word_counts(docs: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How often each wanted word occurs in all texts. One row per word comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total.update(filter(wanted.__contains__, split_words(text.as_py() or b"")))
        yield pa.record_batch([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["w", "n"])

    rows = column_named(docs, "text").mapInArrow(count, "w binary, n long")
    found = {bytes(r.w): r.n for r in rows.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in wanted}


class TemplateIndex:
    """Templates under a global word order, rare words first, with an index of their prefixes.

    A block that holds ``need`` words of a template must share one of its first
    ``size - need + 1`` words (prefix filter), must hold at least ``need`` known words
    (length filter), and from a shared word on there must be enough words left on both
    sides (positional filter). What passes is compared in full, so nothing is missed.
    """

    def __init__(self, sets: dict[str, frozenset[bytes]], counts: dict[bytes, int], share: float):
        order = sorted(counts, key=lambda w: (counts[w], w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.sets, self.need, self.prefix = {}, {}, {}
        for label, members in sets.items():
            ranked = sorted(self.rank[w] for w in members)
            # The smallest number of words with need / size >= share.
            need = next(k for k in range(1, len(ranked) + 1) if k >= share * len(ranked) - 1e-9)
            self.sets[label], self.need[label] = frozenset(ranked), need
            for at, r in enumerate(ranked[: len(ranked) - need + 1]):
                self.prefix.setdefault(r, []).append((label, at))
        self.least = min(self.need.values())

    def matches(self, block: list[bytes]) -> dict[str, float]:
        """Templates that the block contains, with the share of their words."""
        held = sorted({self.rank[w] for w in block if w in self.rank})
        if len(held) < self.least:
            return {}
        out, tried = {}, set()
        for j, r in enumerate(held):
            for label, at in self.prefix.get(r, ()):
                need, size = self.need[label], len(self.sets[label])
                # At the first shared prefix word nothing earlier is shared.
                if label in tried or len(held) < need:
                    continue
                tried.add(label)
                if 1 + min(size - at - 1, len(held) - j - 1) < need:
                    continue
                both = len(self.sets[label].intersection(held))
                if both >= need:
                    out[label] = both / size
        return out


def phrase_places(w: list[bytes], phrases: list[tuple[list[bytes], str]]) -> tuple[list[int], set[str]]:
    """Starts of all places where a phrase's words stand consecutively, and the labels found."""
    at, labels = [], set()
    line = b" " + b" ".join(w) + b" "
    for phrase, label in phrases:
        needle = b" " + b" ".join(phrase) + b" "
        if needle not in line:
            continue
        labels.add(label)
        at += [i for i, x in enumerate(w) if x == phrase[0] and w[i : i + len(phrase)] == phrase]
    return at, labels


def run_lengths(templates: dict[str, str], share: float) -> dict[str, int]:
    """Words of the longest run that counts as a notice: the template fills ``share`` of it."""
    return {label: int(len(split_words(t.encode())) / share + 1e-9) for label, t in templates.items()}


def best_runs(w: list[bytes], members: frozenset[bytes], need: int, length: int) -> list[tuple[int, int, int]]:
    """Runs of up to ``length`` words that hold ``need`` of ``members``, wherever they start.

    ``(first word, last word, members held)``; of runs that overlap the one that holds most,
    then the first. A run that begins and ends with a member stands for all around it.
    """
    places = [i for i, x in enumerate(w) if x in members]
    out: list[tuple[int, int, int]] = []
    held: Counter[bytes] = Counter()
    lo = 0
    for i in places:
        held[w[i]] += 1
        while places[lo] <= i - length:
            held[w[places[lo]]] -= 1
            if not held[w[places[lo]]]:
                del held[w[places[lo]]]
            lo += 1
        if len(held) >= need:
            run = (places[lo], i, len(held))
            if not out or out[-1][1] < run[0]:
                out.append(run)
            elif run[2] > out[-1][2]:
                out[-1] = run
    return out


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, blocks array<struct<block:int,label:string,share:double>>"
)


def scan(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
    runs: bool = False,
) -> DataFrame:
    """Licenses of every document: ``doc_id`` and the columns of ``RESULT``.

    Base labels come from phrases in the running words; the other labels from text blocks
    (lines) that hold at least ``containment`` of a template's distinct words. With ``runs``
    blocks are also the runs of words across line breaks, from every word on, as long as
    ``run_lengths`` says, so that wrapped notices are found, and a line longer than that is
    judged by the runs in it alone: words strewn over a long line are no notice. ``score`` is
    1 where a phrase stands, else the best share found, else 0. ``blocks`` lists the matches
    by line, a run by the line it begins in; a run over a line that matches itself only raises
    its share. Null and empty texts have no words and no labels; repeated rows are scanned one
    by one; an empty table gives no rows. Columns but ``doc_id`` and ``text`` are not read, so
    their names may be any.
    Words are counted over all texts first, then each text is read once; documents are
    neither shuffled nor paired with each other, and the index is as small as the templates.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    sets = template_sets(templates)
    lengths = run_lengths(templates, containment)
    known = set().union(*sets.values())
    index = TemplateIndex(sets, word_counts(docs, known), containment)
    wanted = [(split_words(p.encode()), label) for p, label in phrases.items()]
    rows = column_named(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {RESULT}"
    match = pa.struct([("block", pa.int32()), ("label", pa.string()), ("share", pa.float64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(match)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    rare = min(index.need.values())

    def with_runs(w: list[bytes], starts: list[int], blocks: list[tuple]) -> list[tuple]:
        ends = [*starts[1:], len(w)]
        # A line longer than a template's runs is judged by the runs in it alone.
        found = {
            (block, label): share for block, label, share in blocks if ends[block] - starts[block] <= lengths[label]
        }
        # A text that does not hold a template's words has no run that does.
        for label in index.matches(w):
            for first, last, held in best_runs(w, sets[label], index.need[label], lengths[label]):
                lines = range(bisect_right(starts, first) - 1, bisect_right(starts, last))
                own = next((k for k in lines if (k, label) in found), lines[0])
                found[own, label] = max(found.get((own, label), 0.0), held / len(sets[label]))
        return sorted((block, label, share) for (block, label), share in found.items())

    def judge(text: bytes) -> tuple:
        n, running, blocks, starts = 0, [], [], []
        for block, line in enumerate(text.split(b"\n")):
            w = split_words(line)
            starts.append(n)
            n += len(w)
            running += w
            if len(w) >= rare:
                blocks += [(block, label, share) for label, share in sorted(index.matches(w).items())]
        if runs:
            blocks = with_runs(running, starts, blocks)
        at, labels = phrase_places(running, wanted)
        every = sorted(labels | {b[1] for b in blocks})
        score = 1.0 if at else max((b[2] for b in blocks), default=0.0)
        ends = (min(at), max(at)) if at else (None, None)
        found = [dict(zip(("block", "label", "share"), b, strict=True)) for b in blocks]
        return n, len(at), *ends, ",".join(sorted(labels)), ",".join(every), score, found

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else None
            if cols:
                yield pa.record_batch([batch.column(0), *cols], ["doc_id", *names])

    return rows.mapInArrow(scanned, schema)
