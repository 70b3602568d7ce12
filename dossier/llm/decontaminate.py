"""Benchmark decontamination by word n-grams, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_named, free_name, numbered, words

WINDOW = 10

# Most benchmark n-grams that are sent to every task as hash sets. A larger benchmark is met
# by a join on the n-gram itself; both ways give the same rows.
MAX_SET = 20_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Lambdas would compute a column anew per element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _gram_hashes(hashes: Column, length: int, body: Callable[[Column], Column]) -> Column:
    """``body`` of the hashes of ``length`` words from each position on; those past the end are junk.

    Hashes of 2, 4 and 8 words are put together from halves, so a word is hashed once.
    """
    size = F.greatest(F.size(hashes), F.lit(1))

    def mix(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    def step(power: Column, width: int, parts: tuple) -> Column:
        parts = ((width, power), *parts) if length & width else parts
        if 2 * width <= length:
            doubled = mix(power, F.slice(power, width + 1, size))
            return _let(doubled, lambda p: step(p, 2 * width, parts))
        out, covered = parts[0][1], parts[0][0]
        for width, power in parts[1:]:
            out = mix(out, F.slice(power, covered + 1, size))
            covered += width
        return body(out)

    return step(hashes, 1, ())


def item_grams(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, gram, length`` for every window of every item; an item without words has none."""
    found = column_named(items, "item_id", "text").select("item_id", words(F.col("text")).alias("w"))
    found = found.filter(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at")
    return found.select("item_id", "w", "length", starts).select(
        "item_id", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("gram"), "length"
    )


HIT = "array<struct<pos:int,length:int,gram:string>>"


def _windows(w: Column, length: int, starts: Column) -> Column:
    return F.transform(
        starts,
        lambda i: F.struct(
            i.cast("int").alias("pos"),
            F.lit(length).alias("length"),
            F.array_join(F.slice(w, i + 1, length), " ").alias("gram"),
        ),
    )


def _every(w: Column, length: int) -> Column:
    """All windows of a length."""
    last = F.size(w) - length
    return _windows(w, length, F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")))


def _wanted(w: Column, hashes: Column, length: int, wanted: list[int], texts: list[str]) -> Column:
    """Windows whose hash, and then whose words, are among the given ones."""

    def found(grams: Column) -> Column:
        last = F.size(w) - length
        marked = F.transform(grams, lambda h, i: F.when(h.isin(wanted) & (i <= last), i).otherwise(F.lit(-1)))
        seen = _windows(w, length, F.filter(marked, lambda i: i >= 0))
        return F.filter(seen, lambda x: x.gram.isin(texts))

    return _gram_hashes(hashes, length, found)


def found_windows(docs: DataFrame, grams: DataFrame, max_set: int = MAX_SET) -> tuple[DataFrame, bool]:
    """``docs`` with ``_found``, a struct of ``n_words`` and ``hits``; and whether hits are exact.

    If the benchmark's n-grams fit, their hashes are looked up inside each row and what is
    found is compared as text, so only true hits remain. Otherwise ``hits`` holds every
    window, to be joined with the n-grams.
    """
    lengths = sorted(r.length for r in grams.select("length").distinct().collect())
    known = grams.select("gram", "length").distinct().limit(max_set + 1).collect()
    fits = len(known) <= max_set
    sets: dict[int, tuple[list[int], list[str]]] = {}
    if fits:
        parts = F.transform(F.split("gram", " "), lambda x: F.xxhash64(x))
        for n in lengths:
            first = _gram_hashes(F.col("h"), n, lambda g: F.get(g, F.lit(0)))
            own = grams.filter(F.col("length") == n).withColumn("h", parts).select(first.alias("x")).distinct()
            sets[n] = [r.x for r in own.collect()], [r.gram for r in known if r.length == n]

    def judged(w: Column) -> Column:
        if not lengths:
            hits = F.array()
        elif fits:
            hits = _let(
                F.transform(w, lambda x: F.xxhash64(x)),
                lambda h: F.concat(*[_wanted(w, h, n, *sets[n]) for n in lengths]),
            )
        else:
            hits = F.concat(*[_every(w, n) for n in lengths])
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.cast(HIT).alias("hits"))

    return docs.withColumn(free_name(docs, "_found"), _let(words(F.col("text")), judged)), fits


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """Rows of ``row, doc_id, n_words, pos, length, items``; one with nulls for a clean document."""
    grams = (
        item_grams(items, window).groupBy("gram", "length").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    rows, fits = found_windows(column_named(docs, "doc_id", "text"), grams, max_set)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "_found")
    rows = rows.select("row", "doc_id", "_found.n_words", F.explode_outer("_found.hits").alias("hit"))
    rows = rows.select("row", "doc_id", "n_words", "hit.*")
    return rows.join(F.broadcast(grams) if fits else grams, ["gram", "length"], "left").drop("gram")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` per document.

    ``spans`` are the found windows (first word, number of words). A null or empty text has no
    words and is clean; repeated rows are judged one by one; an empty benchmark hits nothing.
    """
    found = F.col("items").isNotNull()
    span = F.when(found, F.struct("pos", "length"))
    grouped = (
        hits(docs, items, window, max_set)
        .groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.sort_array(F.collect_list(span)).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("ids"),
        )
    )
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s.pos, s.pos + s.length - 1)))
    names = F.array_sort(F.transform("ids", lambda i: i.cast("string")))
    return grouped.withColumn("n_hit", F.size(F.array_distinct(covered)).cast("long")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """Documents without a benchmark window, with all their columns; null texts are clean.

    Columns of any name are kept as they are; an empty table stays empty.
    """
    grams = item_grams(items, window).select("gram", "length").distinct()
    rows, fits = found_windows(docs, grams, max_set)
    if fits:
        hits = F.col(f"`{rows.columns[-1]}`").getField("hits")
        return rows.filter(F.size(hits) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    kept, row = numbered(docs, "decontaminate")
    windows = found_windows(kept.select(F.col(row).alias("n"), "text"), grams, max_set)[0]
    bad = windows.select("n", F.explode("_found.hits").alias("hit")).select("n", "hit.*")
    bad = bad.join(grams, ["gram", "length"], "left_semi").select(F.col("n").alias(row)).distinct()
    return kept.join(bad, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text`` where hit words are gone and the words left are joined by one space.

    For corpora where losing a whole document is too much. Words are those of the word rule.
    """
    kept, row = numbered(column_named(docs, "doc_id", "text"), "decontaminate")
    # Judged under the row number, so null and repeated ids keep to their own spans.
    judged = contamination(kept.select(F.col(row).alias("doc_id"), "text"), items, window)
    rows = kept.join(judged.select(F.col("doc_id").alias(row), "spans"), row)
    w = words(F.col("text"))
    left = F.filter(w, lambda x, i: ~F.exists("spans", lambda s: (i >= s.pos) & (i < s.pos + s.length)))
    return rows.select("doc_id", F.array_join(left, " ").alias("text"))
