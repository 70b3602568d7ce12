"""Near copies for the corpus: fingerprints find them first, shingle sets add what bits lose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, simhash
from .common import Stored, numbered, one_per_component, scratch
from .components import components


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies stays, with all its columns.

    Two texts are linked if their SimHash fingerprints differ in at most three bits
    (``simhash``), or if their sets of five-word shingles reach a Jaccard of 0.8 (``jaccard``):
    pairs at that limit differ in more bits than any index of fingerprints can look for. A
    group is what links of both kinds connect. Rows count one by one; the smallest id stays
    (null last), then the smallest text.
    """
    kept, row = numbered(docs, "copies")
    rows = kept.select(F.col(row).alias("row"), "text")
    store = Stored(docs.sparkSession, "links")
    with scratch():
        marked = simhash.near_duplicates(rows.withColumnRenamed("row", "doc_id"))
        by_bits = store.write(marked.filter("doc_id <> component_id").selectExpr("doc_id AS a", "component_id AS b"))
    with scratch():
        found = store.write(jaccard.near_copies(rows))
    least = found.groupBy("component").agg(F.min("row").alias("b"))
    by_sets = found.join(least, "component").filter("row <> b").selectExpr("row AS a", "b")
    linked = components(by_bits.unionByName(by_sets)).withColumnRenamed("node", "row")
    groups = rows.select("row").join(linked, "row", "left").select("row", F.coalesce("component", "row").alias("component"))
    out = one_per_component(kept, row, groups)
    store.drop(by_bits, found)
    return out
