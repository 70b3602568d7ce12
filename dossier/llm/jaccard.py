"""Near copies: one document of each chain of texts with similar shingle sets stays.

No limit on differing fingerprint bits finds every pair of a given Jaccard, so nothing is left
out here by a hash: the sets are joined exactly, through the count-vector tree of ``rtree``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rtree
from .common import numbered, one_per_component


def near_copies(rows: DataFrame, percent: int = rtree.PERCENT, size: int = rtree.SHINGLE) -> DataFrame:
    """``row, component`` for every row of ``row, text``.

    Rows are in one component if a chain of texts, each with a Jaccard of at least ``percent``
    to the next, leads from one to the other. Texts without words, nulls among them, are copies
    of each other. Repeated rows are copies. An empty table gives no rows, other columns are
    not read. Numbers of components have no meaning.
    """
    return rtree.near_copies(rows, percent, size).select("row", "component")


def deduplicate(docs: DataFrame, percent: int = rtree.PERCENT, size: int = rtree.SHINGLE) -> DataFrame:
    """One document of each component of near copies stays, with all its columns.

    The smallest id stays (null last), then the smallest text. Rows count one by one, so null
    and repeated ids lose nothing; a table without rows stays empty; columns of any name are
    carried along.
    """
    kept, row = numbered(docs, "jaccard")
    return one_per_component(kept, row, near_copies(kept.select(F.col(row).alias("row"), "text"), percent, size))
