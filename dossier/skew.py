"""Keys that hold a large share of the rows.

Aggregates with a partial step cope with such keys by themselves, and adaptive execution
splits skewed joins of two plain shuffles. A join of rows with an aggregate of the same rows
is not split by it: there the rows get a salt, and the narrow aggregate is repeated for every
salt. The plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key's rows meet their group's size in this many places; a power of two. The salt is cut
# out by bits, which is never null, so that no filter on it keeps the exchange from being reused.
SALTS = 32


def with_group_size(rows: DataFrame, keys: list[str], spread: str, out: str) -> DataFrame:
    """Add the number of rows that share ``keys``, as a window count would. Keys are not null.

    ``spread`` is the column whose hash salts the rows. Sizes are counted with a partial
    aggregate and joined back. ``rows`` is read twice: give it an exchange of its own
    (``repartition``), which Spark then reuses.
    """
    rows = rows.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = rows.withColumn("_salt", F.xxhash64(spread).bitwiseAND(SALTS - 1).cast("int"))
    return salted.join(sizes.select("*", salts), [*keys, "_salt"]).drop("_salt")
