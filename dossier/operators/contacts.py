"""Contact details found in text by rule (e-mail and phone only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import with_group_size

# A find begins where the last one ended or where no such character stands before it, and no
# part gives characters back: the search is linear in the length of any run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# Country code, area in brackets, number. Looser shapes also hit addresses and card numbers.
PHONE = r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"


def contacts(docs: DataFrame) -> DataFrame:
    """One row per (document, kind, value) with the number of documents that share it.

    Repeats inside a document are dropped within its row. The narrow finds are hashed by
    all three columns once, so each text is searched a single time and a value that a
    third of all documents share is spread over all tasks.
    """

    def found(kind: str, pattern: str):
        values = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    finds = (
        docs.select(
            "doc_id", F.explode(F.concat(found("email", EMAIL), found("phone", PHONE))).alias("f")
        )
        .select("doc_id", "f.kind", "f.value")
        .repartition("doc_id", "kind", "value")
    )
    return with_group_size(finds, ["kind", "value"], "doc_id", "n_docs")
