"""Flat tables to nested records and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LIST_SECTIONS, RESUME, column_type

# Lists inside a list section.
INNER_LISTS = {
    "experience": "responsibilities",
    "projects": "technologies",
    "skills": "skills",
}


def nest_skills(rows: DataFrame, key: str = "person_id") -> DataFrame:
    """Flat (person, category, skill) to one list of categories per person.

    Repeats are dropped by a partial aggregate before anything is shuffled, and categories
    are grouped before persons are.
    """
    return (
        rows.select(key, "category", "skill")
        .distinct()
        .groupBy(key, "category")
        .agg(F.expr("array_sort(collect_list(skill)) AS skills"))
        .groupBy(key)
        .agg(F.expr("array_sort(collect_list(struct(category, skills))) AS skills"))
    )


# Sections built from (group, name) pairs: an entry per group that lists its names.
GROUPED = {
    "skills": "named_struct('category', grp, 'skills', names)",
    "projects": (
        "named_struct('name', grp, 'description', CAST(NULL AS STRING), 'technologies', names, "
        "'url', CAST(NULL AS STRING), 'start_date', CAST(NULL AS STRING), "
        "'end_date', CAST(NULL AS STRING))"
    ),
}


def assemble_resumes(
    people: DataFrame,
    children: list[DataFrame],
    pairs: DataFrame,
    key: str = "person_id",
) -> DataFrame:
    """One resume per person from child tables; a person without children gets [].

    ``people`` holds ``key, personal_info, languages``. ``children`` hold ``key`` and a
    column ``struct<ord, item>`` for one or more list sections, null where a row has no
    such entry; ``people`` may bring such columns too. ``pairs`` holds ``key, section,
    grp, name`` for the sections in :data:`GROUPED`.

    All rows are stacked and grouped once, so the whole record costs one exchange
    instead of a join per section. Children of an unknown person are left out. Groups of
    pairs are nested first, so what meets last is one entry per child or group.
    """
    owners = people.withColumn("owner", F.struct("personal_info", "languages")).drop(
        "personal_info", "languages"
    )
    direct = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), children, owners)
    # Repeats and groups lie in one place with their person, so one exchange serves both steps.
    named = (
        pairs.select(key, "section", "grp", "name")
        .repartition(key)
        .distinct()
        .groupBy(key, "section", "grp")
        .agg(F.expr("sort_array(collect_list(name)) AS names"))
        .selectExpr(
            key,
            *[
                f"CASE WHEN section = '{s}' THEN named_struct('ord', grp, 'item', {item}) END AS {s}"
                for s, item in GROUPED.items()
            ],
        )
    )
    stacked = direct.unionByName(named, allowMissingColumns=True)
    lists = [s for s in LIST_SECTIONS if s in stacked.columns]
    grouped = stacked.groupBy(key).agg(
        F.expr("first(owner, true) AS owner"),
        *[F.expr(f"sort_array(collect_list({s})) AS {s}") for s in lists],
    )

    def column(field: T.StructField) -> str:
        kind = column_type(field.dataType).simpleString()
        value = "CAST(array() AS " + kind + ")"
        if field.name in lists:
            value = f"CAST(transform({field.name}, x -> x.item) AS {kind})"
        elif field.name == "personal_info":
            value = f"CAST(owner.personal_info AS {kind})"
        elif field.name == "languages":
            value = "owner.languages"
        return f"'{field.name}', {value}"

    record = ", ".join(column(f) for f in RESUME.fields)
    return grouped.filter("owner IS NOT NULL").selectExpr(
        key, f"named_struct({record}) AS resume"
    )


def flatten(resumes: DataFrame, section: str, keys: list[str], record: str = "resume") -> DataFrame:
    """Child table of a list section with the position of each entry.

    An empty list gives no rows. Text lists give the column ``value``.
    """
    if section not in LIST_SECTIONS:
        raise ValueError(f"not a list section: {section}")
    item = RESUME[section].dataType.elementType
    exploded = resumes.select(
        *keys, F.posexplode(F.col(record).getField(section)).alias("pos", "item")
    )
    if isinstance(item, T.StructType):
        return exploded.select(*keys, "pos", "item.*")
    return exploded.withColumnRenamed("item", "value")


def flatten_labels(resumes: DataFrame, labels: dict[str, str], keys: list[str], record: str = "resume") -> DataFrame:
    """``section, pos, label`` of the entries of several sections, in one pass over the records.

    ``labels`` names the field that is shown for each section; any name for text lists.
    """
    parts = []
    for section, label in labels.items():
        text = isinstance(RESUME[section].dataType.elementType, T.StringType)
        field = "x" if text else f"x.`{label}`"
        parts.append(
            f"transform({record}.{section}, (x, i) -> named_struct('section', '{section}', "
            f"'pos', i, 'label', CAST({field} AS STRING)))"
        )
    return resumes.select(*keys, F.expr(f"inline(concat({', '.join(parts)}))"))


def flatten_inner_values(resumes: DataFrame, keys: list[str], record: str = "resume") -> DataFrame:
    """``section, pos, inner_pos, value`` of all lists inside sections, in one pass."""
    parts = [
        f"flatten(transform({record}.{section}, (x, i) -> transform(x.{inner}, (v, j) -> "
        f"named_struct('section', '{section}', 'pos', i, 'inner_pos', j, 'value', v))))"
        for section, inner in INNER_LISTS.items()
    ]
    return resumes.select(*keys, F.expr(f"inline(concat({', '.join(parts)}))"))


def flatten_inner(
    resumes: DataFrame, section: str, keys: list[str], record: str = "resume"
) -> DataFrame:
    """Entries of the list inside a section, with the position at both levels."""
    inner = INNER_LISTS[section]
    outer = resumes.select(
        *keys, F.posexplode(F.col(record).getField(section)).alias("pos", "item")
    )
    return outer.select(
        *keys, "pos", F.posexplode(F.col("item").getField(inner)).alias("inner_pos", "value")
    )


def attach_resume(
    answers: DataFrame, requests: DataFrame, resumes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Give every accepted profile the resume its request was made from.

    ``answers`` holds ``request_id, profile``; ``requests`` holds ``request_id`` and the
    resume's keys. Returns the joined rows with ``original_resume``, and the requests
    without an answer. An ``original_resume`` written by the model never survives,
    because the typed profile has no such field.
    """
    keys = [c for c in requests.columns if c in resumes.columns]
    asked = requests.select("request_id", *keys)
    attached = asked.join(answers, "request_id").join(
        resumes.withColumnRenamed("resume", "original_resume"), keys
    )
    unanswered = asked.join(answers.select("request_id"), "request_id", "left_anti")
    return attached, unanswered


def with_raw_text(rows: DataFrame, texts: DataFrame, key: str, record: str = "resume") -> DataFrame:
    """Add ``raw_text`` as the last field of a record, null where there is no text.

    ``texts`` holds ``key, text``, one row per key. Texts are joined last, so that they
    take no part in earlier shuffles.
    """
    joined = rows.join(texts.select(key, F.col("text").alias("_text")), key, "left")
    return joined.withColumn(
        record, F.struct(f"{record}.*", F.col("_text").alias("raw_text"))
    ).drop("_text")
