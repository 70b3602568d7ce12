import json

from pyspark.sql import functions as F

from dossier.operators import nested
from dossier.operators.marts import stat_cards
from dossier.operators.responses import conform

PEOPLE = "person_id long, personal_info struct<name string>, languages array<string>"


def people(spark, n):
    info = ", ".join(
        f"CAST(NULL AS STRING) AS {c}" for c in
        ("email", "phone", "location", "linkedin", "github", "website", "summary")
    )
    return spark.createDataFrame(
        [(i, (f"n{i}",), ["l"]) for i in range(n)], PEOPLE
    ).selectExpr("person_id", f"struct(personal_info.name AS name, {info}) AS personal_info", "languages")


def jobs(spark, rows):
    """(person, number) rows as experience entries."""
    return spark.createDataFrame(rows, "person_id long, n long").selectExpr(
        "person_id",
        "named_struct('ord', n, 'item', named_struct('company', concat('c', n), 'title', 't', "
        "'location', CAST(NULL AS STRING), 'start_date', CAST(NULL AS STRING), "
        "'end_date', CAST(NULL AS STRING), 'is_current', false, "
        "'responsibilities', array('r'))) AS experience",
    )


def pairs(spark, rows):
    return spark.createDataFrame(rows, "person_id long, section string, grp string, name string")


def test_people_without_children_get_empty_lists(spark):
    made = nested.assemble_resumes(
        people(spark, 3),
        [jobs(spark, [(1, 5), (1, 2), (9, 1)])],
        pairs(spark, [(2, "skills", "k", "b"), (2, "skills", "k", "a"), (2, "skills", "k", "a")]),
    )
    got = {r.person_id: r.resume for r in made.collect()}
    assert set(got) == {0, 1, 2}, "children of an unknown person are left out"
    assert got[0].experience == [] and got[0].skills == [] and got[0].education == []
    assert [e.company for e in got[1].experience] == ["c2", "c5"]
    assert [(s.category, s.skills) for s in got[2].skills] == [("k", ["a", "b"])]


def test_one_exchange_groups_the_record(spark):
    made = nested.assemble_resumes(
        people(spark, 3), [jobs(spark, [(1, 5)])], pairs(spark, [(2, "skills", "k", "b")])
    )
    plan = made._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Union")]
    assert top.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in top


def test_a_record_is_one_row_at_any_size(spark):
    """One person with 50,000 children, many names in few groups, against a plain model."""
    hot = [(0, i) for i in range(20_000)]
    cold = [(p, i) for p in range(1, 60) for i in range(5)]
    named = [(0, s, f"g{i % 3}", f"n{i}") for s in ("skills", "projects") for i in range(15_000)]
    made = nested.assemble_resumes(people(spark, 61), [jobs(spark, hot + cold)], pairs(spark, named)).cache()
    assert made.count() == 61
    record = made.filter("person_id = 0").first().resume
    assert [e.company for e in record.experience] == [f"c{i}" for i in range(20_000)]
    want = [(f"g{g}", sorted(f"n{i}" for i in range(g, 15_000, 3))) for g in range(3)]
    assert [(s.category, s.skills) for s in record.skills] == want
    assert [(p.name, p.technologies) for p in record.projects] == want
    cards = stat_cards(made, spark.createDataFrame([], "person_id long, profile struct<career_level string, profile_completeness struct<overall_score int>, total_years_experience double, inferred_job_roles array<string>>"))
    shown = cards.filter("person_id = 0").first()
    assert (shown.card_1, shown.card_2, shown.card_3, shown.card_4) == (
        "20000 roles", "15000 found", "3 listed", "0 entries",
    )
    flat = nested.flatten(made, "experience", ["person_id"]).filter("person_id = 0")
    assert sorted((r.pos, r.company) for r in flat.collect()) == [(i, f"c{i}") for i in range(20_000)]


def test_nest_skills_gives_one_row_per_person(spark):
    rows = [(1, f"c{i % 4}", f"s{i % 9973}") for i in range(50_000)] + [(2, "c", "x"), (2, "c", "x")]
    made = nested.nest_skills(spark.createDataFrame(rows, "person_id long, category string, skill string")).collect()
    got = {r.person_id: [(s.category, s.skills) for s in r.skills] for r in made}
    want = {c: sorted({s for p, k, s in rows if p == 1 and k == c}) for c in ("c0", "c1", "c2", "c3")}
    assert len(made) == 2 and got == {1: list(want.items()), 2: [("c", ["x"])]}


def test_one_pass_flattening_equals_the_others(spark):
    frame = spark.createDataFrame([(1, json.dumps(RECORD)), (2, "{}")], "id int, a string")
    made = conform(frame, "a", "resume")
    flat = nested.flatten_labels(made, {"experience": "company", "languages": "value"}, ["id"]).collect()
    assert sorted((r.section, r.pos, r.label) for r in flat) == [
        ("experience", 0, "a"), ("experience", 1, "b"), ("languages", 0, "de"), ("languages", 1, "fr"),
    ]
    inner = nested.flatten_inner_values(made, ["id"]).collect()
    assert sorted((r.section, r.pos, r.inner_pos, r.value) for r in inner) == [
        ("experience", 0, 0, "x"), ("experience", 0, 1, "y"), ("skills", 0, 0, "p"), ("skills", 0, 1, "q"),
    ]


RECORD = {
    "experience": [
        {"company": "a", "title": "t", "responsibilities": ["x", "y"]},
        {"company": "b", "title": "t"},
    ],
    "skills": [{"category": "k", "skills": ["p", "q"]}, {"category": "m", "skills": []}],
    "languages": ["de", "fr"],
}


def test_flatten_and_back(spark):
    frame = spark.createDataFrame([(1, json.dumps(RECORD)), (2, "{}")], "id int, a string")
    made = conform(frame, "a", "resume")
    flat = nested.flatten(made, "experience", ["id"])
    assert sorted((r.id, r.pos, r.company) for r in flat.collect()) == [(1, 0, "a"), (1, 1, "b")]
    inner = nested.flatten_inner(made, "experience", ["id"]).collect()
    assert sorted((r.pos, r.inner_pos, r.value) for r in inner) == [(0, 0, "x"), (0, 1, "y")]
    back = (
        nested.flatten(made, "skills", ["id"])
        .groupBy("id")
        .agg(F.expr("array_sort(collect_list(struct(pos, category, skills))) AS s"))
    )
    assert [(s.category, s.skills) for s in back.first().s] == [("k", ["p", "q"]), ("m", [])]
    words = nested.flatten(made, "languages", ["id"]).collect()
    assert sorted((r.pos, r.value) for r in words) == [(0, "de"), (1, "fr")]


def test_every_request_is_answered_or_listed(spark):
    resumes = conform(
        spark.createDataFrame([(i, "{}") for i in range(4)], "person_id int, a string"),
        "a", "resume",
    ).select("person_id", "resume")
    requests = resumes.selectExpr("concat('r', person_id) AS request_id", "person_id")
    answers = spark.createDataFrame([("r1", "p"), ("r3", "p"), ("r9", "p")], "request_id string, profile string")
    joined, missing = nested.attach_resume(answers, requests, resumes)
    assert sorted(r.request_id for r in joined.collect()) == ["r1", "r3"]
    assert sorted(r.request_id for r in missing.collect()) == ["r0", "r2"]
    assert "original_resume" in joined.columns


def test_one_exchange_for_repeats_and_groups(spark):
    """Pairs go to their person's place once; lists are sorted natively, not by a function per comparison."""
    people = spark.sql("SELECT 1L AS person_id, array('en') AS languages")
    pairs = spark.createDataFrame([(1, "skills", "g", n) for n in "bab"], "person_id long, section string, grp string, name string")
    made = nested.assemble_resumes(people.selectExpr("person_id", "named_struct('name', 'A', 'email', '', 'phone', '', "
        "'location', '', 'linkedin', '', 'github', '', 'website', '', 'summary', '') AS personal_info", "languages"), [], pairs)  # fmt: skip
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "lambdafunction(if" not in plan
    assert [(g.category, g.skills) for g in made.first().resume.skills] == [("g", ["a", "b"])]
