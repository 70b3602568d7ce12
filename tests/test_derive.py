import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from dossier.functions import display
from dossier.functions.dates import loose_date
from dossier.operators import audits, derive, marts
from dossier.operators.responses import conform

DATES = {
    "2020-03-04": date(2020, 3, 4), "2020-03": date(2020, 3, 1), "03/2021": date(2021, 3, 1),
    "Mar 2021": date(2021, 3, 1), "March 2021": date(2021, 3, 1), "May 2021": date(2021, 5, 1),
    "2021": date(2021, 1, 1), "2020-13-01": None, "13/2021": None, "garbage": None, "": None,
    "2020-02-30": None, "Present": None, "Foo 2020": None,
}


def test_dates(spark):
    frame = spark.createDataFrame([(t,) for t in DATES], "t string")
    assert {r.t: r.d for r in frame.withColumn("d", loose_date(F.col("t"))).collect()} == DATES


def brute_years(entries, as_of):
    days, used, periods = set(), 0, []
    for start, end, current in entries:
        s = DATES.get(start) or (date.fromisoformat(start) if start and start[4:5] == "-" and len(start) == 10 else None)
        e = date.fromisoformat(end) if end else (as_of if current else None)
        if s is None or e is None or e < s:
            continue
        used += 1
        periods.append((s, e))
        days |= {s + timedelta(i) for i in range((e - s).days)}
    merged = 0
    reach = None
    for s, e in sorted(periods):
        if reach is None or s > reach:
            merged += 1
        reach = e if reach is None else max(reach, e)
    return len(entries), len(entries) - used, merged, len(days)


def test_years_equal_brute_force(spark):
    rng = random.Random(5)
    as_of, rows, want = date(2001, 8, 1), [], {}
    for person in range(25):
        entries = []
        for _ in range(rng.choice((1, 2, 8, 40))):
            s = date(1995, 1, 1) + timedelta(rng.randrange(2000))
            e = s + timedelta(rng.randrange(-20, 200))
            current = rng.random() < 0.1
            start = rng.choice((s.isoformat(), s.isoformat(), s.isoformat(), "garbage", None))
            entries.append((start, None if current else e.isoformat(), current))
        rows += [(person, *e) for e in entries]
        want[person] = brute_years(entries, as_of)
    frame = spark.createDataFrame(
        rows, "person_id int, start_date string, end_date string, is_current boolean"
    )
    got = {r.person_id: r for r in derive.years_experience(frame, as_of).collect()}
    assert {
        p: (r.n_entries, r.n_ignored, r.n_periods, r.days) for p, r in got.items()
    } == want
    assert all(abs(r.years - r.days / 365.25) <= 0.0501 for r in got.values())


def test_window_of_years_sees_one_row_per_day(spark):
    """A person with a third of all entries is reduced before the window."""
    rows = [(1, "2000-01-01", "2000-02-01", False)] * 500 + [(2, "2000-01-01", None, True)] * 3
    frame = spark.createDataFrame(
        rows, "person_id int, start_date string, end_date string, is_current boolean"
    )
    made = derive.years_experience(frame, date(2000, 1, 11))
    assert {r.person_id: (r.n_entries, r.days) for r in made.collect()} == {1: (500, 31), 2: (3, 10)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("partial_max")


def test_display_rules(spark):
    rows = [
        ("2020", "2021", True, "2020 – 2021"), ("2020", "", True, "2020 – Present"),
        (None, None, True, " – Present"), (None, None, False, ""), ("", "2021", False, " – 2021"),
        ("2020", None, None, "2020"),
    ]
    frame = spark.createDataFrame(rows, "s string, e string, c boolean, want string")
    made = frame.withColumn("got", display.date_span(F.col("s"), F.col("e"), F.col("c")))
    assert all(r.got == r.want for r in made.collect())

    rows = [
        ("a", "b", "c", "a · b · T: c"), ("", "b", "", "b"), (None, "", "c", " · T: c"),
        ("a", None, None, "a"), (None, None, None, ""),
    ]
    frame = spark.createDataFrame(rows, "a string, b string, t string, want string")
    made = frame.withColumn("got", display.meta_line([F.col("a"), F.col("b")], "T", F.col("t")))
    assert all(r.got == r.want for r in made.collect())

    links = {"http://a": "http://a", "httpfoo.org": "httpfoo.org", "Http://a": "https://Http://a",
             "a.org": "https://a.org", "": None, None: None}
    frame = spark.createDataFrame([(u,) for u in links], "u string")
    assert {r.u: r.l for r in frame.withColumn("l", display.link(F.col("u"))).collect()} == links

    names = [("N", "e@x", "N", "N"), ("", "a@b@c", "a", "A"), (None, "@x", "there", "T"),
             (None, None, "there", "T"), ("éa", None, "éa", "É")]
    frame = spark.createDataFrame(names, "full_name string, email string, n string, a string")
    assert all(
        (r.display_name, r.avatar) == (r.n, r.a)
        for r in marts.identity(frame, ["n", "a"]).collect()
    )

    numbers = {3.0: "3", 3.5: "3.5", 0.0: "0", 0.1: "0.1", 12345678.0: "12345678"}
    frame = spark.createDataFrame([(v,) for v in numbers], "v double")
    got = {r.v: r.s for r in frame.withColumn("s", display.plain_number(F.col("v"))).collect()}
    assert got == numbers

    errors = [("p", "s", "p"), ("", "s", "s"), (None, "", "d"), (None, None, "d")]
    frame = spark.createDataFrame(errors, "p string, s string, want string")
    made = frame.withColumn("g", display.error_text(F.col("p"), F.col("s"), F.lit("d")))
    assert all(r.g == r.want for r in made.collect())


ROLE = '{"title":"%s","confidence":"%s","reasoning":"r"}'


def profiles(spark, roles, level="Mid"):
    listed = ",".join(ROLE % r for r in roles)
    text = f'{{"inferred_job_roles":[{listed}],"career_level":"{level}","key_strengths":["a"],' \
        '"profile_completeness":{"overall_score":1},"skill_categories":' \
        '[{"category":"c","proficiency_level":"Guru"},{"category":"d","proficiency_level":"Expert"}]}'
    return conform(spark.createDataFrame([(1, text)], "id int, a string"), "a", "profile")


def test_roles_ranked_with_stable_ties(spark):
    made = profiles(spark, [("a", "Low"), ("b", "High"), ("c", "?"), ("d", "high"), ("e", "Medium")])
    ranked = sorted(derive.rank_roles(made, ["id"]).collect(), key=lambda r: r.rank)
    assert [r.title for r in ranked] == ["b", "d", "e", "a", "c"]
    assert [r.given_pos for r in ranked] == [2, 4, 5, 1, 3]
    assert derive.rank_roles(made, ["id"], top=2).count() == 2


def test_audits(spark):
    made = profiles(spark, [("a", "Low"), ("b", "Sure"), ("c", "Sure")], "Wizard")
    assert {(r.field, r.value, r.n) for r in audits.domain_audit(made).collect()} == {
        ("confidence", "Sure", 2), ("career_level", "Wizard", 1), ("proficiency_level", "Guru", 1),
    }
    row = audits.cardinality_audit(made, ["id"]).first()
    assert (row.n_roles, row.roles_ok, row.n_strengths, row.strengths_ok) == (3, True, 1, False)


def test_completeness_of_an_empty_and_a_full_resume(spark):
    full = (
        '{"personal_info":{"phone":"1","summary":"s"},"education":[{"institution":"i"}],'
        '"experience":[{"company":"c","title":"t"}],"projects":[{"name":"n"}],'
        '"certifications":[{"name":"n"}],"skills":[{"category":"c"}]}'
    )
    blank = '{"personal_info":{"phone":" ","email":"","summary":" "}}'
    frame = spark.createDataFrame([(1, full), (2, blank), (3, "{}")], "person_id int, a string")
    made = {r.person_id: r for r in derive.completeness(conform(frame, "a", "resume")).collect()}
    assert (made[1].section_coverage_pct, made[1].missing_sections) == (100, [])
    for person in (2, 3):
        assert made[person].section_coverage_pct == 0
        assert made[person].missing_sections == list(derive.COVERED_SECTIONS)
