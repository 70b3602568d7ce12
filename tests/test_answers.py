"""Strict reading of answers: what is refused, what is coerced, what is filled in."""

import json

import pytest

from dossier.operators.responses import conform

R = '"experience":[{"company":"c","title":"t"%s}]'

RESUMES = [
    # text, reason, bad field
    ("{}", None, None),
    ("", "malformed", None),
    (None, "malformed", None),
    ("   \n", "malformed", None),
    ("null", "not_object", None),
    ("[]", "not_object", None),
    ("[{}]", "not_object", None),
    ('"text"', "not_object", None),
    ("7", "not_object", None),
    ("{} thanks", "malformed", None),
    ("{}{}", "malformed", None),
    ("{} {}", "malformed", None),
    ("{},{}", "malformed", None),
    ("{}],[{}", "malformed", None),
    ('{}},{"v":{}', "malformed", None),
    ("{'languages':[]}", "malformed", None),
    ('{"languages":["a"]', "malformed", None),
    ('{"languages":["a"],}', "malformed", None),
    ('{"foo":1}', None, None),
    ('{"Languages":5}', None, None),
    ('{"raw_text":"x"}', "reserved_key", None),
    ('{"raw_text":null}', "reserved_key", None),
    ('{"languages":["a"],"languages":["b"]}', None, None),
    ('{"languages":null}', "invalid", "languages"),
    ('{"languages":"a"}', "invalid", "languages"),
    ('{"languages":{}}', "invalid", "languages"),
    ('{"languages":[]}', None, None),
    ('{"languages":["a",null]}', "invalid", "languages"),
    ('{"languages":["a",1]}', "invalid", "languages"),
    ('{"languages":["a",["b"]]}', "invalid", "languages"),
    ('{"personal_info":null}', None, None),
    ('{"personal_info":{}}', None, None),
    ('{"personal_info":[]}', "invalid", "personal_info"),
    ('{"personal_info":{"name":5}}', "invalid", "personal_info"),
    ('{"personal_info":{"name":{"a":1}}}', "invalid", "personal_info"),
    ('{"education":[{"institution":"X","gpa":3.8}]}', "invalid", "education"),
    ('{"education":[{"institution":"X","gpa":"3.8"}]}', None, None),
    ('{"education":[{"institution":"X"},{"degree":"D"}]}', "invalid", "education"),
    ('{"education":[{"institution":null}]}', "invalid", "education"),
    ('{"education":[{"institution":true}]}', "invalid", "education"),
    ('{"education":[null]}', "invalid", "education"),
    ('{"education":[5]}', "invalid", "education"),
    ('{"education":null}', "invalid", "education"),
    ("{" + R % "" + "}", None, None),
    ("{" + R % ',"is_current":null' + "}", "invalid", "experience"),
    ("{" + R % ',"is_current":"maybe"' + "}", "invalid", "experience"),
    ("{" + R % ',"is_current":2' + "}", "invalid", "experience"),
    ("{" + R % ',"is_current":[]' + "}", "invalid", "experience"),
    ("{" + R % ',"responsibilities":null' + "}", "invalid", "experience"),
    ("{" + R % ',"responsibilities":["a",1]' + "}", "invalid", "experience"),
    ("{" + R % ',"responsibilities":"a"' + "}", "invalid", "experience"),
    ("{" + R % ',"location":null' + "}", None, None),
    ('{"experience":[{"company":"c"}]}', "invalid", "experience"),
    ('{"skills":[{"skills":["a"]}]}', "invalid", "skills"),
    ('{"skills":[{"category":"a"}]}', None, None),
    ('{"projects":[{"name":"p","technologies":[null]}]}', "invalid", "projects"),
    ('{"certifications":[{"issuer":"i"}]}', "invalid", "certifications"),
    ("```json\n{}\n```", None, None),
    (" ```JSON{}``` ", None, None),
    ("Sure: ```{}```", "malformed", None),
]


def test_resume_verdicts(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(RESUMES)]
    judged = conform(spark.createDataFrame(rows, "i int, answer string"), "answer", "resume")
    got = {r.i: (r.reason, r.bad_field) for r in judged.collect()}
    want = {i: (reason, field) for i, (_, reason, field) in enumerate(RESUMES)}
    assert {RESUMES[i][0]: v for i, v in got.items() if v != want[i]} == {}
    statuses = {r.reason: r.status for r in judged.collect()}
    assert statuses == {
        None: None, "malformed": 422, "invalid": 422, "not_object": 500, "reserved_key": 500,
    }


FLAGS = {
    "true": True, "false": False, "1": True, "0": False, "1.0": True, '"yes"': True,
    '"NO"': False, '"On"': True, '"off"': False, '"t"': True, '"n"': False, '"1"': True,
}


def test_flags_and_defaults(spark):
    rows = [("{" + R % f',"is_current":{f}' + "}", want) for f, want in FLAGS.items()]
    rows.append(("{" + R % "" + "}", False))
    made = conform(spark.createDataFrame(rows, "answer string, want boolean"), "answer", "resume")
    for row in made.collect():
        entry = row.resume.experience[0]
        assert entry.is_current == row.want, row.answer
        assert entry.responsibilities == [] and entry.location is None
        assert row.resume.languages == [] and row.resume.personal_info is None


def test_last_of_equal_keys_counts(spark):
    made = conform(
        spark.createDataFrame([('{"languages":["a"],"languages":["b"]}',)], "answer string"),
        "answer",
        "resume",
    )
    assert made.first().resume.languages == ["b"]


SCORES = {
    "0": 0, "100": 100, "-1": None, "101": None, "87.0": 87, "87.5": None, '"87"': 87,
    '" 87 "': 87, '"87.0"': 87, '"87."': None, '"+87"': 87, '"1_0"': 10, '"1__0"': None,
    '"1e2"': None, '"0x10"': None, '"00012"': 12, "true": 1, "null": None, '""': None,
    "1e20": None, "[]": None, '"\\u00a087"': 87,
}
YEARS = {
    "3": 3.0, "3.5": 3.5, '"3.5"': 3.5, '" 3.5 "': 3.5, '"5."': 5.0, '".5"': 0.5, '"1e-2"': 0.01,
    '"1_0.5"': 10.5, '"1d"': None, '"abc"': None, "null": None, "true": 1.0, '""': None,
}


def profile(**changes):
    record = {"career_level": '"Mid"', "profile_completeness": '{"overall_score":1}', **changes}
    return "{" + ",".join(f'"{k}":{v}' for k, v in record.items() if v is not None) + "}"


PROFILES = {
    profile(): None,
    profile(career_level=None): "career_level",
    profile(career_level="null"): "career_level",
    profile(career_level="5"): "career_level",
    profile(career_level='"Wizard"'): None,
    profile(profile_completeness=None): "profile_completeness",
    profile(profile_completeness="{}"): "profile_completeness",
    profile(profile_completeness='{"overall_score":5,"has_summary":null}'): "profile_completeness",
    profile(professional_summary="null"): "professional_summary",
    profile(professional_summary='""'): None,
    profile(key_strengths="null"): "key_strengths",
    profile(inferred_job_roles='[{"title":"t","confidence":"c"}]'): "inferred_job_roles",
    profile(inferred_job_roles='[{"title":"t","confidence":"c","reasoning":"r"}]'): None,
    profile(skill_categories='[{"category":"c"}]'): "skill_categories",
    profile(skill_categories='[{"category":"c","proficiency_level":"x"}]'): None,
    profile(original_resume='{"x":1}'): None,
}


def test_profile_verdicts(spark):
    frame = spark.createDataFrame([(t,) for t in PROFILES], "answer string")
    got = {r.answer: r.bad_field for r in conform(frame, "answer", "profile").collect()}
    assert got == PROFILES


@pytest.mark.parametrize(
    "cases, build, read",
    [
        (
            SCORES,
            lambda v: profile(profile_completeness=f'{{"overall_score":{v}}}'),
            lambda p: p.profile_completeness.overall_score,
        ),
        (YEARS, lambda v: profile(total_years_experience=v), lambda p: p.total_years_experience),
    ],
)
def test_numbers(spark, cases, build, read):
    frame = spark.createDataFrame([(v, build(v)) for v in cases], "v string, answer string")
    rows = conform(frame, "answer", "profile").collect()
    assert {r.v: read(r.profile) if r.profile else None for r in rows} == cases


def test_profile_defaults(spark):
    made = conform(spark.createDataFrame([(profile(),)], "answer string"), "answer", "profile")
    p = made.first().profile
    assert p.total_years_experience == 0.0 and p.professional_summary == ""
    assert p.inferred_job_roles == [] and p.profile_completeness.missing_sections == []
    assert p.profile_completeness.has_skills is False


def test_answers_are_parsed_once(spark):
    frame = spark.createDataFrame([("{}",)], "answer string")
    good = conform(frame, "answer", "resume").filter("reason IS NULL").select("resume.languages")
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    assert plan.count("lengthOfJsonArray") == 1


def test_round_trip_of_a_full_record(spark):
    record = {
        "personal_info": {"name": "Ü", "email": None},
        "experience": [
            {"company": "c", "title": "t", "is_current": True, "responsibilities": ["a", "b"]}
        ],
        "skills": [{"category": "k", "skills": ["x"]}],
    }
    frame = spark.createDataFrame([(json.dumps(record),)], "answer string")
    got = conform(frame, "answer", "resume").first().resume.asDict(recursive=True)
    assert got["personal_info"]["name"] == "Ü" and got["personal_info"]["phone"] is None
    assert got["experience"][0]["responsibilities"] == ["a", "b"]
    assert got["skills"] == [{"category": "k", "skills": ["x"]}] and got["projects"] == []


def faults_of(spark, texts, which):
    frame = spark.createDataFrame([(t,) for t in texts], "answer string")
    rows = conform(frame, "answer", which, faults=True).collect()
    return {r.answer: (r.bad_field, [(f.path, f.rule) for f in r.faults]) for r in rows}


FAULTS = {
    '{"languages":null,"skills":[null,{"skills":["a",1]}]}': [
        ("skills[0]", "object"), ("skills[1].category", "missing"), ("skills[1].skills[1]", "text"),
        ("languages", "list"),
    ],
    '{"personal_info":{"name":{"a":1},"email":[]},"education":[{"institution":null},{}]}': [
        ("personal_info.name", "text"), ("personal_info.email", "text"),
        ("education[0].institution", "text"), ("education[1].institution", "missing"),
    ],
    '{"experience":[{"company":"c","title":"t","is_current":null,"responsibilities":null},7]}': [
        ("experience[0].is_current", "flag"), ("experience[0].responsibilities", "list"),
        ("experience[1]", "object"),
    ],
    '{"raw_text":1,"languages":null}': [("", "reserved_key")],
    "[]": [("", "not_object")],
    "": [("", "malformed")],
    "{}": [],
}


def test_every_fault_is_listed(spark):
    got = faults_of(spark, FAULTS, "resume")
    assert {t: places for t, (_, places) in got.items()} == FAULTS


@pytest.mark.parametrize("which, texts", [("resume", [t for t, _, _ in RESUMES if t]), ("profile", list(PROFILES))])
def test_faults_agree_with_the_verdict(spark, which, texts):
    """An answer has faults exactly if it is refused, and the first one lies in the bad field."""
    frame = spark.createDataFrame([(t,) for t in texts], "answer string")
    for r in conform(frame, "answer", which, faults=True).collect():
        assert bool(r.faults) == (r.reason is not None), r.answer
        if r.bad_field:
            assert r.faults[0].path.split(".")[0].split("[")[0] == r.bad_field, r.answer


def test_score_faults(spark):
    texts = {f'"overall_score":{v}': rule for v, rule in (
        ("101", "range"), ("-1", "range"), ('"x"', "whole"), ("87.5", "whole"), ("null", "whole"), ("[]", "whole"),
    )}
    answers = {profile(profile_completeness="{" + t + "}"): rule for t, rule in texts.items()}
    answers[profile(profile_completeness="{}")] = "missing"
    got = faults_of(spark, answers, "profile")
    assert {t: places for t, (_, places) in got.items()} == {
        t: [("profile_completeness.overall_score", rule)] for t, rule in answers.items()
    }
