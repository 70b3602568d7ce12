"""The whole run, and the profile table under deletions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dossier.operators.envelope import service_envelopes
from dossier.operators.flow import whole_run
from dossier.operators.marts import run_summary
from dossier.plans import standins as S
from dossier.sources import profiles as P
from dossier.operators.state import batch_changes

DAY = dt.datetime(2024, 1, 1)
RUNS = "run_id long, user_id string, ts timestamp_ntz, success boolean, profile_data string, source_filename string"


@pytest.fixture(scope="module")
def made(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("flow"))
    uploads, units = S.flow_uploads(spark, sf_dir), S.flow_units(spark, sf_dir)
    run = lambda: whole_run(uploads, units, S.extraction_model, S.analysis_model, path, "t", 0)
    return run(), run, path


def test_one_envelope_per_upload(spark, sf_dir, made):
    ids = [r.upload_id for r in made[0].envelopes.select("upload_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in S.table(spark, sf_dir, "documents").select("doc_id").collect())


def test_observed_counts_equal_a_summary(made):
    summary = run_summary(made[0].envelopes, ["step"]).collect()
    observed = {k: n for k, n in made[0].counts().items() if n}
    assert observed == {(r.step, r.reason or ""): r.n for r in summary}
    assert len(observed) > 8 and sum(observed.values()) == made[0].envelopes.count()


def test_repeated_run_adds_no_layer(spark, made):
    before = P.layers_log(spark, made[2]).count()
    made[1]()
    assert P.layers_log(spark, made[2]).count() == before == 1


def test_payloads_are_whole(made):
    row = made[0].envelopes.filter("success").first()
    said = json.loads(row.json)
    assert said["parsed_resume"]["raw_text"] == said["profile_intelligence"]["original_resume"]["raw_text"]
    assert said["profile_intelligence"]["key_strengths"] == [] and said["parsed_resume"]["personal_info"]["phone"] is None


def test_nothing_to_do(spark, sf_dir, tmp_path):
    uploads, units = S.flow_uploads(spark, sf_dir).limit(0), S.flow_units(spark, sf_dir)
    run = whole_run(uploads, units, S.extraction_model, S.analysis_model, str(tmp_path), "none", 0)
    assert run.envelopes.count() == 0 and sum(run.counts().values()) == 0


def test_service_form_has_all_fields(spark):
    rows = spark.createDataFrame(
        [(1, ("n",), None, "a.pdf", "application/pdf"), (2, None, "bad", None, None)],
        "id long, resume struct<name: string>, error string, filename string, file_type string",
    )
    got = {r.id: json.loads(r.json) for r in service_envelopes(rows, ["id"]).collect()}
    assert got[1] == {"success": True, "data": {"name": "n"}, "error": None, "filename": "a.pdf", "file_type": "application/pdf"}
    assert got[2] == {"success": False, "data": None, "error": "bad", "filename": None, "file_type": None}


def runs(spark, *rows):
    given = [(k, u, DAY + dt.timedelta(days=d), True, f"p{k}", None) for k, u, d in rows]
    return batch_changes(spark.createDataFrame(given, RUNS))


def held(spark, path):
    return {r.user_id: (r.profile_data, r.created_at.day) for r in P.read_profiles(spark, path).collect()}


def test_tombstones_hide_and_a_later_success_starts_anew(spark, tmp_path):
    path = str(tmp_path)
    P.write_profiles(runs(spark, (1, "a", 0), (2, "b", 0), (3, "c", 0)), path)
    P.append_changes(runs(spark, (4, "a", 1)), path, "w", 0)
    users = spark.createDataFrame([("a",), ("b",), (None,)], "user_id string")
    assert P.append_deletions(users, path, "w", 1)
    assert not P.append_deletions(users, path, "w", 1)
    assert held(spark, path) == {"c": ("p3", 1)}
    P.append_changes(runs(spark, (5, "b", 4)), path, "w", 2)
    assert held(spark, path) == {"c": ("p3", 1), "b": ("p5", 5)}
    version = P.compact(spark, path)
    assert held(spark, path) == {"c": ("p3", 1), "b": ("p5", 5)}
    assert P.remove_old_layers(spark, path) == version - 1
    assert held(spark, path) == {"c": ("p3", 1), "b": ("p5", 5)}


def test_cascade_writes_only_what_it_deletes(spark, tmp_path):
    path = str(tmp_path)
    P.write_profiles(runs(spark, *[(k, str(k), 0) for k in range(40)]), path)
    P.cascade_deletions(spark, spark.range(30).select(F.col("id").cast("string").alias("user_id")), path, "c", 0)
    assert set(held(spark, path)) == {str(k) for k in range(30)}
    layer = spark.read.parquet(f"{path}/data/version=2")
    assert layer.count() == 10 and layer.filter("profile_data IS NOT NULL OR NOT deleted").count() == 0


def test_table_folds_itself(spark, tmp_path):
    path = str(tmp_path)
    for k in range(5):
        P.append_changes(runs(spark, (k, "a", k), (k + 10, f"u{k}", k)), path, "w", k, fold_after=3)
    kinds = [r.kind for r in P.layers_log(spark, path).orderBy("version").collect()]
    assert kinds == ["change"] * 3 + ["base"] + ["change"] * 2
    assert held(spark, path)["a"] == ("p4", 1) and len(held(spark, path)) == 6


def test_one_user_opens_one_folder(spark, tmp_path):
    path = str(tmp_path)
    P.write_profiles(runs(spark, *[(k, str(k), 0) for k in range(60)]), path)
    found = P.read_profiles(spark, path, "7")
    assert [r.user_id for r in found.collect()] == ["7"]
    assert len(found.inputFiles()) >= 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    parts = plan[plan.index("PartitionFilters") :]
    assert "bucket" in parts[: parts.index("]")]
