import pytest
import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dossier.operators import state
from dossier.operators.envelope import envelope
from dossier.operators.responses import conform
from dossier.sources import profiles as store
from dossier.streaming.upsert import stream_upsert

RUNS = "run_id long, user_id string, ts timestamp_ntz, success boolean, profile_data string, source_filename string"
T0 = datetime(2024, 1, 1)


def run(i, user, ok=True, name="f.pdf", at=None):
    return (i, user, T0 + timedelta(hours=i if at is None else at), ok, f"data-{i}", name)


def frame(spark, runs):
    return spark.createDataFrame(runs, RUNS)


def brute(runs, table=None):
    """The table after the runs were applied one after the other."""
    table = dict(table or {})
    for i, user, ts, ok, data, name in sorted(runs, key=lambda r: (r[2], r[0])):
        if ok:
            created = table[user][2] if user in table else ts
            table[user] = (data, name, created, ts)
    return table


def as_dict(df):
    return {
        r.user_id: (r.profile_data, r.source_filename, r.created_at, r.updated_at)
        for r in df.collect()
    }


def test_upsert_rules(spark):
    old = [run(1, "a"), run(2, "b")]
    new = [
        run(5, "a", name=None),
        run(6, "a", ok=False),
        run(7, "c", at=7),
        run(8, "c", at=7),
        run(9, "d", ok=False),
    ]
    snapshot = state.batch_changes(frame(spark, old))
    made = state.upsert(snapshot, frame(spark, new))
    got = as_dict(made)
    assert got == brute(new, brute(old))
    assert got["a"][1] is None, "a null filename replaces a known one"
    assert got["c"][0] == "data-8", "equal times: the later run wins"
    assert "d" not in got, "a failed run writes nothing"
    ids = {r.user_id: r.id for r in made.collect()}
    assert ids["a"] == {r.user_id: r.id for r in snapshot.collect()}["a"]


def test_same_batch_twice_changes_nothing(spark):
    batch = frame(spark, [run(1, "a"), run(2, "b"), run(3, "a")])
    once = state.upsert(state.batch_changes(frame(spark, [run(0, "a")])), batch)
    assert as_dict(state.upsert(once, batch)) == as_dict(once)


def test_upsert_equals_brute_force(spark):
    rng = random.Random(3)
    runs = [
        run(i, rng.choice("hhhhabcdef"), rng.random() < 0.8, rng.choice((None, "x", "y")))
        for i in range(400)
    ]
    old, new = runs[:150], runs[150:]
    made = state.upsert(state.batch_changes(frame(spark, old)), frame(spark, new))
    assert as_dict(made) == brute(runs)


def test_visibility_and_cascade(spark):
    table = state.batch_changes(frame(spark, [run(1, "a"), run(2, "b"), run(3, "c")]))
    see = lambda user, role: sorted(r.user_id for r in state.visible_profiles(table, user, role).collect())
    assert see("a", "authenticated") == ["a"]
    assert see(None, "anon") == [] and see("z", "authenticated") == []
    assert see(None, "service_role") == ["a", "b", "c"]
    users = spark.createDataFrame([("a",), ("a",), ("c",)], "user_id string")
    assert sorted(r.user_id for r in state.cascade(table, users).collect()) == ["a", "c"]


def test_constraint_audit(spark):
    rows = [("a", "x"), ("a", None), (None, "x"), ("z", "x"), ("b", "x")]
    table = spark.createDataFrame(rows, "user_id string, profile_data string")
    users = spark.createDataFrame([("a",), ("b",), ("b",)], "user_id string")
    got = {tuple(r) for r in state.constraint_audit(table, users).collect()}
    assert got == {
        ("null_user_id", None, 1), ("null_profile_data", "a", 1),
        ("duplicate_user_id", "a", 2), ("orphan_user_id", "z", 1),
    }


def test_store_layers(spark, tmp_path):
    path = str(tmp_path / "profiles")
    assert store.read_profiles(spark, path).count() == 0
    batches = [[run(1, "a"), run(2, "b")], [run(3, "a", name=None)], [run(4, "c")], [run(5, "b")]]
    store.write_profiles(state.batch_changes(frame(spark, batches[0])), path)
    for n, batch in enumerate(batches[1:3]):
        assert store.append_changes(state.batch_changes(frame(spark, batch)), path, "w", n)
    want = brute(sum(batches[:3], []))
    assert as_dict(store.read_profiles(spark, path)) == want

    repeated = state.batch_changes(frame(spark, [run(99, "a")]))
    assert not store.append_changes(repeated, path, "w", 1), "a published batch is skipped"
    assert as_dict(store.read_profiles(spark, path)) == want

    half = state.batch_changes(frame(spark, [run(98, "a")]))
    half.write.parquet(f"{path}/data/version=4")
    assert as_dict(store.read_profiles(spark, path)) == want, "unpublished rows are not seen"

    assert store.append_changes(state.batch_changes(frame(spark, batches[3])), path, "w", 2)
    want = brute(sum(batches, []))
    assert as_dict(store.read_profiles(spark, path)) == want, "the half-written layer was replaced"

    before = as_dict(store.read_profiles(spark, path))
    store.compact(spark, path)
    assert as_dict(store.read_profiles(spark, path)) == before


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    runs = [
        run(i, rng.choice("hhhabcde"), rng.random() < 0.8, rng.choice((None, "x")))
        for i in range(120)
    ]
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    for start in range(0, 120, 40):
        frame(spark, runs[start : start + 40]).coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(source)
        stream_upsert(stream, path, str(tmp_path / "cp"), "test").awaitTermination()

    go()
    layers = store.layers_log(spark, path).count()
    assert layers == 3, "one layer per micro-batch"
    assert as_dict(store.read_profiles(spark, path)) == brute(runs)
    go()
    assert store.layers_log(spark, path).count() == layers, "nothing new, nothing written"

    more = [run(200, "a"), run(201, "new")]
    frame(spark, more).coalesce(1).write.mode("append").parquet(source)
    go()
    assert as_dict(store.read_profiles(spark, path)) == brute(runs + more)


def test_envelopes(spark):
    made = conform(spark.createDataFrame([(1, "{}")], "id int, a string"), "a", "resume")
    ok = made.select("id", F.col("resume").alias("parsed_resume"), F.lit(None).cast("string").alias("profile_intelligence"))
    bad = spark.createDataFrame([(2, "broken"), (3, None)], "id int, error string")
    got = {r.id: (r.success, json.loads(r.json)) for r in envelope(ok, bad, "id").collect()}
    assert got[1][0] and got[1][1]["parsed_resume"]["personal_info"] is None
    assert got[1][1]["profile_intelligence"] is None
    assert got[2] == (False, {"success": False, "error": "broken"})
    assert got[3] == (False, {"success": False, "error": None})


class Conf:
    def __init__(self, **named):
        self.named, self.conf = named, self

    def get(self, key, default=None):
        return self.named.get(key.replace(".", "_"), default)


def test_shared_folder_is_the_one_the_cluster_names():
    from dossier.session import shared_dir

    assert shared_dir(Conf(spark_checkpoint_dir="hdfs:///shared/cp/")) == "hdfs:///shared/cp"
    assert "dossier-" in shared_dir(Conf(spark_master="local[4]"))
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", ""):
        with pytest.raises(ValueError):
            shared_dir(Conf(spark_master=master))


def test_the_table_refuses_rows_without_user_or_payload(spark):
    runs = frame(spark, [run(1, "a"), run(2, None), run(3, "b")]).withColumn(
        "profile_data", F.when(F.col("run_id") != 3, F.col("profile_data"))
    )
    assert [r.user_id for r in state.batch_changes(runs).collect()] == ["a"]
    refused = {r.run_id: r.reason for r in state.refused_runs(runs).collect()}
    assert refused == {2: "null_user_id", 3: "null_profile_data"}
