"""Streams over many micro-batches: restarts, time limits, late rows."""

import datetime as dt

import pytest

from dossier.plans import standins as S
from dossier.sources.profiles import layers_log, read_profiles
from dossier.streaming.answers import answered_in_time, timed_envelopes
from dossier.streaming.summary import windowed_summary
from dossier.streaming.upsert import appended, arriving_files, stop_after, stream_upsert

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def arrive_in(spark, path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return arriving_files(spark, path, schema)


def test_restart_publishes_every_batch_once(spark, sf_dir, tmp_path):
    files = S.arrive(S.table(spark, sf_dir, "events"), "ts", f"{tmp_path}/files", 10)

    def start():
        runs = S.run_columns(arriving_files(spark, files, S.TABLES["events"]))
        return stream_upsert(runs, f"{tmp_path}/table", f"{tmp_path}/checkpoint", "restart")

    before = stop_after(start(), f"{tmp_path}/table", 3)
    assert 3 <= before < 10
    start().awaitTermination()
    log = layers_log(spark, f"{tmp_path}/table").orderBy("version").collect()
    assert [r.batch_id for r in log] == list(range(10))
    # A further start has nothing to do.
    start().awaitTermination()
    assert layers_log(spark, f"{tmp_path}/table").count() == 10
    seen = S.runs(spark, sf_dir).filter("success").select("user_id").distinct()
    assert read_profiles(spark, f"{tmp_path}/table").select("user_id").exceptAll(seen).count() == 0
    assert read_profiles(spark, f"{tmp_path}/table").count() == seen.count()


def test_answers_at_the_limit_late_and_missing(spark, tmp_path):
    asked = arrive_in(
        spark, f"{tmp_path}/q", "request_id long, asked_at timestamp",
        [[(1, at(0)), (2, at(0)), (3, at(1)), (4, at(2))], [(5, at(300))], [(None, at(9000))], [(None, at(9001))]],
    )
    given = arrive_in(
        spark, f"{tmp_path}/a", "request_id long, answered_at timestamp, answer string",
        [[(1, at(60), "in time"), (2, at(60.000001), "late"), (9, at(5), "not asked")],
         [(4, at(1), "before it was asked"), (5, at(301), None)], [(None, at(9000), None)], [(None, at(9001), None)]],
    )
    met = appended(answered_in_time(asked, given), f"{tmp_path}/met", f"{tmp_path}/checkpoint")
    got = {r.request_id: (r.success, r.json) for r in timed_envelopes(met).collect() if r.request_id}
    failed = (False, '{"success":false,"error":"no answer within 60 seconds"}')
    assert got == {
        1: (True, '{"success":true,"answer":"in time"}'),
        2: failed,
        3: failed,
        4: failed,
        5: (True, '{"success":true,"answer":null}'),
    }


def test_windows_count_late_rows_and_leave_out_too_late_ones(spark, tmp_path):
    runs = arrive_in(
        spark, f"{tmp_path}/runs", "ts timestamp, success boolean, user_id string",
        [
            [(at(10), True, "a"), (at(20), True, "a"), (at(30), False, None)],
            [(at(7200), True, "b"), (at(3590), True, "c")],  # one row is late, but within the hour
            [(at(20_000), True, "b")],
            [(at(40), True, "z"), (at(20_001), True, "b")],  # the first window was given out: too late
            [(at(90_000), None, None)],
            [(at(90_001), None, None)],
        ],
    )
    counted = appended(windowed_summary(runs, "1 hour", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {((r.window_start.astimezone(dt.UTC) - T0).seconds, r.success): (r.n, r.n_users) for r in counted.collect()}
    assert got == {(0, True): (3, 2), (0, False): (1, 0), (7200, True): (1, 1), (18000, True): (2, 1)}


@pytest.mark.parametrize("rows", [[], [(1, at(0))]])
def test_tables_work_like_streams(spark, rows):
    asked = spark.createDataFrame(rows, "request_id long, asked_at timestamp")
    given = spark.createDataFrame([(1, at(61), "x")], "request_id long, answered_at timestamp, answer string")
    assert [r.answer for r in answered_in_time(asked, given).collect()] == [None] * len(rows)
    assert timed_envelopes(answered_in_time(asked, given, 61)).filter("success").count() == len(rows)
