"""Registered queries, one per operator or group of operators."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, files
from ..functions.text import drop_blank_lines, strip_fences
from ..operators import assemble, audits, derive, marts, nested, requests, responses, state
from ..operators.contacts import contacts as find_contacts
from ..operators.envelope import envelope as make_envelope
from ..operators.flow import Run
from ..operators.flow import whole_run as run_flow
from ..operators.intake import CALLERS, intake, judge_for_callers, judge_uploads
from ..operators.jobs import merge_postings, rank_jobs, skill_gap
from ..schemas import LIST_SECTIONS
from ..session import prepare, shared_dir, written
from ..sources.profiles import append_changes, cascade_deletions, read_profiles, write_profiles
from ..sources.upload_source import scan_uploads
from ..sources.uploads import split_units
from ..streaming.answers import answered_in_time, timed_envelopes
from ..streaming.summary import windowed_summary
from ..streaming.upsert import appended, arriving_files, stop_after, stream_upsert
from . import standins as S


def _long(column):
    return column.cast("long")


def _or(column, value):
    return F.coalesce(column, F.lit(value))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Intake


def intake_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime, name = F.col("mime"), F.col("filename")
    return S.uploads(spark, sf_dir).select(
        "upload_id",
        "filename",
        _or(files.file_type_service(mime, name), "").alias("service_type"),
        _or(files.file_type_gateway(mime, name), "").alias("gateway_type"),
        files.file_ok_client(mime, name).alias("client_ok"),
    )


def upload_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads written as files, empty ones among them, read back and judged."""
    path = S.upload_folder(spark, sf_dir, f"{shared_dir(spark)}/upload_scan/{uuid.uuid4().hex}")
    return judge_uploads(scan_uploads(spark, path, content=True), "service").select(
        "folder",
        "filename",
        "size_bytes",
        _or(F.col("file_type"), "").alias("file_type"),
        _or(F.col("reason"), "").alias("reason"),
        _long(_or(F.col("status"), 0)).alias("status"),
        F.md5(_or(F.col("text"), "")).alias("text_md5"),
    )


def _judged(spark, sf_dir) -> DataFrame:
    return judge_for_callers(S.uploads(spark, sf_dir), list(CALLERS), ["upload_id"])


def intake_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload under the rules of each caller."""
    return _judged(spark, sf_dir).select(
        "caller",
        "upload_id",
        _or(F.col("reason"), "").alias("reason"),
        _long(_or(F.col("status"), 0)).alias("status"),
        _or(F.col("error"), "").alias("error"),
    )


def intake_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = intake(S.uploads(spark, sf_dir), "service")
    return bad.select("upload_id", "reason", _long(F.col("status")).alias("status"), "error")


def intake_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = intake(S.uploads(spark, sf_dir), "service")
    return good.select(
        "upload_id", "file_type", "size_bytes", F.md5("text").alias("text_md5")
    )


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = _judged(spark, sf_dir).select(
        F.col("caller").alias("source"), F.col("reason").isNull().alias("success"), "reason", "status"
    )
    events = S.runs(spark, sf_dir).select(
        F.lit("pipeline").alias("source"),
        "success",
        F.when(~F.col("success"), "pipeline").alias("reason"),
        F.when(~F.col("success"), 500).alias("status"),
    )
    return marts.run_summary(gates.unionByName(events), ["source"]).select(
        "source",
        "success",
        _or(F.col("reason"), "").alias("reason"),
        _long(_or(F.col("status"), 0)).alias("status"),
        "n",
        F.round("success_share", 6).alias("success_share"),
    )


def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    payload = F.when(value < 5, F.lit("")).when(value >= 20, F.col("props"))
    stderr = F.when(value < 2, F.lit("")).when(value < 10, F.col("event_type"))
    shown = display.error_text(payload, stderr, F.lit("Pipeline exited with an error."))
    return S.table(spark, sf_dir, "events").select("event_id", shown.alias("error"))


# Text and requests


def _texts(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        _long(F.col("n_units")).alias("n_units"),
        _long(F.length("text")).alias("n_chars"),
        F.md5("text").alias("text_md5"),
    )


def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(assemble.assemble_pages(S.pages(spark, sf_dir)))


def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every document by the rule of its type, or the error of its type."""
    known, other = split_units(S.typed_units(spark, sf_dir))
    texts = assemble.assemble_units(known)
    return _union(
        [
            texts.select("doc_id", F.md5("text").alias("text_md5"), F.lit("").alias("error")),
            other.select("doc_id", F.lit("").alias("text_md5"), "error"),
        ]
    )


def paragraph_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(assemble.assemble_paragraphs(S.paragraphs(spark, sf_dir)))


def paragraph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_blank_lines(F.col("text"))
    return S.spaced_documents(spark, sf_dir).select(
        "doc_id", _long(F.length(kept)).alias("n_chars"), F.md5(kept).alias("text_md5")
    )


def leading_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = assemble.leading_text(assemble.assemble_paragraphs(S.paragraphs(spark, sf_dir)))
    return lead.select(
        "doc_id", _long(F.length("text")).alias("n_chars"), F.md5("text").alias("text_md5")
    )


def _asked(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        "request_id",
        "kind",
        "system",
        _long(F.length("prompt")).alias("n_chars"),
        F.md5("prompt").alias("prompt_md5"),
        "temperature",
        _long(F.col("max_tokens")).alias("max_tokens"),
    )


def extraction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    return _asked(requests.extraction_requests(docs), "doc_id")


def profile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(requests.profile_requests(S.resumes(spark, sf_dir)), "person_id")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contacts(S.table(spark, sf_dir, "documents").select("doc_id", "text"))


# Answers


def response_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = S.pick(
        "event_id % 6",
        "props",
        r"concat('```json\n', props, '\n```')",
        "concat('```JSON ', props, '```')",
        r"concat(' \t```\n', props, '\n\n```\n ')",
        "concat('Result: ```', props, '```')",
        "concat(' ', props, '  ')",
    )
    return S.table(spark, sf_dir, "events").select(
        "event_id", strip_fences(F.expr(fenced)).alias("cleaned")
    )


def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = S.pick(
        "event_id % 10",
        "props",
        r"concat('```\n', props, '\n```')",
        "concat(props, ' done')",
        "concat(props, props)",
        "concat('[', props, ']')",
        "substr(props, 1, length(props) - 1)",
        S.with_key("props", '"raw_text":null'),
        "CAST(event_id AS STRING)",
        "concat(props, '],[', props)",
        """concat(props, '},{"v":', props)""",
    )
    answers = S.table(spark, sf_dir, "events").selectExpr("event_id", f"{damaged} AS answer")
    judged = responses.conform(answers, "answer", "resume")
    return judged.select(
        "event_id",
        _or(F.col("reason"), "").alias("reason"),
        _long(_or(F.col("status"), 0)).alias("status"),
    )


def resume_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = responses.conform(S.resume_answers(spark, sf_dir), "answer", "resume")
    resume = F.col("resume")
    sizes = [
        F.when(resume.isNull(), F.lit(-1).cast("long")).otherwise(_long(F.size(resume.getField(s))))
        .alias(f"n_{s}")
        for s in LIST_SECTIONS
    ]
    return judged.select(
        "person_id",
        F.col("reason").isNull().alias("accepted"),
        _or(F.col("reason"), "").alias("reason"),
        _long(_or(F.col("status"), 0)).alias("status"),
        _or(F.col("bad_field"), "").alias("bad_field"),
        *sizes,
        _or(F.md5(requests.resume_json(resume)), "").alias("resume_md5"),
    )


def answer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places that do not fit, in answers with several damages each."""
    frames = [
        responses.conform(S.faulty_answers(spark, sf_dir, answer), "answer", which, faults=True).select(
            "answer_id",
            F.lit(which).alias("record"),
            _or(F.col("reason"), "").alias("reason"),
            _or(F.col("bad_field"), "").alias("bad_field"),
            _long(F.size("faults")).alias("n_faults"),
            _or(display.fault_text(F.col("faults")), "").alias("error"),
        )
        for which, answer in (("resume", S.FAULTY_RESUME), ("profile", S.FAULTY_PROFILE))
    ]
    return _union(frames)


def profile_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = S.profiles(S.resumes(spark, sf_dir))
    p = F.col("profile")
    done = p.getField("profile_completeness")
    return judged.select(
        "person_id",
        _or(F.col("reason"), "").alias("reason"),
        _or(F.col("bad_field"), "").alias("bad_field"),
        _long(_or(done.getField("overall_score"), -1)).alias("overall_score"),
        _or(done.getField("has_summary"), False).alias("has_summary"),
        _or(done.getField("has_skills"), False).alias("has_skills"),
        _or(p.getField("career_level"), "").alias("career_level"),
        _or(p.getField("total_years_experience"), -1.0).alias("total_years"),
        _long(_or(F.size(p.getField("key_strengths")), -1)).alias("n_strengths"),
        _or(p.getField("professional_summary"), "refused").alias("professional_summary"),
    )


def _accepted_profiles(made: DataFrame) -> DataFrame:
    return responses.accepted(S.profiles(made)).select(
        "request_id", "person_id", "profile"
    )


def domain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.domain_audit(_accepted_profiles(S.resumes(spark, sf_dir)))


def cardinality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audits.cardinality_audit(_accepted_profiles(S.resumes(spark, sf_dir)), ["person_id"])
    return found.select(
        "person_id",
        _long(F.col("n_roles")).alias("n_roles"),
        "roles_ok",
        _long(F.col("n_strengths")).alias("n_strengths"),
        "strengths_ok",
    )


# Nested and flat


def nest_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = nested.nest_skills(
        S.bought_parts(spark, sf_dir).select("person_id", "category", "skill")
    )
    line = F.transform(
        "skills",
        lambda g: F.concat(
            g.getField("category"), F.lit(":"), F.array_join(g.getField("skills"), ",")
        ),
    )
    return made.select(
        "person_id",
        _long(F.size("skills")).alias("n_categories"),
        F.array_join(line, ";").alias("skills"),
    )


def assemble_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    resume = F.col("resume")
    return S.resumes(spark, sf_dir).select(
        "person_id",
        *[_long(F.size(resume.getField(s))).alias(f"n_{s}") for s in LIST_SECTIONS],
        F.md5(requests.resume_json(resume)).alias("resume_md5"),
    )


_LABELS = {
    "education": "institution",
    "experience": "company",
    "projects": "name",
    "certifications": "credential_id",
    "skills": "category",
    "languages": "value",
}


def _stored_resumes(spark, sf_dir) -> DataFrame:
    """Resumes for queries that read them more than once."""
    return written(S.resumes(spark, sf_dir), "resumes")


def flatten_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = nested.flatten_labels(S.resumes(spark, sf_dir), _LABELS, ["person_id"])
    return flat.withColumn("pos", _long(F.col("pos")))


def flatten_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = nested.flatten_inner_values(S.resumes(spark, sf_dir), ["person_id"])
    return flat.withColumns({c: _long(F.col(c)) for c in ("pos", "inner_pos")})


def _attached(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    made = _stored_resumes(spark, sf_dir)
    answers = _accepted_profiles(made).select("request_id", "profile")
    return nested.attach_resume(answers, requests.profile_requests(made), made)


def attach_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    attached, _ = _attached(spark, sf_dir)
    return attached.select(
        "request_id",
        "person_id",
        F.col("profile.career_level").alias("career_level"),
        F.md5(requests.resume_json(F.col("original_resume"))).alias("resume_md5"),
    )


def unanswered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _stored_resumes(spark, sf_dir)
    answers = S.profile_answers(made).select("request_id", "answer")
    _, missing = nested.attach_resume(answers, requests.profile_requests(made), made)
    return missing.select("request_id", "person_id")


# Derived columns


def years_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derive.years_experience(
        S.experience(spark, sf_dir), date.fromisoformat(S.AS_OF)
    )
    return found.select(
        "person_id",
        "n_entries",
        _long(F.col("n_ignored")).alias("n_ignored"),
        _long(F.col("n_periods")).alias("n_periods"),
        _long(F.col("days")).alias("days"),
        "years",
    )


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.completeness(S.resumes(spark, sf_dir)).select(
        "person_id",
        *[f"has_{s}" for s in derive.COVERED_SECTIONS],
        F.array_join("missing_sections", ",").alias("missing_sections"),
        _long(F.col("section_coverage_pct")).alias("section_coverage_pct"),
    )


def rank_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = derive.rank_roles(_accepted_profiles(S.resumes(spark, sf_dir)), ["person_id"])
    return ranked.withColumns(
        {"rank": _long(F.col("rank")), "given_pos": _long(F.col("given_pos"))}
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.timeline(S.experience(spark, sf_dir), ["person_id", "entry"])


def education_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = S.people(spark, sf_dir).filter("education IS NOT NULL")
    entries = entries.select("person_id", F.lit(0).alias("pos"), "education.item.*")
    return derive.education_lines(entries, ["person_id"])


def certification_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.certification_lines(S.certifications(spark, sf_dir), ["person_id", "entry"])


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    written = S.table(spark, sf_dir, "pages").select(
        "page_id", F.when(F.col("page_id") % 2 == 1, bare).otherwise(F.col("url")).alias("url")
    )
    return derive.links(written, ["page_id"])


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    known = S.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(key % 4 == 1, F.lit("")).when(key % 4 != 0, F.lower("c_name")).alias("full_name"),
        F.when(key % 8 == 0, F.lit(None))
        .when(key % 8 == 4, F.lit("@example.com"))
        .otherwise(F.concat(F.lower("c_mktsegment"), F.lit("@x@example.com")))
        .alias("email"),
    )
    return marts.identity(known, ["user_id"])


def stat_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _stored_resumes(spark, sf_dir)
    shown = _accepted_profiles(made).select("person_id", "profile")
    return marts.stat_cards(made, shown)


# Keyed state


def _rows(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "user_id",
        "profile_data",
        _or(F.col("source_filename"), "").alias("source_filename"),
        F.col("created_at").cast("string").alias("created_at"),
        F.col("updated_at").cast("string").alias("updated_at"),
    )


def _two_batches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    every = S.runs(spark, sf_dir)
    cut = F.lit(S.SNAPSHOT_END).cast("timestamp_ntz")
    return every.filter(F.col("ts") < cut), every.filter(F.col("ts") >= cut)


def _current(spark, sf_dir) -> DataFrame:
    early, late = _two_batches(spark, sf_dir)
    return state.upsert(state.batch_changes(early), late)


def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_current(spark, sf_dir))


def profile_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot written, a batch applied on top, current rows read back."""
    path = f"{shared_dir(spark)}/profile_store/{uuid.uuid4().hex}"
    early, late = _two_batches(spark, sf_dir)
    write_profiles(state.batch_changes(early), path)
    append_changes(state.batch_changes(late), path, "late", 0)
    return _rows(read_profiles(spark, path))


def cascade_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in layers; the profiles of deleted users leave it by tombstones."""
    path = f"{shared_dir(spark)}/cascade_store/{uuid.uuid4().hex}"
    early, late = _two_batches(spark, sf_dir)
    write_profiles(state.batch_changes(early), path)
    append_changes(state.batch_changes(late), path, "late", 0)
    cascade_deletions(spark, S.users(spark, sf_dir), path, "cascade", 0)
    return _rows(read_profiles(spark, path))


def own_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one user reads of a stored table: their row, out of their folder alone."""
    path = f"{shared_dir(spark)}/own_profile/{uuid.uuid4().hex}"
    early, late = _two_batches(spark, sf_dir)
    write_profiles(state.batch_changes(early), path)
    append_changes(state.batch_changes(late), path, "late", 0)
    return _rows(state.visible_profiles(read_profiles(spark, path, "7"), "7", "authenticated"))


def upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of runs, applied micro-batch by micro-batch."""
    path = f"{shared_dir(spark)}/upsert_stream/{uuid.uuid4().hex}"
    events = (
        spark.readStream.schema(S.TABLES["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    stream_upsert(
        S.run_columns(events), f"{path}/table", f"{path}/checkpoint", f"upsert-{path[-8:]}"
    ).awaitTermination()
    return _rows(read_profiles(spark, f"{path}/table"))


def upsert_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as twelve files in order, one per micro-batch; stopped on the way and started again."""
    path = f"{shared_dir(spark)}/upsert_restart/{uuid.uuid4().hex}"
    files = S.arrive(S.table(spark, sf_dir, "events"), "ts", f"{path}/files", 12)

    def start():
        runs = S.run_columns(arriving_files(spark, files, S.TABLES["events"]))
        return stream_upsert(runs, f"{path}/table", f"{path}/checkpoint", f"upsert-{path[-8:]}")

    stop_after(start(), f"{path}/table", 4)
    start().awaitTermination()
    return _rows(read_profiles(spark, f"{path}/table"))


def timed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and answers as two streams: the answer within the limit, or the failure."""
    path = f"{shared_dir(spark)}/timed_answers/{uuid.uuid4().hex}"
    asked, given = S.timed_requests(spark, sf_dir)
    streams = [
        arriving_files(spark, S.arrive(rows, at, f"{path}/{at}", 8, {at: "TIMESTAMP'{tick}'"}), rows.schema)
        for rows, at in ((asked, "asked_at"), (given, "answered_at"))
    ]
    met = appended(answered_in_time(*streams), f"{path}/met", f"{path}/checkpoint")
    made = timed_envelopes(met.filter("request_id IS NOT NULL"))
    return made.select(
        "request_id",
        "success",
        _or(F.col("error"), "").alias("error"),
        _or(F.get_json_object("json", "$.answer"), "").alias("answer"),
        _or(F.get_json_object("json", "$.error"), "").alias("error_in_json"),
    )


def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and users per day and outcome, from runs that arrive late."""
    path = f"{shared_dir(spark)}/run_windows/{uuid.uuid4().hex}"
    late = S.late_runs(spark, sf_dir)
    ticks = {c: "TIMESTAMP'{tick}'" for c in ("ts", "arrived_at")}
    files = S.arrive(late, "arrived_at", f"{path}/files", 8, ticks)
    counted = windowed_summary(arriving_files(spark, files, late.schema))
    out = appended(counted, f"{path}/windows", f"{path}/checkpoint").filter("success IS NOT NULL")
    day = F.expr(S.zoneless("window_start")).cast("date").cast("string")
    return out.select(day.alias("day"), "success", "n", "n_users")


def visible_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _current(spark, sf_dir)
    views = {"user 7": ("7", "authenticated"), "nobody": (None, "anon"), "service": (None, "service_role")}
    return state.visible_to(table, views).select("reader", "user_id", "profile_data")


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(state.cascade(_current(spark, sf_dir), S.users(spark, sf_dir)))


def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = S.runs(spark, sf_dir).select(
        F.when(F.col("success"), F.col("user_id")).alias("user_id"),
        F.when(F.col("source_filename").isNotNull(), F.col("profile_data")).alias("profile_data"),
    )
    return state.constraint_audit(loose, S.users(spark, sf_dir)).select(
        "violation", _or(F.col("user_id"), "").alias("user_id"), "n_rows"
    )


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of every run over the resumes: both payloads, or the error."""
    made = _stored_resumes(spark, sf_dir)
    judged = written(S.profiles(made).drop("answer"), "profiles")
    attached, _ = nested.attach_resume(
        responses.accepted(judged).select("request_id", "profile"),
        requests.profile_requests(made),
        made,
    )
    full = nested.with_raw_text(
        attached, S.resume_texts(spark, sf_dir), "person_id", "original_resume"
    )
    ok = full.select(
        "request_id",
        F.col("original_resume").alias("parsed_resume"),
        F.struct("profile.*", "original_resume").alias("profile_intelligence"),
    )
    bad = responses.refused(judged).select(
        "request_id", F.concat(F.lit("answer refused: "), F.col("reason")).alias("error")
    )
    made_json = make_envelope(ok, bad, "request_id")
    path = {
        "level": "$.profile_intelligence.career_level",
        "name": "$.parsed_resume.personal_info.name",
        "error_in_json": "$.error",
        "success_in_json": "$.success",
    }
    return made_json.select(
        "request_id",
        "success",
        _or(F.col("error"), "").alias("error"),
        *[_or(F.get_json_object("json", p), "").alias(n) for n, p in path.items()],
        *[
            F.md5(_or(F.get_json_object("json", f"$.{p}.raw_text"), "")).alias(n)
            for n, p in (
                ("text_md5", "parsed_resume"),
                ("inner_text_md5", "profile_intelligence.original_resume"),
            )
        ],
        F.col("json").contains('"linkedin":null').alias("keeps_nulls"),
    )


def _flow(spark: SparkSession, sf_dir: str) -> tuple[Run, DataFrame]:
    """The whole run over all uploads, and the profile table it leaves."""
    path = f"{shared_dir(spark)}/whole_run/{uuid.uuid4().hex}"
    made = run_flow(
        S.flow_uploads(spark, sf_dir), S.flow_units(spark, sf_dir), S.extraction_model, S.analysis_model, path, "flow", 0
    )
    return made, read_profiles(spark, path)


def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope per upload, and whether the table holds its profile now."""
    made, table = _flow(spark, sf_dir)
    held = table.select(
        F.get_json_object("profile_data", "$.original_resume.personal_info.name").alias("name"), F.lit(True).alias("stored")
    )
    path = {
        "level": "$.profile_intelligence.career_level",
        "score": "$.profile_intelligence.profile_completeness.overall_score",
        "name": "$.parsed_resume.personal_info.name",
        "error_in_json": "$.error",
    }
    said = made.envelopes.select(
        "upload_id",
        "step",
        _or(F.col("reason"), "").alias("reason"),
        _long(_or(F.col("status"), 0)).alias("status"),
        "success",
        _or(F.col("error"), "").alias("error"),
        *[_or(F.get_json_object("json", p), "").alias(n) for n, p in path.items()],
        F.md5(_or(F.get_json_object("json", "$.parsed_resume.raw_text"), "")).alias("text_md5"),
    )
    return said.join(held, "name", "left").withColumn("stored", _or(F.col("stored"), False))


def whole_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the runs ended, as observed while the envelopes were written."""
    made, _ = _flow(spark, sf_dir)
    rows = [(step, reason, n) for (step, reason), n in made.counts().items() if n]
    return spark.createDataFrame(rows, "step string, reason string, n long")


# Jobs


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_postings(S.postings(spark, sf_dir), ["company", "title"], ["salary", "description"])


def merged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select(
        "job_id",
        "n_postings",
        F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"),
        F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"),
        "company",
        "title",
        _or(F.col("salary"), -1.0).alias("salary"),
        _or(F.col("description"), "").alias("description"),
        F.array_join("skills", ",").alias("skills"),
    )


def suitable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three most suitable jobs of every person, at least two fifths of the skills held, and the gaps."""
    required = written(_jobs(spark, sf_dir).select("job_id", F.explode("skills").alias("skill")), "required_skills")
    held = written(S.held_skills(spark, sf_dir).distinct(), "held_skills")
    ranked = written(rank_jobs(held, required, 3, 40), "ranked_jobs")
    return skill_gap(ranked, held, required).select(
        "person_id",
        _long(F.col("rank")).alias("rank"),
        "job_id",
        _long(F.col("matched")).alias("matched"),
        _long(F.col("n_required")).alias("n_required"),
        F.array_join("missing", ",").alias("missing"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        intake_types,
        upload_scan,
        intake_gates,
        intake_quarantine,
        intake_valid,
        run_summary,
        error_texts,
        page_assembly,
        text_units,
        paragraph_assembly,
        paragraph_lines,
        leading_text,
        extraction_requests,
        profile_requests,
        contacts,
        response_cleaning,
        response_json,
        resume_conformance,
        profile_conformance,
        answer_faults,
        domain_audit,
        cardinality_audit,
        nest_skills,
        assemble_resume,
        flatten_sections,
        flatten_inner,
        attach_resume,
        unanswered_requests,
        years_experience,
        completeness,
        rank_roles,
        timeline,
        education_lines,
        certification_lines,
        links,
        identity,
        stat_cards,
        upsert_batch,
        profile_store,
        cascade_store,
        own_profile,
        upsert_stream,
        upsert_restart,
        timed_answers,
        run_windows,
        visible_profiles,
        cascade,
        constraint_audit,
        envelope,
        whole_run,
        whole_run_counts,
        merged_postings,
        suitable_jobs,
    )
}


def prepared(query):
    """Query that first sets the session options it relies on."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run
