"""Inputs in the shape the operators read, made by Spark from the given tables.

The tables hold orders, parts and texts, so each record type is mapped on them: a
customer or supplier is a person, an order an experience entry, a part a skill, a
document a resume text, an event a pipeline run. Every mapping keeps all rows of its
table. Keys only choose how a row is spelled or damaged.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import DOCX, MSWORD, PDF
from ..operators import nested
from ..operators.requests import resume_json
from ..operators.jobs import canonical
from ..operators.responses import conform

AS_OF = "2001-08-01"
SNAPSHOT_END = "2024-01-16"


# Columns of the given tables. Stated, so that no file is opened to find them out.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


# Uploads and texts


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per document."""
    ext = pick("doc_id % 6", "'.pdf'", "'.docx'", "'.doc'", "'.PDF'", "'.txt'", "''")
    mime = pick(
        "doc_id DIV 6 % 5", f"'{PDF}'", f"'{DOCX}'", f"'{MSWORD}'", "'application/octet-stream'"
    )
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS upload_id",
        "CASE WHEN doc_id % 19 <> 0 THEN CAST(doc_id AS STRING) END AS user_id",
        f"concat(source, '_', doc_id, {ext}) AS filename",
        f"{mime} AS mime",
        "CASE WHEN doc_id % 97 = 0 THEN 0 WHEN doc_id % 89 = 0 THEN 10485760 "
        "WHEN doc_id % 83 = 0 THEN 10485761 ELSE n_chars * 1024 END AS size_bytes",
        r"CASE WHEN doc_id % 101 = 0 THEN ' \n\t ' ELSE text END AS text",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per turn of a conversation."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text"
    )


def typed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as units of one file per conversation and role: PDF, DOCX and plain text."""
    role = "CASE role WHEN 'user' THEN {} WHEN 'assistant' THEN {} ELSE {} END"
    return table(spark, sf_dir, "conversations").selectExpr(
        f"conv_id * 3 + {role.format(0, 1, 2)} AS doc_id",
        "turn AS seq",
        "text",
        role.format(f"'{PDF}'", f"'{DOCX}'", "'text/plain'") + " AS mime",
    )


def resume_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts of the customers who have one."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id * 2 AS person_id", "text")


def spaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a blank line after every line."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit("\n  \n")).alias("text")
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_documents(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")
    )


# People and their resumes


# A person's native key, in expressions.
KEY = "(person_id DIV 2)"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers (even ids) and suppliers (odd ids) with their contact details."""
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")
    )
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey * 2 AS person_id",
        "c_name AS name",
        "c_nationkey AS n_nationkey",
        "c_mktsegment AS segment",
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey * 2 + 1 AS person_id",
        "s_name AS name",
        "s_nationkey AS n_nationkey",
        "CAST(NULL AS STRING) AS segment",
    )
    info = f"""named_struct(
        'name', name,
        'email', CASE WHEN {KEY} % 7 <> 0 THEN concat(lower(name), '@example.com') END,
        'phone', CASE WHEN {KEY} % 5 = 0 THEN NULL WHEN {KEY} % 11 = 0 THEN ''
                 ELSE concat('+1-555-', lpad(CAST({KEY} % 10000 AS STRING), 4, '0')) END,
        'location', n_name,
        'linkedin', CAST(NULL AS STRING),
        'github', CAST(NULL AS STRING),
        'website', CAST(NULL AS STRING),
        'summary', CASE WHEN {KEY} % 3 <> 0 THEN concat(segment, ' professional') END)"""
    school = f"""CASE WHEN segment <> 'HOUSEHOLD' THEN named_struct(
        'ord', 0,
        'item', named_struct(
            'institution', concat(r_name, ' University'),
            'degree', segment,
            'field_of_study', CASE WHEN {KEY} % 2 <> 0 THEN n_name END,
            'start_date', CAST(NULL AS STRING),
            'end_date', CASE {KEY} % 4 WHEN 1 THEN '1994' WHEN 2 THEN '' END,
            'gpa', CASE {KEY} % 3 WHEN 1 THEN '' WHEN 2 THEN '3.5' END,
            'description', CAST(NULL AS STRING))) END"""
    return (
        customers.unionByName(suppliers)
        .join(places, "n_nationkey")
        .selectExpr(
            "person_id",
            f"{info} AS personal_info",
            "CASE WHEN r_name = 'AFRICA' THEN CAST(array() AS ARRAY<STRING>) "
            "ELSE array(n_name, r_name) END AS languages",
            f"{school} AS education",
        )
    )


def written_date(day: str, selector: str) -> str:
    """A day as different writers put it."""
    patterns = ("yyyy-MM-dd", "yyyy-MM", "MM/yyyy", "MMM yyyy", "yyyy")
    forms = " ".join(
        f"WHEN {i} THEN date_format({day}, '{p}')" for i, p in enumerate(patterns)
    )
    return f"CASE {selector} {forms} END"


def orders_as_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experience entry per order, in date order, and one certification per finished
    urgent order. Both come out of one scan."""
    key, start = "o_orderkey", "CAST(o_orderdate AS DATE)"
    finish = f"least(date_add({start}, CAST(30 + {key} % 336 AS INT)), DATE'{AS_OF}')"
    job = f"""named_struct(
        'company', concat('Company-', {key} % 50),
        'title', o_orderpriority,
        'location', CASE {key} % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE o_orderstatus END,
        'start_date', CASE WHEN {key} % 53 = 0 THEN 'n/a'
                      ELSE {written_date(start, f"{key} % 5")} END,
        'end_date', CASE WHEN o_orderstatus <> 'P' THEN {written_date(finish, f"{key} % 5")} END,
        'is_current', o_orderstatus = 'P',
        'responsibilities', CASE WHEN o_totalprice > 250000
            THEN array(concat('priority ', o_orderpriority), concat('status ', o_orderstatus))
            ELSE CAST(array() AS ARRAY<STRING>) END)"""
    cert = f"""named_struct(
        'name', concat('Cert-', {key} % 20),
        'issuer', CASE WHEN {key} % 2 <> 0 THEN 'Board' END,
        'date', date_format(o_orderdate, 'yyyy-MM-dd'),
        'expiry', CAST(NULL AS STRING),
        'credential_id', CAST({key} AS STRING))"""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey * 2 AS person_id",
        f"named_struct('ord', struct({start} AS day, {key} AS key), 'item', {job}) AS experience",
        "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' "
        f"THEN named_struct('ord', {key}, 'item', {cert}) END AS certifications",
    )


def experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as_entries(spark, sf_dir).selectExpr(
        "person_id", "experience.ord.key AS entry", "experience.item.*"
    )


def certifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        orders_as_entries(spark, sf_dir)
        .filter("certifications IS NOT NULL")
        .selectExpr("person_id", "certifications.ord AS entry", "certifications.item.*")
    )


def bought_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts each customer ordered: the source of skills and projects."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .selectExpr(
            "o_custkey * 2 AS person_id",
            "p_type AS category",
            "p_name AS skill",
            "p_brand AS brand",
            "l_returnflag",
        )
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resume per person, assembled from the child tables.

    Skills (part names by type) and projects (returned part names by brand) are read off
    the same joined rows, so the largest table is scanned and joined once.
    """
    pairs = bought_parts(spark, sf_dir).selectExpr(
        "person_id",
        """inline(array_compact(array(
            named_struct('section', 'skills', 'grp', category, 'name', skill),
            CASE WHEN l_returnflag = 'R'
                THEN named_struct('section', 'projects', 'grp', brand, 'name', skill) END)))""",
    )
    return nested.assemble_resumes(
        people(spark, sf_dir), [orders_as_entries(spark, sf_dir)], pairs
    )


# Model answers


def with_key(json: str, extra: str) -> str:
    """JSON object with one more key at its end; the last of two equal keys counts."""
    return f"concat(substr({json}, 1, length({json}) - 1), ',{extra}}}')"


def pick(selector: str, *values: str, otherwise: str = "NULL") -> str:
    """Expression number ``selector`` (from 0) of the list."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {selector} {cases} ELSE {otherwise} END"


def resume_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction answers: resumes as JSON, damaged in twenty ways by key."""
    damaged = pick(
        f"{KEY} % 20",
        with_key("json", '"experience":[{"title":"t"}]'),
        with_key("json", '"education":[{"institution":"X","gpa":3.8}]'),
        with_key("json", '"languages":null'),
        with_key("json", '"languages":["a",null]'),
        "concat(json, ' thanks')",
        "concat(json, json)",
        "substr(json, 1, length(json) - 1)",
        with_key("json", '"languages":["z"]'),
        with_key("json", '"raw_text":"x"'),
        with_key("json", '"foo":1'),
        r"concat('```JsOn\n', json, '\n```')",
        with_key("json", '"experience":[{"company":"c","title":"t","is_current":"yes"}]'),
        "concat('[', json, ']')",
        "concat('Here you go: ', json)",
        r"concat('  \n```\n ', json, ' \n``` \n')",
        otherwise="json",
    )
    made = resumes(spark, sf_dir).select(
        "person_id", resume_json(F.col("resume")).alias("json")
    )
    return made.selectExpr("person_id", f"{damaged} AS answer")


PROFILE_ANSWER = f"""named_struct(
    'inferred_job_roles', slice(transform(resume.skills, (g, i) -> named_struct(
        'title', concat(g.category, ' Engineer'),
        'confidence', element_at(array('High', 'Medium', 'Low', 'Unsure'),
            CAST(({KEY} + i) % 4 + 1 AS INT)),
        'reasoning', concat(size(g.skills), ' skills'))), 1, CAST({KEY} % 7 AS INT)),
    'career_level', CASE WHEN {KEY} % 29 = 0 THEN 'Principal'
        WHEN size(resume.experience) < 6 THEN 'Entry'
        WHEN size(resume.experience) < 8 THEN 'Junior'
        WHEN size(resume.experience) < 10 THEN 'Mid'
        WHEN size(resume.experience) < 12 THEN 'Senior'
        WHEN size(resume.experience) < 15 THEN 'Lead' ELSE 'Executive' END,
    'total_years_experience', CAST({KEY} % 400 AS DOUBLE) / 10,
    'skill_categories', transform(resume.skills, (g, i) -> named_struct(
        'category', g.category,
        'skills', g.skills,
        'proficiency_level', element_at(
            array('Expert', 'Advanced', 'Intermediate', 'Beginner', 'Guru'),
            CAST(({KEY} + i) % 5 + 1 AS INT)))),
    'profile_completeness', named_struct(
        'overall_score', {KEY} % 104 - 1,
        'has_education', size(resume.education) > 0,
        'missing_sections', array()),
    'industry_domains', array(resume.personal_info.location),
    'key_strengths', slice(array('strength-1', 'strength-2', 'strength-3', 'strength-4',
        'strength-5', 'strength-6'), 1, CAST({KEY} % 7 AS INT)))"""


def profile_answers(made: DataFrame) -> DataFrame:
    """Analysis answers for the customers among the resumes, damaged in ten ways by key.

    Suppliers get no answer.
    """
    damaged = pick(
        f"{KEY} % 12",
        with_key("json", '"profile_completeness":{"overall_score":"87"}'),
        with_key("json", '"profile_completeness":{"overall_score":87.5}'),
        with_key("json", '"profile_completeness":null'),
        with_key("json", '"career_level":null'),
        with_key("json", '"total_years_experience":"3.5"'),
        with_key("json", '"total_years_experience":"abc"'),
        with_key("json", '"professional_summary":null'),
        with_key("json", '"original_resume":{"x":1}'),
        with_key("json", '"inferred_job_roles":[{"title":"t","confidence":"High"}]'),
        with_key("json", '"profile_completeness":{"overall_score":true,"has_summary":"on"}'),
        otherwise="json",
    )
    return (
        made.filter("startswith(resume.personal_info.name, 'Customer')")
        .selectExpr("person_id", f"to_json({PROFILE_ANSWER}) AS json")
        .selectExpr(
            "concat_ws('-', 'analysis', person_id) AS request_id",
            "person_id",
            f"{damaged} AS answer",
        )
    )


def profiles(made: DataFrame) -> DataFrame:
    """Analysis answers after the strict check: accepted and refused rows."""
    return conform(profile_answers(made), "answer", "profile")


# Answers with several damages each. Every key chooses for itself, so they meet in all ways.

FAULTY_RESUME = """concat('{',
    CASE k % 5 WHEN 0 THEN '"personal_info":{"name":5,"email":null,"phone":true},'
        WHEN 1 THEN '"personal_info":"none",' ELSE '' END,
    '"experience":[', array_join(transform(sequence(0, CAST(k % 3 AS INT)), i -> concat('{',
        CASE WHEN (k + i) % 4 = 0 THEN '' ELSE '"company":"c",' END,
        CASE WHEN (k + i) % 7 = 0 THEN '"is_current":"maybe",' ELSE '' END,
        CASE WHEN (k + i) % 5 = 0 THEN '"responsibilities":["a",null,3],' ELSE '' END,
        '"title":', CASE WHEN (k + i) % 3 = 0 THEN '7' ELSE '"t"' END, '}')), ','), '],',
    CASE k % 8 WHEN 0 THEN '"skills":[1,{"category":null,"skills":"x"}],' WHEN 1 THEN '"skills":{},' ELSE '' END,
    '"languages":', CASE k % 6 WHEN 0 THEN 'null' WHEN 1 THEN '"x"' WHEN 2 THEN '["en",{}]' ELSE '["en"]' END,
    CASE WHEN k % 11 = 0 THEN ',"raw_text":"x"}' WHEN k % 13 = 0 THEN '' ELSE '}' END)"""

FAULTY_PROFILE = """concat('{',
    CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN '"career_level":null,' ELSE '"career_level":"Mid",' END,
    CASE WHEN k % 6 = 0 THEN '"total_years_experience":"abc",' ELSE '' END,
    CASE WHEN k % 9 = 0 THEN '' ELSE concat('"profile_completeness":{',
        CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN '"overall_score":101,' WHEN 2 THEN '"overall_score":"x",'
            WHEN 3 THEN '"overall_score":null,' ELSE '"overall_score":50,' END,
        '"has_summary":', CASE WHEN k % 5 = 0 THEN '"perhaps"' ELSE 'true' END, '},') END,
    '"professional_summary":', CASE WHEN k % 10 = 0 THEN 'null' ELSE '""' END, '}')"""


def faulty_answers(spark: SparkSession, sf_dir: str, answer: str) -> DataFrame:
    """One answer per order; its key decides what is wrong."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS answer_id", "o_orderkey AS k").selectExpr(
        "answer_id", f"{answer} AS answer"
    )


# Jobs

# Every tenth part is one of seven skills that very many have.
SKILL = "CASE WHEN l_partkey % 10 = 0 THEN concat('Common-', l_partkey % 7) ELSE concat('Skill ', l_partkey) END"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per order, two of a job; names are written in four ways, facts have holes."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr(SKILL)).alias("skills"))
    made = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS posting_id",
        "o_orderdate AS seen_at",
        """CASE o_orderkey % 4 WHEN 0 THEN concat('Company ', o_orderkey div 2)
            WHEN 1 THEN concat(' COMPANY,  ', o_orderkey div 2) WHEN 2 THEN concat('company-', o_orderkey div 2)
            ELSE concat('Company (', o_orderkey div 2, ')') END AS company""",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'Data Engineer' ELSE 'data  engineer' END AS title",
        "CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_totalprice END AS salary",
        "CASE WHEN o_orderkey % 7 < 3 THEN ' ' ELSE concat('Text ', o_orderkey) END AS description",
    )
    return made.join(lines, made.posting_id == lines.l_orderkey, "left").drop("l_orderkey")


def held_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of customers: the parts they ordered."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("l_orderkey"))
    skill = canonical(F.expr(SKILL)).alias("skill")
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select("person_id", skill)


# Pipeline runs


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pipeline run per event; error events are failed runs."""
    return run_columns(table(spark, sf_dir, "events"))


def run_columns(events: DataFrame) -> DataFrame:
    filename = F.concat(F.lit("resume-"), F.col("event_id").cast("string"), F.lit(".pdf"))
    return events.select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "ts",
        (F.col("event_type") != "error").alias("success"),
        F.col("props").alias("profile_data"),
        F.when(F.col("event_id") % 13 != 0, filename).alias("source_filename"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that still exist: customers who are not in debt."""
    return (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_acctbal") >= 0)
        .select(F.col("c_custkey").cast("string").alias("user_id"))
    )


# A whole run


def flow_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of fifty users, a minute apart."""
    return uploads(spark, sf_dir).selectExpr(
        "upload_id", "CASE WHEN user_id IS NOT NULL THEN CAST(upload_id % 50 AS STRING) END AS user_id",
        "filename", "mime", "size_bytes",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(upload_id AS INT), 0) AS uploaded_at",
    )


def flow_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the uploads' texts, with a blank one after each."""
    spaced = F.split(F.replace("text", F.lit("\n"), F.lit("\n  \n")), "\n")
    return uploads(spark, sf_dir).select(F.col("upload_id").alias("doc_id"), F.posexplode(spaced).alias("seq", "text"))


def extraction_model(requests: DataFrame) -> DataFrame:
    """Answers to extraction requests, damaged by key; every 23rd stays out."""
    json = """to_json(named_struct(
        'personal_info', named_struct('name', concat('Person ', doc_id), 'email', concat('p', doc_id, '@example.com')),
        'skills', array(named_struct('category', concat('c', doc_id % 5), 'skills', array(concat('s', doc_id % 7))))))"""
    damaged = pick(
        "doc_id % 10",
        "concat(json, json)",
        "concat('[', json, ']')",
        with_key("json", '"raw_text":"x"'),
        with_key("json", '"languages":null'),
        otherwise="json",
    )
    made = requests.filter("doc_id % 23 <> 0").selectExpr("request_id", "doc_id", f"{json} AS json")
    return made.selectExpr("request_id", f"{damaged} AS answer")


def analysis_model(requests: DataFrame) -> DataFrame:
    """Answers to analysis requests, damaged by key; every 29th stays out."""
    json = """to_json(named_struct(
        'career_level', element_at(array('Entry', 'Mid', 'Senior'), CAST(person_id % 3 AS INT) + 1),
        'total_years_experience', CAST(person_id % 40 AS DOUBLE),
        'profile_completeness', named_struct('overall_score', person_id % 101)))"""
    damaged = pick(
        "person_id % 12",
        with_key("json", '"career_level":null'),
        "substr(json, 1, length(json) - 1)",
        "concat('[', json, ']')",
        otherwise="json",
    )
    made = requests.filter("person_id % 29 <> 0").selectExpr("request_id", "person_id", f"{json} AS json")
    return made.selectExpr("request_id", f"{damaged} AS answer")


# Files


def upload_folder(spark: SparkSession, sf_dir: str, path: str) -> str:
    """One file per upload with its text, in sixteen folders; files of zero bytes where it says so."""
    from pyarrow import fs

    def write(batches):
        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        written = 0
        for batch in batches:
            for folder, name, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system.create_dir(f"{root}/{folder}", recursive=True)
                with system.open_output_stream(f"{root}/{folder}/{name}") as out:
                    out.write(text.encode())
                written += 1
        yield pa.record_batch([pa.array([written])], ["n"])

    named = uploads(spark, sf_dir).selectExpr(
        "concat('d', upload_id % 16) AS folder",
        "filename",
        "CASE WHEN size_bytes = 0 THEN '' ELSE coalesce(text, '') END AS text",
    )
    named.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return path


# Arrivals


def instant(column: str) -> str:
    """A zoneless time as a point in time, the same in every session's time zone."""
    return f"TIMESTAMP'1970-01-01 00:00:00Z' + ({column} - TIMESTAMP_NTZ'1970-01-01 00:00:00')"


def zoneless(column: str) -> str:
    """The way back."""
    return f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + ({column} - TIMESTAMP'1970-01-01 00:00:00Z')"


# Times after all others: files that only tell a stream that time has gone on.
TICKS = ("2030-01-01 00:00:00Z", "2030-01-02 00:00:00Z")


def arrive(rows: DataFrame, at: str, path: str, slices: int, ticks: dict[str, str] | None = None) -> str:
    """Write rows to ``path`` in the order of the expression ``at``, one job and file per slice of time.

    ``ticks`` gives a column its late time (``{tick}`` stands for it); two rows follow then
    that have nothing but that.
    """
    first, last = rows.agg(F.min(F.expr(at)), F.max(F.expr(at))).first()
    step = (last - first) / slices if first is not None else None
    for k in range(slices if step is not None else 0):
        low, high = F.lit(first + k * step), F.lit(first + (k + 1) * step)
        here = (F.expr(at) >= low) & (F.expr(at) < high if k < slices - 1 else F.lit(True))
        rows.filter(here).coalesce(1).write.mode("append").parquet(path)
    for tick in TICKS if ticks else ():
        empty = [f"{ticks[c].format(tick=tick)} AS {c}" if c in ticks else f"CAST(NULL AS {t}) AS {c}" for c, t in rows.dtypes]
        rows.sparkSession.range(1).selectExpr(*empty).coalesce(1).write.mode("append").parquet(path)
    return path


def timed_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A request per event, and its answer ``value`` seconds later; error events get none."""
    events = table(spark, sf_dir, "events")
    asked = events.selectExpr("event_id AS request_id", f"{instant('ts')} AS asked_at")
    later = "make_dt_interval(0, 0, 0, CAST(value AS DECIMAL(18, 6)))"
    given = events.filter("event_type <> 'error'").selectExpr(
        "event_id AS request_id", f"{instant('ts')} + {later} AS answered_at", "props AS answer"
    )
    return asked, given


def late_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the time they arrive: up to forty minutes after they took place."""
    return runs(spark, sf_dir).selectExpr(
        "run_id", "user_id", "success", f"{instant('ts')} AS ts",
        f"{instant('ts')} + make_dt_interval(0, 0, CAST(run_id % 5 AS INT) * 10, 0) AS arrived_at",
    )
