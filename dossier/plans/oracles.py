"""SQL with the same rows as the registered queries, for DuckDB on the same tables.

Written apart from the Spark code: expectations for damaged answers come from the key
that chose the damage, not from a JSON parser, and lists are put together with SQL
aggregates.
"""

from __future__ import annotations

from ..fixed import DOCX, MSWORD, PDF, PROMPT_CHARS, WHITESPACE
from ..operators.requests import ANALYSIS, EXTRACTION, Template
from .standins import AS_OF


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def _blank(column: str) -> str:
    return f"trim({column}, {_WS}) = ''"


# Uploads

_UPLOADS = f"""
uploads AS (
    SELECT doc_id AS upload_id,
        CASE WHEN doc_id % 19 <> 0 THEN CAST(doc_id AS VARCHAR) END AS user_id,
        source || '_' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx'
            WHEN 2 THEN '.doc' WHEN 3 THEN '.PDF' WHEN 4 THEN '.txt' ELSE '' END AS filename,
        CASE doc_id // 6 % 5 WHEN 0 THEN '{PDF}' WHEN 1 THEN '{DOCX}' WHEN 2 THEN '{MSWORD}'
            WHEN 3 THEN 'application/octet-stream' END AS mime,
        CASE WHEN doc_id % 97 = 0 THEN 0 WHEN doc_id % 89 = 0 THEN 10485760
            WHEN doc_id % 83 = 0 THEN 10485761 ELSE n_chars * 1024 END AS size_bytes,
        CASE WHEN doc_id % 101 = 0 THEN ' ' || chr(10) || chr(9) || ' ' ELSE text END AS text
    FROM documents),
typed AS (
    SELECT *,
        CASE WHEN mime IN ('{PDF}', '{DOCX}', '{MSWORD}') THEN mime
            WHEN lower(filename) LIKE '%.pdf' THEN '{PDF}'
            WHEN lower(filename) LIKE '%.docx' THEN '{DOCX}' END AS service_type,
        CASE WHEN coalesce(mime, '') = '{PDF}' OR lower(filename) LIKE '%.pdf' THEN '{PDF}'
            WHEN coalesce(mime, '') = '{DOCX}' OR lower(filename) LIKE '%.docx' THEN '{DOCX}'
        END AS gateway_type,
        coalesce(mime, '') IN ('{PDF}', '{DOCX}', '{MSWORD}')
            OR regexp_matches(lower(filename), '[.](pdf|docx|doc)$') AS client_ok
    FROM uploads),
gates AS (
    SELECT 'service' AS caller, *,
        CASE WHEN service_type IS NULL THEN 'type' WHEN size_bytes > 10485760 THEN 'size'
            WHEN size_bytes = 0 THEN 'empty' WHEN {_blank('text')} THEN 'blank_text' ELSE ''
        END AS reason FROM typed
    UNION ALL SELECT 'gateway', *,
        CASE WHEN user_id IS NULL THEN 'auth' WHEN gateway_type IS NULL THEN 'type'
            WHEN size_bytes > 10485760 THEN 'size'
            WHEN size_bytes = 0 OR {_blank('text')} THEN 'pipeline' ELSE '' END FROM typed
    UNION ALL SELECT 'client', *,
        CASE WHEN NOT client_ok THEN 'type' WHEN size_bytes > 10485760 THEN 'size' ELSE '' END
    FROM typed),
judged AS (
    SELECT *,
        CAST(CASE WHEN reason = '' OR caller = 'client' THEN 0
            WHEN caller = 'service' THEN CASE reason WHEN 'type' THEN 415 WHEN 'size' THEN 413
                WHEN 'empty' THEN 400 ELSE 422 END
            ELSE CASE reason WHEN 'auth' THEN 401 WHEN 'pipeline' THEN 500 ELSE 400 END
        END AS BIGINT) AS status,
        CASE caller || ' ' || reason
            WHEN 'service type' THEN 'Unsupported file type ''' || coalesce(mime, '')
                || '''. Please upload a PDF or DOCX file.'
            WHEN 'service size' THEN 'File exceeds maximum size of 10 MB.'
            WHEN 'service empty' THEN 'Uploaded file is empty.'
            WHEN 'service blank_text' THEN 'Could not extract any text from the uploaded file.'
            WHEN 'gateway auth' THEN 'Unauthorized'
            WHEN 'gateway type' THEN 'Unsupported file type. Only PDF and DOCX are accepted.'
            WHEN 'gateway size' THEN 'File exceeds 10 MB limit.'
            WHEN 'gateway pipeline' THEN CASE WHEN size_bytes = 0
                THEN 'Pipeline exited with an error.'
                ELSE 'Could not extract any text from the uploaded file.' END
            WHEN 'client type' THEN 'Only PDF and DOCX files are supported.'
            WHEN 'client size' THEN 'File must be under 10 MB.' ELSE '' END AS error
    FROM gates)
"""

# People and resumes

_PEOPLE = """
places AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
people AS (
    SELECT c_custkey * 2 AS person_id, c_custkey AS k, c_name AS name, n_name, r_name,
        c_mktsegment AS segment
    FROM customer JOIN places ON c_nationkey = n_nationkey
    UNION ALL
    SELECT s_suppkey * 2 + 1, s_suppkey, s_name, n_name, r_name, NULL
    FROM supplier JOIN places ON s_nationkey = n_nationkey)
"""


def _written(day: str) -> str:
    return f"""CASE o_orderkey % 5 WHEN 0 THEN strftime({day}, '%Y-%m-%d')
        WHEN 1 THEN strftime({day}, '%Y-%m') WHEN 2 THEN strftime({day}, '%m/%Y')
        WHEN 3 THEN strftime({day}, '%b %Y') ELSE strftime({day}, '%Y') END"""


_ENTRIES = f"""
days AS (
    SELECT *, CAST(o_orderdate AS DATE) AS s0,
        least(CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 336 AS INTEGER),
            DATE '{AS_OF}') AS e0
    FROM orders),
jobs AS (
    SELECT o_custkey * 2 AS person_id, o_orderkey AS entry, s0,
        'Company-' || (o_orderkey % 50) AS company,
        o_orderpriority AS title,
        CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE o_orderstatus END AS location,
        CASE WHEN o_orderkey % 53 = 0 THEN 'n/a' ELSE {_written('s0')} END AS start_date,
        CASE WHEN o_orderstatus <> 'P' THEN {_written('e0')} END AS end_date,
        o_orderstatus = 'P' AS is_current,
        CASE WHEN o_totalprice > 250000 THEN ['priority ' || o_orderpriority,
            'status ' || o_orderstatus] ELSE CAST([] AS VARCHAR[]) END AS responsibilities
    FROM days),
certs AS (
    SELECT o_custkey * 2 AS person_id, o_orderkey AS entry,
        'Cert-' || (o_orderkey % 20) AS name,
        CASE WHEN o_orderkey % 2 <> 0 THEN 'Board' END AS issuer,
        strftime(o_orderdate, '%Y-%m-%d') AS date,
        CAST(NULL AS VARCHAR) AS expiry, CAST(o_orderkey AS VARCHAR) AS credential_id
    FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
"""

_BOUGHT = """
bought AS (
    SELECT o_custkey * 2 AS person_id, p_type AS category, p_name AS skill, p_brand AS brand,
        l_returnflag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
skill_groups AS (
    SELECT person_id, category, list(DISTINCT skill ORDER BY skill) AS skills
    FROM bought GROUP BY ALL),
project_groups AS (
    SELECT person_id, brand, list(DISTINCT skill ORDER BY skill) AS technologies
    FROM bought WHERE l_returnflag = 'R' GROUP BY ALL)
"""

_RESUMES = f"""{_PEOPLE}, {_ENTRIES}, {_BOUGHT},
job_lists AS (
    SELECT person_id, list(struct_pack(company := company, title := title, location := location,
        start_date := start_date, end_date := end_date, is_current := is_current,
        responsibilities := responsibilities) ORDER BY s0, entry) AS items
    FROM jobs GROUP BY person_id),
cert_lists AS (
    SELECT person_id, list(struct_pack(name := name, issuer := issuer, date := date,
        expiry := expiry, credential_id := credential_id) ORDER BY entry) AS items
    FROM certs GROUP BY person_id),
skill_lists AS (
    SELECT person_id, list(struct_pack(category := category, skills := skills)
        ORDER BY category) AS items FROM skill_groups GROUP BY person_id),
project_lists AS (
    SELECT person_id, list(struct_pack(name := brand, description := CAST(NULL AS VARCHAR),
        technologies := technologies, url := CAST(NULL AS VARCHAR),
        start_date := CAST(NULL AS VARCHAR), end_date := CAST(NULL AS VARCHAR))
        ORDER BY brand) AS items FROM project_groups GROUP BY person_id),
resumes AS (
    SELECT person_id, k, name, segment, n_name,
        struct_pack(name := name,
            email := CASE WHEN k % 7 <> 0 THEN lower(name) || '@example.com' END,
            phone := CASE WHEN k % 5 = 0 THEN NULL WHEN k % 11 = 0 THEN ''
                ELSE '+1-555-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END,
            location := n_name, linkedin := CAST(NULL AS VARCHAR),
            github := CAST(NULL AS VARCHAR), website := CAST(NULL AS VARCHAR),
            summary := CASE WHEN k % 3 <> 0 THEN segment || ' professional' END
        ) AS personal_info,
        CASE WHEN segment <> 'HOUSEHOLD' THEN [struct_pack(
            institution := r_name || ' University', degree := segment,
            field_of_study := CASE WHEN k % 2 <> 0 THEN n_name END,
            start_date := CAST(NULL AS VARCHAR),
            end_date := CASE k % 4 WHEN 1 THEN '1994' WHEN 2 THEN '' END,
            gpa := CASE k % 3 WHEN 1 THEN '' WHEN 2 THEN '3.5' END,
            description := CAST(NULL AS VARCHAR))] ELSE [] END AS education,
        coalesce(j.items, []) AS experience,
        coalesce(p.items, []) AS projects,
        coalesce(c.items, []) AS certifications,
        coalesce(s.items, []) AS skills,
        CASE WHEN r_name = 'AFRICA' THEN CAST([] AS VARCHAR[]) ELSE [n_name, r_name] END
            AS languages
    FROM people LEFT JOIN job_lists j USING (person_id)
        LEFT JOIN project_lists p USING (person_id)
        LEFT JOIN cert_lists c USING (person_id)
        LEFT JOIN skill_lists s USING (person_id))
"""


def _json(languages: str = "languages", experience: str = "experience") -> str:
    return f"""CAST(to_json(struct_pack(personal_info := personal_info, education := education,
        experience := {experience}, projects := projects, certifications := certifications,
        skills := skills, languages := {languages})) AS VARCHAR)"""


_SIZES = """len(education) AS n_education, len(experience) AS n_experience,
        len(projects) AS n_projects, len(certifications) AS n_certifications,
        len(skills) AS n_skills, len(languages) AS n_languages"""

_ONE_JOB = """[struct_pack(company := 'c', title := 't', location := CAST(NULL AS VARCHAR),
        start_date := CAST(NULL AS VARCHAR), end_date := CAST(NULL AS VARCHAR),
        is_current := true, responsibilities := CAST([] AS VARCHAR[]))]"""

# Profiles: what each answer says before damage, and what damage number d does to it.
_PROFILES = f"""{_RESUMES},
said AS (
    SELECT *, k % 12 AS d, k % 104 - 1 AS score0,
        CASE WHEN k % 29 = 0 THEN 'Principal' WHEN len(experience) < 6 THEN 'Entry'
            WHEN len(experience) < 8 THEN 'Junior' WHEN len(experience) < 10 THEN 'Mid'
            WHEN len(experience) < 12 THEN 'Senior' WHEN len(experience) < 15 THEN 'Lead'
            ELSE 'Executive' END AS level
    FROM resumes WHERE segment IS NOT NULL),
verdicts AS (
    SELECT *,
        CASE WHEN d = 8 THEN 'inferred_job_roles' WHEN d = 3 THEN 'career_level'
            WHEN d = 5 THEN 'total_years_experience' WHEN d IN (1, 2) THEN 'profile_completeness'
            WHEN d NOT IN (0, 9) AND score0 NOT BETWEEN 0 AND 100 THEN 'profile_completeness'
            WHEN d = 6 THEN 'professional_summary' ELSE '' END AS bad_field,
        CASE d WHEN 0 THEN 87 WHEN 9 THEN 1 ELSE score0 END AS score,
        CASE WHEN d = 4 THEN 3.5 ELSE CAST(k % 400 AS DOUBLE) / 10 END AS years
    FROM said),
accepted AS (SELECT * FROM verdicts WHERE bad_field = ''),
roles AS (
    SELECT person_id, k, pos, skills[pos].category || ' Engineer' AS title,
        ['High', 'Medium', 'Low', 'Unsure'][(k + pos - 1) % 4 + 1] AS confidence,
        len(skills[pos].skills) || ' skills' AS reasoning
    FROM (SELECT *, unnest(range(1, least(k % 7, len(skills)) + 1)) AS pos FROM accepted))
"""

_RUNS = """
runs AS (
    SELECT event_id AS run_id, CAST(user_id AS VARCHAR) AS user_id, ts,
        event_type <> 'error' AS success, props AS profile_data,
        CASE WHEN event_id % 13 <> 0 THEN 'resume-' || event_id || '.pdf' END AS source_filename
    FROM events),
last_run AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, run_id DESC) AS rn,
        min(ts) OVER (PARTITION BY user_id) AS created_at
    FROM runs WHERE success),
stored AS (
    SELECT substr(md5(user_id), 1, 8) || '-' || substr(md5(user_id), 9, 4) || '-'
            || substr(md5(user_id), 13, 4) || '-' || substr(md5(user_id), 17, 4) || '-'
            || substr(md5(user_id), 21, 12) AS id,
        user_id, profile_data, coalesce(source_filename, '') AS source_filename,
        CAST(created_at AS VARCHAR) AS created_at, CAST(ts AS VARCHAR) AS updated_at
    FROM last_run WHERE rn = 1),
live_users AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer WHERE c_acctbal >= 0)
"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def _request(t: Template, keys: str, request_id: str, body: str, source: str) -> str:
    prompt = f"{_q(t.before)} || {body} || {_q(t.after)}"
    return f"""SELECT {keys}, {request_id} AS request_id, {_q(t.kind)} AS kind,
        {_q(t.system)} AS system, CAST(length({prompt}) AS BIGINT) AS n_chars,
        md5({prompt}) AS prompt_md5, CAST({t.temperature} AS DOUBLE) AS temperature,
        CAST({t.max_tokens} AS BIGINT) AS max_tokens FROM {source}"""


_LINES = f"""
lines AS (
    SELECT doc_id, list_filter(string_split(replace(text, chr(10), chr(10) || '  ' || chr(10)),
        chr(10)), lambda x: NOT ({_blank('x')})) AS kept FROM documents),
joined AS (SELECT doc_id, len(kept) AS n_units, array_to_string(kept, chr(10)) AS t FROM lines)
"""

_DATED = f"""
dated AS (
    SELECT o_custkey * 2 AS person_id,
        CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN s0
            WHEN o_orderkey % 5 = 4 THEN CAST(date_trunc('year', s0) AS DATE)
            ELSE CAST(date_trunc('month', s0) AS DATE) END AS s,
        CASE WHEN o_orderstatus = 'P' THEN DATE '{AS_OF}' WHEN o_orderkey % 5 = 0 THEN e0
            WHEN o_orderkey % 5 = 4 THEN CAST(date_trunc('year', e0) AS DATE)
            ELSE CAST(date_trunc('month', e0) AS DATE) END AS e
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS s0,
        least(CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 336 AS INTEGER),
            DATE '{AS_OF}') AS e0 FROM orders)),
usable AS (SELECT * FROM dated WHERE s IS NOT NULL AND e >= s),
marked AS (
    SELECT *, CASE WHEN s > max(e) OVER w OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS opens
    FROM usable
    WINDOW w AS (PARTITION BY person_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING)),
islands AS (
    SELECT person_id, island, min(s) AS s, max(e) AS e
    FROM (SELECT *, sum(opens) OVER (PARTITION BY person_id ORDER BY s, e
        ROWS UNBOUNDED PRECEDING) AS island FROM marked) GROUP BY person_id, island),
totals AS (
    SELECT person_id, count(*) AS n_periods, CAST(sum(e - s) AS BIGINT) AS days
    FROM islands GROUP BY person_id),
entries AS (
    SELECT person_id, count(*) AS n_entries,
        count(*) FILTER (NOT coalesce(s IS NOT NULL AND e >= s, false)) AS n_ignored
    FROM dated GROUP BY person_id)
"""

_FLAGS = """
flags AS (
    SELECT person_id,
        k % 7 <> 0 OR (k % 5 <> 0 AND k % 11 <> 0) AS has_contact_info,
        segment IS NOT NULL AND k % 3 <> 0 AS has_summary,
        len(education) > 0 AS has_education, len(experience) > 0 AS has_experience,
        len(skills) > 0 AS has_skills, len(projects) > 0 AS has_projects,
        len(certifications) > 0 AS has_certifications
    FROM resumes)
"""

_SECTION_ROWS = {
    "education": "education[i].institution",
    "experience": "experience[i].company",
    "projects": "projects[i].name",
    "certifications": "certifications[i].credential_id",
    "skills": "skills[i].category",
    "languages": "languages[i]",
}
_INNER = {"experience": "responsibilities", "projects": "technologies", "skills": "skills"}

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_PHONE = r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"

_STORED_ROWS = "SELECT id, user_id, profile_data, source_filename, created_at, updated_at FROM stored"

# Every upload's way through the whole run, told from the keys that damage it.
_FLOW = f"""{_UPLOADS.strip()},
assembled AS (
    SELECT upload_id, filename, user_id, mime, size_bytes, service_type,
        CASE WHEN service_type = '{PDF}' THEN replace(text, chr(10), chr(10) || '  ' || chr(10))
            ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT ({_blank('x')})), chr(10)) END AS text
    FROM typed),
ended AS (
    SELECT *, upload_id AS k, CASE WHEN service_type IS NULL THEN 'intake type' WHEN size_bytes > 10485760 THEN 'intake size'
        WHEN size_bytes = 0 THEN 'intake empty' WHEN text IS NULL OR {_blank('text')} THEN 'intake blank_text'
        WHEN upload_id % 23 = 0 THEN 'extraction no_answer' WHEN upload_id % 10 = 0 THEN 'extraction malformed'
        WHEN upload_id % 10 = 1 THEN 'extraction not_object' WHEN upload_id % 10 = 2 THEN 'extraction reserved_key'
        WHEN upload_id % 10 = 3 THEN 'extraction invalid' WHEN upload_id % 29 = 0 THEN 'analysis no_answer'
        WHEN upload_id % 12 = 0 THEN 'analysis invalid' WHEN upload_id % 12 = 1 THEN 'analysis malformed'
        WHEN upload_id % 12 = 2 THEN 'analysis not_object' ELSE 'done ' END AS way
    FROM assembled),
told AS (SELECT *, split_part(way, ' ', 1) AS step, split_part(way, ' ', 2) AS reason FROM ended),
kept AS (SELECT k % 50 AS u, max(k) AS k FROM told WHERE step = 'done' AND user_id IS NOT NULL GROUP BY k % 50)"""

_JOBS = """WITH skills AS (
    SELECT l_orderkey, CASE WHEN l_partkey % 10 = 0 THEN 'common ' || l_partkey % 7 ELSE 'skill ' || l_partkey END AS skill
    FROM lineitem),
required AS (SELECT DISTINCT l_orderkey // 2 AS j, skill FROM skills),
held AS (SELECT DISTINCT o_custkey AS person_id, skill FROM skills JOIN orders ON l_orderkey = o_orderkey),
jobs AS (SELECT o_orderkey // 2 AS j, min(o_orderkey) AS job_id FROM orders GROUP BY 1),
"""

ORACLES: dict[str, str] = {
    "intake_types": _with(
        _UPLOADS,
        """SELECT upload_id, filename, coalesce(service_type, '') AS service_type,
            coalesce(gateway_type, '') AS gateway_type, client_ok FROM typed""",
    ),
    "upload_scan": _with(
        _UPLOADS,
        f"""SELECT folder, filename, CAST(strlen(content) AS BIGINT) AS size_bytes, coalesce(file_type, '') AS file_type,
            reason, CAST(CASE reason WHEN '' THEN 0 WHEN 'type' THEN 415 WHEN 'empty' THEN 400 ELSE 422 END AS BIGINT) AS status,
            md5(content) AS text_md5
        FROM (SELECT *, CASE WHEN file_type IS NULL THEN 'type' WHEN content = '' THEN 'empty'
                WHEN {_blank('content')} THEN 'blank_text' ELSE '' END AS reason
            FROM (SELECT 'd' || upload_id % 16 AS folder, filename,
                CASE WHEN size_bytes = 0 THEN '' ELSE coalesce(text, '') END AS content,
                CASE WHEN lower(filename) LIKE '%.pdf' THEN '{PDF}'
                    WHEN lower(filename) LIKE '%.docx' THEN '{DOCX}' END AS file_type FROM uploads))""",
    ),
    "intake_gates": _with(
        _UPLOADS, "SELECT caller, upload_id, reason, status, error FROM judged"
    ),
    "intake_quarantine": _with(
        _UPLOADS,
        """SELECT upload_id, reason, status, error FROM judged
        WHERE caller = 'service' AND reason <> ''""",
    ),
    "intake_valid": _with(
        _UPLOADS,
        """SELECT upload_id, service_type AS file_type, CAST(size_bytes AS BIGINT) AS size_bytes,
            md5(text) AS text_md5 FROM judged WHERE caller = 'service' AND reason = ''""",
    ),
    "run_summary": _with(
        _UPLOADS,
        """SELECT source, success, reason, status, count(*) AS n,
            round(CAST(sum(CASE WHEN success THEN count(*) ELSE 0 END)
                OVER (PARTITION BY source) AS DOUBLE)
                / CAST(sum(count(*)) OVER (PARTITION BY source) AS DOUBLE), 6) AS success_share
        FROM (SELECT caller AS source, reason = '' AS success, reason, status FROM judged
            UNION ALL SELECT 'pipeline', event_type <> 'error',
                CASE WHEN event_type = 'error' THEN 'pipeline' ELSE '' END,
                CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 0 END AS BIGINT) FROM events)
        GROUP BY source, success, reason, status""",
    ),
    "error_texts": """SELECT event_id, CASE WHEN value >= 20 THEN props
        WHEN value >= 2 AND value < 10 THEN event_type
        ELSE 'Pipeline exited with an error.' END AS error FROM events""",
    "page_assembly": """SELECT conv_id AS doc_id, count(*) AS n_units,
        CAST(length(string_agg(text, chr(10) ORDER BY turn)) AS BIGINT) AS n_chars,
        md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5
        FROM conversations GROUP BY conv_id""",
    "text_units": f"""WITH units AS (
        SELECT conv_id * 3 + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END
            AS doc_id, turn, role, text FROM conversations)
        SELECT doc_id, CASE WHEN max(role) = 'system' THEN '' ELSE md5(coalesce(
                string_agg(text, chr(10) ORDER BY turn)
                    FILTER (role = 'user' OR NOT ({_blank('text')})), '')) END AS text_md5,
            CASE WHEN max(role) = 'system' THEN
                'Unsupported file type: text/plain. Only PDF and DOCX are supported.'
            ELSE '' END AS error
        FROM units GROUP BY doc_id""",
    "paragraph_assembly": _with(
        _LINES,
        """SELECT doc_id, n_units, CAST(length(t) AS BIGINT) AS n_chars,
            md5(t) AS text_md5 FROM joined""",
    ),
    "paragraph_lines": _with(
        _LINES, "SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM joined"
    ),
    "leading_text": _with(
        _LINES,
        f"""SELECT doc_id, CAST(length(substr(t, 1, {PROMPT_CHARS})) AS BIGINT) AS n_chars,
            md5(substr(t, 1, {PROMPT_CHARS})) AS text_md5 FROM joined""",
    ),
    "extraction_requests": _request(
        EXTRACTION,
        "doc_id",
        "'extraction-' || doc_id",
        "text",
        "documents",
    ),
    "profile_requests": _with(
        _RESUMES,
        _request(
            ANALYSIS, "person_id", "'analysis-' || person_id", _json(), "resumes"
        ),
    ),
    "contacts": f"""WITH found AS (
        SELECT DISTINCT doc_id, 'email' AS kind,
            unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM documents
        UNION ALL SELECT DISTINCT doc_id, 'phone',
            unnest(regexp_extract_all(text, '{_PHONE}')) FROM documents)
        SELECT kind, value, doc_id, count(*) OVER (PARTITION BY kind, value) AS n_docs
        FROM found""",
    "response_cleaning": """SELECT event_id, CASE event_id % 6
        WHEN 4 THEN 'Result: ```' || props ELSE props END AS cleaned FROM events""",
    "response_json": """SELECT event_id, reason, CAST(CASE reason WHEN '' THEN 0
            WHEN 'malformed' THEN 422 ELSE 500 END AS BIGINT) AS status
        FROM (SELECT event_id, CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN ''
            WHEN 4 THEN 'not_object' WHEN 6 THEN 'reserved_key' WHEN 7 THEN 'not_object'
            ELSE 'malformed' END AS reason FROM events)""",
    "resume_conformance": _with(
        f"""{_RESUMES},
judged AS (
    SELECT *, CASE WHEN k % 20 IN (0, 1, 2, 3) THEN 'invalid'
        WHEN k % 20 IN (4, 5, 6, 13) THEN 'malformed' WHEN k % 20 = 8 THEN 'reserved_key'
        WHEN k % 20 = 12 THEN 'not_object' ELSE '' END AS reason,
        CASE WHEN k % 20 = 7 THEN ['z'] ELSE languages END AS l2,
        CASE WHEN k % 20 = 11 THEN {_ONE_JOB} ELSE experience END AS e2 FROM resumes)""",
        f"""SELECT person_id, reason = '' AS accepted, reason,
            CAST(CASE reason WHEN '' THEN 0 WHEN 'invalid' THEN 422 WHEN 'malformed' THEN 422
                ELSE 500 END AS BIGINT) AS status,
            CASE k % 20 WHEN 0 THEN 'experience' WHEN 1 THEN 'education' WHEN 2 THEN 'languages'
                WHEN 3 THEN 'languages' ELSE '' END AS bad_field,
            {", ".join(
                f"CASE WHEN reason = '' THEN len({c}) ELSE -1 END AS n_{s}"
                for s, c in (
                    ("education", "education"), ("experience", "e2"), ("projects", "projects"),
                    ("certifications", "certifications"), ("skills", "skills"),
                    ("languages", "l2"),
                )
            )},
            CASE WHEN reason = '' THEN md5({_json('l2', 'e2')}) ELSE '' END AS resume_md5
        FROM judged""",
    ),
    "profile_conformance": _with(
        _PROFILES,
        """SELECT person_id, CASE WHEN bad_field = '' THEN '' ELSE 'invalid' END AS reason,
            bad_field,
            CAST(CASE WHEN bad_field = '' THEN score ELSE -1 END AS BIGINT) AS overall_score,
            bad_field = '' AND d = 9 AS has_summary, false AS has_skills,
            CASE WHEN bad_field = '' THEN level ELSE '' END AS career_level,
            CASE WHEN bad_field = '' THEN years ELSE -1.0 END AS total_years,
            CAST(CASE WHEN bad_field = '' THEN k % 7 ELSE -1 END AS BIGINT) AS n_strengths,
            CASE WHEN bad_field = '' THEN '' ELSE 'refused' END AS professional_summary
        FROM verdicts""",
    ),
    "merged_postings": _JOBS + """
facts AS (SELECT o_orderkey // 2 AS j, *,
    CASE o_orderkey % 4 WHEN 0 THEN 'Company ' || o_orderkey // 2 WHEN 1 THEN ' COMPANY,  ' || o_orderkey // 2
        WHEN 2 THEN 'company-' || o_orderkey // 2 ELSE 'Company (' || o_orderkey // 2 || ')' END AS company,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Data Engineer' ELSE 'data  engineer' END AS title FROM orders),
lists AS (SELECT j, string_agg(skill, ',' ORDER BY skill) AS skills FROM required GROUP BY j)
SELECT min(o_orderkey) AS job_id, count(*) AS n_postings,
    strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen, strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen,
    last(company ORDER BY o_orderdate, o_orderkey) AS company, last(title ORDER BY o_orderdate, o_orderkey) AS title,
    coalesce(last(o_totalprice ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderkey % 5 >= 2), -1.0) AS salary,
    coalesce(last('Text ' || o_orderkey ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderkey % 7 >= 3), '')
        AS description, coalesce(any_value(lists.skills), '') AS skills
FROM facts LEFT JOIN lists USING (j) GROUP BY j""",
    "suitable_jobs": _JOBS + """
sizes AS (SELECT j, count(*) AS n_required FROM required GROUP BY j),
met AS (SELECT person_id, j, count(*) AS matched FROM held JOIN required USING (skill) GROUP BY 1, 2),
ranked AS (SELECT person_id, j, job_id, matched, n_required, row_number() OVER (PARTITION BY person_id
        ORDER BY matched / n_required DESC, matched DESC, job_id) AS rank
    FROM met JOIN sizes USING (j) JOIN jobs USING (j) WHERE 100 * matched >= 40 * n_required QUALIFY rank <= 3),
gaps AS (SELECT person_id, j, string_agg(skill, ',' ORDER BY skill) AS missing FROM ranked JOIN required USING (j)
    ANTI JOIN held USING (person_id, skill) GROUP BY 1, 2)
SELECT person_id, rank, job_id, matched, n_required, coalesce(missing, '') AS missing
FROM ranked LEFT JOIN gaps USING (person_id, j)""",
    "answer_faults": """
WITH keys AS (SELECT o_orderkey AS answer_id, o_orderkey AS k FROM orders),
entries AS (SELECT answer_id, [[
        CASE WHEN (k + i) % 4 = 0 THEN 'experience[' || i || '].company: missing' END,
        CASE WHEN (k + i) % 3 = 0 THEN 'experience[' || i || '].title: text' END,
        CASE WHEN (k + i) % 7 = 0 THEN 'experience[' || i || '].is_current: flag' END,
        CASE WHEN (k + i) % 5 = 0 THEN 'experience[' || i || '].responsibilities[1]: text' END,
        CASE WHEN (k + i) % 5 = 0 THEN 'experience[' || i || '].responsibilities[2]: text' END]
        FOR i IN range(0, k % 3 + 1)] AS jobs
    FROM keys),
listed AS (
    SELECT k, answer_id, 'resume' AS record,
        CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 'malformed' WHEN k % 11 = 0 THEN 'reserved_key' ELSE '' END AS problem,
        list_concat([CASE WHEN k % 5 = 0 THEN 'personal_info.name: text' END,
            CASE WHEN k % 5 = 0 THEN 'personal_info.phone: text' END,
            CASE WHEN k % 5 = 1 THEN 'personal_info: object' END], flatten(jobs),
            [CASE WHEN k % 8 = 0 THEN 'skills[0]: object' END,
            CASE WHEN k % 8 = 0 THEN 'skills[1].category: text' END,
            CASE WHEN k % 8 = 0 THEN 'skills[1].skills: list' END,
            CASE WHEN k % 8 = 1 THEN 'skills: list' END,
            CASE WHEN k % 6 < 2 THEN 'languages: list' END,
            CASE WHEN k % 6 = 2 THEN 'languages[1]: text' END]) AS places
    FROM keys JOIN entries USING (answer_id)
    UNION ALL
    SELECT k, answer_id, 'profile', '',
        [CASE k % 4 WHEN 0 THEN 'career_level: missing' WHEN 1 THEN 'career_level: text' END,
        CASE WHEN k % 6 = 0 THEN 'total_years_experience: number' END,
        CASE WHEN k % 9 = 0 THEN 'profile_completeness: missing' END,
        CASE WHEN k % 9 <> 0 THEN 'profile_completeness.overall_score: '
            || CASE k % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'range' WHEN 2 THEN 'whole' WHEN 3 THEN 'whole' END END,
        CASE WHEN k % 9 <> 0 AND k % 5 = 0 THEN 'profile_completeness.has_summary: flag' END,
        CASE WHEN k % 10 = 0 THEN 'professional_summary: text' END] FROM keys),
found AS (SELECT *, CASE WHEN problem <> '' THEN ['answer: ' || problem]
        ELSE [x FOR x IN places IF x IS NOT NULL] END AS faults FROM listed)
SELECT answer_id, record,
    CASE WHEN problem <> '' THEN problem WHEN len(faults) > 0 THEN 'invalid' ELSE '' END AS reason,
    CASE WHEN problem = '' AND len(faults) > 0 THEN regexp_extract(faults[1], '^[a-z_]+') ELSE '' END AS bad_field,
    CAST(len(faults) AS BIGINT) AS n_faults,
    CASE WHEN len(faults) > 0 THEN len(faults) || ' faults' || chr(10) || array_to_string(faults, chr(10))
        ELSE '' END AS error
FROM found""",
    "domain_audit": _with(
        _PROFILES,
        """SELECT field, value, count(*) AS n FROM (
            SELECT 'confidence' AS field, confidence AS value FROM roles
            WHERE confidence NOT IN ('High', 'Medium', 'Low')
            UNION ALL SELECT 'career_level', level FROM accepted WHERE level = 'Principal'
            UNION ALL SELECT 'proficiency_level', 'Guru' FROM (
                SELECT k, unnest(range(len(skills))) AS pos FROM accepted)
            WHERE (k + pos) % 5 = 4) GROUP BY field, value""",
    ),
    "cardinality_audit": _with(
        _PROFILES,
        """SELECT person_id, CAST(least(k % 7, len(skills)) AS BIGINT) AS n_roles,
            least(k % 7, len(skills)) BETWEEN 2 AND 5 AS roles_ok,
            CAST(k % 7 AS BIGINT) AS n_strengths, k % 7 BETWEEN 2 AND 5 AS strengths_ok
        FROM accepted""",
    ),
    "nest_skills": _with(
        _BOUGHT,
        """SELECT person_id, count(*) AS n_categories,
            string_agg(category || ':' || array_to_string(skills, ','), ';' ORDER BY category)
                AS skills
        FROM skill_groups GROUP BY person_id""",
    ),
    "assemble_resume": _with(
        _RESUMES,
        f"""SELECT person_id, {_SIZES}, md5({_json()}) AS resume_md5
        FROM resumes""",
    ),
    "flatten_sections": _with(
        _RESUMES,
        " UNION ALL ".join(
            f"""SELECT person_id, '{s}' AS section, i - 1 AS pos, {label} AS label
            FROM (SELECT *, unnest(range(1, len({s}) + 1)) AS i FROM resumes)"""
            for s, label in _SECTION_ROWS.items()
        ),
    ),
    "flatten_inner": _with(
        _RESUMES,
        " UNION ALL ".join(
            f"""SELECT person_id, '{s}' AS section, i - 1 AS pos, j - 1 AS inner_pos,
                items[j] AS value
            FROM (SELECT person_id, i, items, unnest(range(1, len(items) + 1)) AS j
                FROM (SELECT person_id, i, {s}[i].{inner} AS items
                    FROM (SELECT *, unnest(range(1, len({s}) + 1)) AS i FROM resumes)))"""
            for s, inner in _INNER.items()
        ),
    ),
    "attach_resume": _with(
        _PROFILES,
        f"""SELECT 'analysis-' || person_id AS request_id, person_id,
            level AS career_level, md5({_json()}) AS resume_md5 FROM accepted""",
    ),
    "unanswered_requests": """SELECT 'analysis-' || (s_suppkey * 2 + 1) AS request_id,
        s_suppkey * 2 + 1 AS person_id FROM supplier""",
    "years_experience": _with(
        _DATED,
        """SELECT person_id, n_entries, n_ignored, coalesce(n_periods, 0) AS n_periods,
            coalesce(days, 0) AS days, round(coalesce(days, 0) / 365.25, 1) AS years
        FROM entries LEFT JOIN totals USING (person_id)""",
    ),
    "completeness": _with(
        f"{_RESUMES}, {_FLAGS}",
        """SELECT *, array_to_string(list_filter([
                CASE WHEN NOT has_contact_info THEN 'contact_info' END,
                CASE WHEN NOT has_summary THEN 'summary' END,
                CASE WHEN NOT has_education THEN 'education' END,
                CASE WHEN NOT has_experience THEN 'experience' END,
                CASE WHEN NOT has_skills THEN 'skills' END,
                CASE WHEN NOT has_projects THEN 'projects' END,
                CASE WHEN NOT has_certifications THEN 'certifications' END],
                lambda x: x IS NOT NULL), ',') AS missing_sections,
            CAST(round(100.0 * (has_contact_info::INT + has_summary::INT + has_education::INT
                + has_experience::INT + has_skills::INT + has_projects::INT
                + has_certifications::INT) / 7) AS BIGINT) AS section_coverage_pct
        FROM flags""",
    ),
    "rank_roles": _with(
        _PROFILES,
        """SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY
                CASE confidence WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3
                ELSE 4 END, pos) AS rank,
            CAST(pos AS BIGINT) AS given_pos, title, confidence,
            lower(confidence) AS confidence_key, reasoning FROM roles""",
    ),
    "timeline": _with(
        _ENTRIES,
        """SELECT person_id, entry, title,
            company || CASE WHEN location <> '' THEN ' · ' || location ELSE '' END
                AS organisation,
            start_date || CASE WHEN is_current THEN ' – Present' ELSE ' – ' || end_date END
                AS dates FROM jobs""",
    ),
    "education_lines": _with(
        _PEOPLE,
        """SELECT person_id, r_name || ' University' AS institution,
            segment || CASE WHEN k % 2 <> 0 THEN ' · ' || n_name ELSE '' END
                || CASE WHEN k % 3 = 2 THEN ' · GPA: 3.5' ELSE '' END AS meta,
            CASE WHEN k % 4 = 1 THEN ' – 1994' ELSE '' END AS dates
        FROM people WHERE segment <> 'HOUSEHOLD'""",
    ),
    "certification_lines": _with(
        _ENTRIES,
        """SELECT person_id, entry, name, coalesce(issuer || ' · ', '') || date || ' · ID: '
            || credential_id AS meta FROM certs""",
    ),
    "links": """SELECT page_id, written, CASE WHEN written LIKE 'http%' THEN written
            ELSE 'https://' || written END AS href
        FROM (SELECT page_id, CASE WHEN page_id % 2 = 1
            THEN regexp_replace(url, '^https?://', '') ELSE url END AS written FROM pages)""",
    "identity": """SELECT user_id, display_name, upper(substr(display_name, 1, 1)) AS avatar
        FROM (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 2 THEN lower(c_name)
            WHEN 3 THEN lower(c_name) WHEN 1 THEN lower(c_mktsegment) ELSE 'there' END
                AS display_name FROM customer)""",
    "stat_cards": _with(
        _PROFILES,
        """SELECT r.person_id, CASE WHEN a.person_id IS NULL THEN 'resume' ELSE 'profile' END
                AS card_set,
            coalesce(a.level, len(r.experience) || ' roles') AS card_1,
            coalesce(a.score || '%', CAST(coalesce(list_sum(list_transform(r.skills,
                lambda g: len(g.skills))), 0) AS BIGINT) || ' found') AS card_2,
            coalesce(CASE WHEN a.years = floor(a.years) THEN CAST(CAST(a.years AS BIGINT) AS
                VARCHAR) ELSE CAST(a.years AS VARCHAR) END || ' Yrs',
                len(r.projects) || ' listed') AS card_3,
            coalesce(least(a.k % 7, len(a.skills)) || ' roles', len(r.education) || ' entries')
                AS card_4
        FROM resumes r LEFT JOIN accepted a USING (person_id)""",
    ),
    "upsert_batch": _with(_RUNS, _STORED_ROWS),
    "profile_store": _with(_RUNS, _STORED_ROWS),
    "cascade_store": _with(_RUNS, f"{_STORED_ROWS} WHERE user_id IN (SELECT user_id FROM live_users)"),
    "own_profile": _with(_RUNS, f"{_STORED_ROWS} WHERE user_id = '7'"),
    "upsert_stream": _with(_RUNS, _STORED_ROWS),
    "upsert_restart": _with(_RUNS, _STORED_ROWS),
    "timed_answers": """SELECT event_id AS request_id, in_time AS success,
            CASE WHEN in_time THEN '' ELSE 'no answer within 60 seconds' END AS error,
            CASE WHEN in_time THEN props ELSE '' END AS answer,
            CASE WHEN in_time THEN '' ELSE 'no answer within 60 seconds' END AS error_in_json
        FROM (SELECT *, event_type <> 'error' AND round(value, 6) <= 60 AS in_time FROM events)""",
    "run_windows": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type <> 'error' AS success,
            count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2""",
    "visible_profiles": _with(
        _RUNS,
        """SELECT 'service' AS reader, user_id, profile_data FROM stored
        UNION ALL SELECT 'user 7', user_id, profile_data FROM stored WHERE user_id = '7'""",
    ),
    "cascade": _with(_RUNS, f"{_STORED_ROWS} WHERE user_id IN (SELECT user_id FROM live_users)"),
    "constraint_audit": _with(
        f"""{_RUNS},
loose AS (SELECT CASE WHEN success THEN user_id END AS user_id,
    CASE WHEN source_filename IS NOT NULL THEN profile_data END AS profile_data FROM runs)""",
        """SELECT 'null_user_id' AS violation, '' AS user_id, count(*) AS n_rows FROM loose
            WHERE user_id IS NULL
        UNION ALL SELECT 'null_profile_data', coalesce(user_id, ''), count(*) FROM loose
            WHERE profile_data IS NULL GROUP BY user_id
        UNION ALL SELECT 'duplicate_user_id', user_id, count(*) FROM loose
            WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1
        UNION ALL SELECT 'orphan_user_id', user_id, count(*) FROM loose
            WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM live_users)
            GROUP BY user_id""",
    ),
    "whole_run": _with(
        _FLOW,
        """SELECT upload_id, step, reason,
            CAST(CASE reason WHEN '' THEN 0 WHEN 'type' THEN 415 WHEN 'size' THEN 413 WHEN 'empty' THEN 400
                WHEN 'no_answer' THEN 500 WHEN 'not_object' THEN 500 WHEN 'reserved_key' THEN 500 ELSE 422 END AS BIGINT) AS status,
            step = 'done' AS success, error, error AS error_in_json, name, level, score, text_md5, stored
        FROM (SELECT *, CASE WHEN step = 'done' THEN '' WHEN reason = 'no_answer' THEN 'no answer within 60 seconds'
                WHEN step <> 'intake' THEN 'answer refused: ' || reason
                WHEN reason = 'type' THEN 'Unsupported file type ''' || coalesce(mime, '')
                    || '''. Please upload a PDF or DOCX file.'
                WHEN reason = 'size' THEN 'File exceeds maximum size of 10 MB.' WHEN reason = 'empty' THEN 'Uploaded file is empty.'
                ELSE 'Could not extract any text from the uploaded file.' END AS error,
            CASE WHEN step = 'done' THEN 'Person ' || k ELSE '' END AS name,
            CASE WHEN step = 'done' THEN ['Entry', 'Mid', 'Senior'][k % 3 + 1] ELSE '' END AS level,
            CASE WHEN step = 'done' THEN CAST(k % 101 AS VARCHAR) ELSE '' END AS score,
            md5(CASE WHEN step = 'done' THEN text ELSE '' END) AS text_md5,
            k IN (SELECT k FROM kept) AS stored FROM told)""",
    ),
    "whole_run_counts": _with(_FLOW, "SELECT step, reason, count(*) AS n FROM told GROUP BY step, reason"),
    "envelope": _with(
        _PROFILES,
        """SELECT 'analysis-' || person_id AS request_id, bad_field = '' AS success,
            CASE WHEN bad_field = '' THEN '' ELSE 'answer refused: invalid' END AS error,
            CASE WHEN bad_field = '' THEN level ELSE '' END AS level,
            CASE WHEN bad_field = '' THEN name ELSE '' END AS name,
            CASE WHEN bad_field = '' THEN '' ELSE 'answer refused: invalid' END AS error_in_json,
            CASE WHEN bad_field = '' THEN 'true' ELSE 'false' END AS success_in_json,
            bad_field = '' AS keeps_nulls,
            md5(CASE WHEN bad_field = '' THEN coalesce(text, '') ELSE '' END) AS text_md5,
            md5(CASE WHEN bad_field = '' THEN coalesce(text, '') ELSE '' END) AS inner_text_md5
        FROM verdicts LEFT JOIN documents ON doc_id = k""",
    ),
}
