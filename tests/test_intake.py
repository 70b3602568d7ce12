from dossier.fixed import DOCX, MSWORD, PDF
from dossier.functions import files
from dossier.operators.intake import intake, judge_uploads
from dossier.sources.uploads import text_units, upload_files
from pyspark.sql import functions as F

ROWS = "upload_id string, user_id string, mime string, filename string, size_bytes long, text string"


def uploads(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def test_type_rules_disagree(spark):
    cases = [
        # mime, name, service, gateway, client
        (PDF, "a.txt", PDF, PDF, True),
        (DOCX, "a.pdf", DOCX, PDF, True),
        (MSWORD, "a.bin", MSWORD, None, True),
        (MSWORD, "a.PDF", MSWORD, PDF, True),
        (None, "a.doc", None, None, True),
        (None, "a.DocX", DOCX, DOCX, True),
        ("text/plain", "a.pdf.txt", None, None, False),
        (None, None, None, None, False),
        (None, "a.pdf\n", None, None, False),
    ]
    frame = spark.createDataFrame(
        cases, "mime string, name string, service string, gateway string, client boolean"
    )
    mime, name = F.col("mime"), F.col("name")
    for row in frame.select(
        "*",
        files.file_type_service(mime, name).alias("s"),
        files.file_type_gateway(mime, name).alias("g"),
        files.file_ok_client(mime, name).alias("c"),
    ).collect():
        assert (row.s, row.g, row.c) == (row.service, row.gateway, row.client), row


def test_size_limit_is_inclusive(spark):
    limit = 10 * 1024 * 1024
    frame = spark.createDataFrame([(limit - 1,), (limit,), (limit + 1,)], "n long")
    assert [r[0] for r in frame.select(files.size_ok(F.col("n"))).collect()] == [True, True, False]


def test_first_failing_gate_decides(spark):
    frame = uploads(
        spark,
        ("ok", "u", PDF, "a.pdf", 5, "text"),
        ("type before size", "u", None, "a.txt", 99999999, ""),
        ("size before blank", "u", PDF, "a.pdf", 99999999, " "),
        ("empty before blank", "u", PDF, "a.pdf", 0, " "),
        ("blank", "u", PDF, "a.pdf", 5, "   \n\t"),
        ("no text", "u", PDF, "a.pdf", 5, None),
    )
    good, bad = intake(frame, "service")
    assert [r.upload_id for r in good.collect()] == ["ok"]
    assert {r.upload_id: (r.reason, r.status) for r in bad.collect()} == {
        "type before size": ("type", 415),
        "size before blank": ("size", 413),
        "empty before blank": ("empty", 400),
        "blank": ("blank_text", 422),
        "no text": ("blank_text", 422),
    }
    assert good.count() + bad.count() == frame.count()


def test_gateway_order(spark):
    frame = uploads(
        spark,
        ("nobody", None, None, None, None, None),
        ("no file", "u", None, None, None, None),
        ("type", "u", MSWORD, "a.doc", 99999999, "x"),
        ("size", "u", PDF, "a", 99999999, "x"),
        ("empty", "u", PDF, "a", 0, "x"),
        ("ok", "u", PDF, "a", 1, "x"),
    )
    got = {r.upload_id: (r.reason, r.status) for r in judge_uploads(frame, "gateway").collect()}
    assert got == {
        "nobody": ("auth", 401),
        "no file": ("no_file", 400),
        "type": ("type", 400),
        "size": ("size", 400),
        "empty": ("pipeline", 500),
        "ok": (None, None),
    }


def test_folder_scan_does_not_read_contents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"12345")
    (tmp_path / "in" / "b.docx").write_bytes(b"1")
    frame = upload_files(spark, str(tmp_path))
    assert {r.filename: r.size_bytes for r in frame.collect()} == {"a.pdf": 5, "b.docx": 1}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_text_units_by_type(spark, tmp_path):
    rows = [(1, 0, "p", PDF), (2, 0, "q", MSWORD), (3, 0, "r", "text/plain"), (3, 1, "s", "text/plain")]
    path = str(tmp_path / "units")
    spark.createDataFrame(rows, "doc_id long, seq long, text string, mime string").write.parquet(path)
    known, other = text_units(spark, path)
    assert {(r.doc_id, r.kind) for r in known.collect()} == {(1, "page"), (2, "paragraph")}
    assert [(r.doc_id, r.error) for r in other.collect()] == [
        (3, "Unsupported file type: text/plain. Only PDF and DOCX are supported.")
    ]
