"""The data source of uploaded files."""

import hashlib

import pytest

from dossier.operators.intake import judge_uploads
from dossier.sources.upload_source import UploadReader, scan_uploads


@pytest.fixture
def root(tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "none").mkdir()
    (tmp_path / "a" / "empty.pdf").write_bytes(b"")
    (tmp_path / "a" / "deep" / "x.docx").write_bytes("héllo".encode())
    (tmp_path / "b" / "y.txt").write_bytes(b"text")
    (tmp_path / "top.PDF").write_bytes(b" \n ")
    return tmp_path


def test_every_file_is_a_row(spark, root):
    rows = {r.filename: r for r in scan_uploads(spark, str(root), content=True).collect()}
    assert {n: (r.folder, r.size_bytes, r.text) for n, r in rows.items()} == {
        "empty.pdf": ("a", 0, ""),
        "x.docx": ("a", 6, "héllo"),
        "y.txt": ("b", 4, "text"),
        "top.PDF": ("", 3, " \n "),
    }
    assert rows["y.txt"].upload_id == hashlib.sha1(f"{root}/b/y.txt".encode()).hexdigest()
    assert all(r.uploaded_at is not None for r in rows.values())


def test_gates_fire(spark, root):
    judged = judge_uploads(scan_uploads(spark, str(root), content=True), "service").collect()
    assert {r.filename: r.reason for r in judged} == {
        "empty.pdf": "empty", "x.docx": None, "y.txt": "type", "top.PDF": "blank_text",
    }


def test_one_folder_is_one_partition(spark, root):
    assert [r.filename for r in scan_uploads(spark, str(root), folder="b").collect()] == ["y.txt"]
    assert scan_uploads(spark, str(root), folder="missing").count() == 0
    assert [p.name for p in UploadReader(str(root), False, 0, "b").partitions()] == ["b"]
    assert len(UploadReader(str(root), False, 0, None).partitions()) == 4


def test_contents_over_the_limit_are_not_loaded(spark, root):
    reader = UploadReader(str(root), True, 4, None)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["filename"]: r["content"] for r in rows}["x.docx"] is None
    assert {r["filename"]: r["content"] for r in rows}["y.txt"] == b"text"


def test_missing_folder_is_an_error(spark, root):
    with pytest.raises(Exception, match="(?i)no such file|does not exist|FileNotFound|not found"):
        scan_uploads(spark, f"{root}/nowhere").collect()
