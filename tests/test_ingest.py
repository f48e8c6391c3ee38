from datetime import datetime

import pytest

from shelfmark.operators import ingest, versions
from shelfmark.sources import policy

NOW = datetime(2025, 1, 1)
META = "struct<title:string,kind:string,brand:string,model:string,language:string,external_reference:string,aliases:array<string>>"


def test_ingest_is_idempotent_and_refuses(spark):
    files = spark.createDataFrame(
        [("/l/a.txt", 5, b"hello"), ("/l/b.md", 3, b"\xff\xfe\x00"), ("/l/c.txt", 0, b""), ("/else/d.txt", 1, b"x"), ("/l/e.exe", 1, b"x"), ("/l/f.txt", 10**9, b"x")], "path string, length long, content binary"
    ).withColumn("document_id", ingest.F.lit("clash"))
    files = files.drop("document_id")
    docs = spark.createDataFrame([("doc-1", "/l/a.txt", None)], "document_id string, source_path string, current_version string")
    none = spark.createDataFrame([], policy.TABLES["versions"])
    assert {(r.path, r.code) for r in ingest.refused(files, ["/l"]).collect()} == {("/else/d.txt", "SOURCE_SCOPE"), ("/l/e.exe", "UNSUPPORTED_TYPE"), ("/l/f.txt", "FILE_TOO_LARGE")}
    first = ingest.ingest(files, docs, none, ["/l"], NOW)
    rows = {r.path: r for r in first.collect()}
    assert {p: (r.quality, r.deduplicated, r.metadata.title, r.metadata.kind) for p, r in rows.items()} == {"/l/a.txt": ("extracted", False, "a.txt", "document"), "/l/b.md": ("failed", False, "b.md", "document"), "/l/c.txt": ("empty", False, "c.txt", "document")}
    assert rows["/l/a.txt"].document_id == "doc-1" and rows["/l/c.txt"].document_id.startswith("doc-")
    known = spark.createDataFrame([(r.version_id, r.document_id, r.fingerprint, r.source_hash, r.metadata, r.filename, r.quality, r.created_at) for r in rows.values()], policy.TABLES["versions"])
    again = {r.path: r for r in ingest.ingest(files, docs, known, ["/l"], NOW).collect()}
    assert all(r.deduplicated and r.version_id == rows[p].version_id for p, r in again.items())
    changed = files.withColumn("content", ingest.F.when(ingest.F.col("path") == "/l/a.txt", ingest.F.lit(b"new")).otherwise(ingest.F.col("content")))
    assert {p for p, r in {r.path: r for r in ingest.ingest(changed, docs, known, ["/l"], NOW).collect()}.items() if not r.deduplicated} == {"/l/a.txt"}
    assert ingest.ingest(files.limit(0), docs, known, ["/l"], NOW).count() == 0


def test_stable_files(spark):
    a = spark.createDataFrame([("x", 1, 5), ("y", 1, 5), ("z", 1, 5)], "path string, length long, modified long")
    b = spark.createDataFrame([("x", 1, 5), ("y", 2, 5), ("w", 1, 5)], "path string, length long, modified long")
    assert [r.path for r in ingest.stable(a, b).collect()] == ["x"]


def test_verified_contents(spark):
    import hashlib

    good, bad = hashlib.sha256(b"good").hexdigest(), hashlib.sha256(b"bad").hexdigest()
    v = spark.createDataFrame([("v", "d", good, good.upper(), bad, "0" * 64)], "version_id string, document_id string, source_hash string, markdown_hash string, extraction_hash string, brief_hash string")
    blobs = spark.createDataFrame([(good, b"good"), (bad, b"damaged")], "address string, content binary")
    assert {(r.field, r.problem) for r in versions.verified(v, blobs).collect()} == {("extraction_hash", "hash"), ("brief_hash", "missing")}


def test_policy(tmp_path):
    ok = policy.default_policy([str(tmp_path / "r")])
    assert policy.policy_problem(ok, str(tmp_path / "h")) is None
    for change in ({"x": 1}, {"schema_version": True}, {"schema_version": 2}, {"settle_seconds": 0}, {"settle_seconds": 1.5}, {"publication": "auto"}, {"source_roots": []}, {"source_roots": ["rel"]}, {"extensions": [".exe"]}):
        assert policy.policy_problem({**ok, **change}, str(tmp_path / "h")) == "POLICY_SCHEMA"
    for roots in ([str(tmp_path)], [str(tmp_path / "h" / "in")], [str(tmp_path / "r"), str(tmp_path / "r" / "deep")]):
        assert policy.policy_problem({**ok, "source_roots": roots}, str(tmp_path / "h")) == "SOURCE_SCOPE"
    (tmp_path / "r").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "r")
    assert policy.policy_problem({**ok, "source_roots": [str(tmp_path / "link")]}, str(tmp_path / "h")) == "SOURCE_SCOPE"
    assert policy.policy_problem(None, "/") == "POLICY_SCHEMA"


def test_initialize(spark, tmp_path):
    (tmp_path / "r").mkdir()
    tables = policy.initialize(spark, str(tmp_path / "h"), [str(tmp_path / "r")])
    assert set(tables) == set(policy.TABLES) and all(t.read().count() == 0 for t in tables.values())
    with pytest.raises(ValueError, match="ALREADY_INITIALIZED"):
        policy.initialize(spark, str(tmp_path / "h"), [str(tmp_path / "r")])
    with pytest.raises(ValueError, match="SOURCE_SCOPE"):
        policy.initialize(spark, str(tmp_path / "g"), [str(tmp_path / "absent")])
