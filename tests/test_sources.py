import json

import pandas as pd
import pytest

from shelfmark import cli
from shelfmark.operators import tables
from shelfmark.sources import bundle, files, html
from shelfmark.sources.store import ConflictError, Table
from shelfmark.streaming import settle
from tests.test_library import library


def test_text_files(spark, tmp_path):
    d = tmp_path / "來源 文件"
    d.mkdir()
    for name, data in {"a.txt": b"hello", "b.TXT": b"", "c.txt": b"abc\0def", "d.txt": b"\xff\xfe\x00", "e.md": b"Some ![x](y.png)", "f.md": "\ufeffé".encode(), "g.exe": b"x", "manual 000123.txt": b"hello"}.items():
        (d / name).write_bytes(data)
    listed = files.list_files(spark, [f"file://{tmp_path}"], with_content=True)
    got = {r.path.split("/")[-1]: (r.status, r.warning, r.text) for r in files.text_extraction(listed).collect()}
    assert got == {
        "a.txt": ("extracted", None, "hello"), "b.TXT": ("empty", "NO_EXTRACTED_TEXT", ""), "c.txt": ("failed", "BINARY_TEXT", None), "d.txt": ("failed", "INVALID_UTF8", None), "e.md": ("partial", "MARKDOWN_ASSETS_NOT_IMPORTED", "Some ![x](y.png)"),
        "f.md": ("extracted", None, "é"), "manual 000123.txt": ("extracted", None, "hello"),
    }
    blobs = files.content_addressed(listed)
    assert blobs.count() == 6 and files.content_addressed(listed, blobs.select("sha256")).count() == 0
    assert files.list_files(spark, [f"file://{tmp_path}"]).filter(files.in_scope(files.F.col("path"), [str(tmp_path)])).count() == 7


@pytest.mark.parametrize("complete,code", [(True, None), (False, "INCOMPLETE_INVENTORY"), ("true", "INCOMPLETE_INVENTORY"), (1, "INCOMPLETE_INVENTORY"), (None, "INCOMPLETE_INVENTORY")])
def test_inventory_snapshot(spark, tmp_path, complete, code):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"schema_version": "1.0.0", "meta": {"complete": complete}, "entries": [{"file_id": "a", "parent_id": None, "name": "n", "kind": "file", "size": 1, "integrity": {"sha256": "x"}}]}))
    if code:
        with pytest.raises(ValueError, match=code):
            files.inventory_snapshot(spark, f"file://{p}")
    else:
        assert files.inventory_snapshot(spark, f"file://{p}").first().integrity == {"sha256": "x"}
    for size in (True, -1, 1.5, "x"):
        p.write_text(json.dumps({"schema_version": "1.0.0", "meta": {"complete": True}, "entries": [{"file_id": "a", "name": "n", "kind": "file", "size": size}]}))
        with pytest.raises(ValueError, match="INVENTORY_SCHEMA"):
            files.inventory_snapshot(spark, f"file://{p}")
    p.write_text(json.dumps({"schema_version": "2"}))
    with pytest.raises(ValueError, match="INVENTORY_SCHEMA"):
        files.inventory_snapshot(spark, f"file://{p}")


def test_html(spark):
    page = "<html><title>T</title><script>x</script><p>One &amp; two</p><img src=a.png><table><tr><th rowspan=2>A</th><td>B</td></tr><tr><td colspan='2'>C</td></tr></table>end"
    df = spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "<table><tr><td><table></table></td></tr></table>")], "id int, html string")
    got = {r.id: (r.text, r.n_tables, r.warnings) for r in html.html_text(df, "id", "html").collect()}
    assert got == {1: ("T\n\nOne & two\n[External or missing image; inspect original]\nend", 1, ["EXTERNAL_OR_MISSING_IMAGE"]), 2: ("", 0, []), 4: ("", 1, ["NESTED_TABLE_REQUIRES_REVIEW"])}
    grid = tables.place_in_grid(html.html_rows(df.filter("id = 1"), "id", "html"), "id")
    assert {(r.text, r.row, r.col, r.rowspan, r.colspan, r.header) for r in grid.collect()} == {("A", 0, 0, 2, 1, True), ("B", 0, 1, 1, 1, False), ("C", 1, 1, 1, 2, False)}


def test_store_commits_and_conflicts(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "a int")
    rows = spark.createDataFrame([(1,)], "a int")
    assert t.read().count() == 0 and t.append(rows) == 1 and t.append(rows) == 2
    with pytest.raises(ConflictError):
        t.append(rows, expected=1)
    assert t.read().count() == 2 and t.read(1).count() == 1 and t.last() == 2


def test_bundle(spark, tmp_path):
    files_ = bundle.bundle_files(*library(spark))
    folder = f"file://{tmp_path}/b"
    bundle.write_bundle(files_, folder)
    assert bundle.verify_bundle(spark, folder).count() == 0
    assert {r.path for r in bundle.manifest(files_).collect()} >= {"00_CONSTITUTION.md", "documents/v1/full.md", "documents/v1/brief.md"}
    with pytest.raises(Exception, match="exist"):
        bundle.write_bundle(files_, folder)
    spark.createDataFrame([("documents/v9/../x", "new")], "path string, content string").write.mode("append").parquet(f"{folder}/files")
    assert {r.problem for r in bundle.verify_bundle(spark, folder).collect()} == {"extra"}


OBSERVED = [("p", "s", 0.0, 10.0), ("p", "s", 0.0, 50.0), ("p", "t", 0.0, 60.0), ("p", "t", 0.0, 95.0), ("q", "x", 90.0, 100.0), ("q", "x", 90.0, 131.0)]


def test_settling_as_stream_and_batch(spark, tmp_path):
    want = {("p", "s", 10.0, "waiting"), ("p", "s", 50.0, "staged"), ("p", "t", 60.0, "waiting"), ("p", "t", 95.0, "staged"), ("q", "x", 100.0, "waiting"), ("q", "x", 131.0, "staged")}
    batch = settle.settle_observations(spark.createDataFrame(OBSERVED, settle.OBSERVED))
    assert {(r.path, r.signature, r.seen_at, r.state) for r in batch.collect()} == want
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    for part in (OBSERVED[:3], OBSERVED[3:]):  # a restart between the two
        spark.createDataFrame(part, settle.OBSERVED).coalesce(1).write.mode("append").parquet(src)
        q = settle.settle_stream(spark.readStream.schema(settle.OBSERVED).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.path, r.signature, r.seen_at, r.state) for r in spark.read.parquet(out).collect()} == want


def test_event_windows(spark):
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 01:10"]), "event_type": ["a", "a", "b"]}))
    assert sorted(r.n for r in settle.event_windows(df).collect()) == [1, 2]


def test_command_line(spark, data, capsys):
    assert cli.main(["list"]) == 0 and "p7_found" in json.loads(capsys.readouterr().out)["result"]
    assert cli.main(["run", "status_counts", data]) == 0 and json.loads(capsys.readouterr().out)["ok"]
    assert cli.main(["search", data, "linearity", "--limit", "3"]) == 0 and len(json.loads(capsys.readouterr().out)["result"]) == 3
    assert cli.main(["run", "nothing", data]) == 2 and json.loads(capsys.readouterr().out)["error"]["code"] == "INVALID_COMMAND"
    assert cli.main(["search", data, "x", "--limit", "0"]) == 2 and json.loads(capsys.readouterr().out)["error"]["code"] == "QUERY_LIMIT"
