import json

import pytest

from shelfmark import cli
from shelfmark.operators import reading


def test_modes():
    assert [reading.LAYERS[reading.read_mode(**k)] for k in ({}, {"page": 1}, {"brief": "brief.md"}, {"source": True}, {"asset": "a"})] == ["L3", "L3", "L2.5", "L4", "L3"]
    with pytest.raises(ValueError, match="READ_MODE"):
        reading.read_mode(page=1, source=True)


def test_read_one_version(spark):
    v = spark.createDataFrame([("v1", "d", "Aa", "x.pdf", "extracted", 1), ("v2", "d", "Bb", "x.pdf", "partial", 2)], "version_id string, document_id string, source_hash string, filename string, quality string, created_at int")
    v = v.withColumn("metadata", reading.F.lit(None).cast("struct<title:string>")).withColumn("markdown_hash", reading.F.lit("m")).withColumn("brief_hash", reading.F.lit("b")).withColumn("extraction_hash", reading.F.lit("e"))
    d = spark.createDataFrame([("d", "/x.pdf", "v2")], "document_id string, source_path string, current_version string")
    p = spark.createDataFrame([("v2", 1, "one", None), ("v2", 4, "four", None), ("v2", 4, "four", None)], "version_id string, number int, text string, preview string")
    e = spark.createDataFrame([("v2", json.dumps({"assets": {"assets/a": {"sha256": "s", "bytes": 1}}}))], "version_id string, payload string")
    read = lambda *a, **k: reading.read(v, d, p, e, *a, **k).collect()
    assert [(r.number, r.text, r.layer) for r in read("v2", page=2)] == [(4, "four", "L3")] and {r.number for r in read("v2")} == {1, 4}
    assert "[Page 1](full.md#page-1): one" in read("v2", brief="brief.md")[0].markdown and read("v2", source=True)[0].snapshot_path == "objects/bb"
    assert read("v2", asset="assets/a")[0].sha256 == "s" and not read("v1", historical=True)[0].is_current
    for code, args, more in (("NOT_FOUND", ("none",), {}), ("NOT_CURRENT", ("v1",), {}), ("PAGE_NOT_FOUND", ("v2",), {"page": 3}), ("PAGE_NOT_FOUND", ("v2",), {"page": True}), ("SECTION_NOT_FOUND", ("v2",), {"brief": "x"}), ("ASSET_NOT_FOUND", ("v2",), {"asset": "x"})):
        with pytest.raises(ValueError, match=code):
            read(*args, **more)
    with pytest.raises(ValueError, match="STALE_INDEX"):
        reading.readable(v, d, fresh=False)


def test_commands(spark, data, tmp_path, capsys):
    def run(*args):
        code = cli.main(list(args))
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert run("run", "kind_map", data, "--limit", "1")[1]["result"]["truncated"] is True
    assert run("status", data)[1]["result"][0]["n_documents"] > 0 and len(run("audit", data, "--limit", "3")[1]["result"]) == 3
    assert run("search", data, "linearity series", "--limit", "0") == (2, {"ok": False, "error": {"code": "QUERY_LIMIT", "message": "ValueError"}})
    assert run("read", data, "none")[1]["error"]["code"] == "NOT_FOUND" and run("run", "none", data)[0] == 2
    assert run("export", data, str(tmp_path / "b"))[0] == 0 and run("verify-bundle", str(tmp_path / "b"))[1]["result"] == []
