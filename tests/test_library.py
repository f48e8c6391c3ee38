import math
import re
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import assets, health, inventory, navigation, quality, reading, search, tables, versions
from shelfmark.operators.ordinals import with_ordinal

T = [datetime(2024, 1, d) for d in range(1, 20)]


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


def test_folding(spark):
    for s, want in (("AX-100", "ax100"), ("ﬁne ²", "fine2"), ("Straße", "strasse"), ("  \n", ""), ("第一頁🙂", "第一頁")):
        assert tx.fold(s) == want == one(spark, s, tx.folded_exact)
    assert one(spark, "Straße, AX-100", tx.folded) == "strasseax100" and one(spark, None, tx.folded_exact) is None
    assert tx.search_terms(" AX-100  -- The ") == ["ax100", "the"]


@pytest.mark.parametrize("s", ["", "  a\n b [x] <y> ", "\u3000a\u00a0\x1fb", "x" * 400, "é" * 161, "[]<>" * 60])
def test_labels_and_excerpts_follow_the_rule(spark, s):
    label = lambda t: " ".join(t.split()).replace("[", "\\[").replace("]", "\\]").replace("<", "&lt;").replace(">", "&gt;")
    assert one(spark, s, tx.label) == label(s)
    assert one(spark, s, tx.excerpt) == (label(s.strip()[:160]) or "[No extracted text]")


def test_names(spark):
    rows = [("a.PDF", ".pdf", "pdf", False), (".md", "", "md", False), ("pdf", "", "pdf", False), ("x.docx.md", ".md", "md", True), ("x.docx.MD", ".md", "md", False), ("a/b.txt", ".txt", "txt", False), ("pdf.md", ".md", "md", True)]
    for name, suffix, ext, side in rows:
        assert (one(spark, name, tx.suffix), one(spark, name, tx.extension), one(spark, name, tx.is_sidecar)) == (suffix, ext, side), name


def test_paths_magic_and_addresses(spark):
    for p, ok in (("a/b.md", True), ("/a", False), ("a/../b", False), ("ä", False), ("a b", False)):
        assert one(spark, p, tx.safe_bundle_path) is ok
    for b, kind in ((b"\x89PNG\r\n\x1a\n..", "png"), (b"\xff\xd8\xff\xe0", "jpg"), (b"GIF89a", "gif"), (b"BM12", "bmp"), (b"%PDF-1", "pdf"), (b"text", "bin")):
        assert one(spark, b, tx.magic_kind, "binary") == kind
    for p, want in (("a\\b", "a/b"), ("/a", None), ("a/./b", None), ("C:/x", None), ("", None)):
        assert one(spark, p, assets.relative_model_path) == want


def model_tree(n, fanout, brief):
    out, cards = {}, {}

    def build(items, address):
        cards[address] = 1
        if len(items) <= fanout:
            out.update({x: (address, i) for i, x in enumerate(items)})
            return
        width = math.ceil(len(items) / fanout)
        stem = "" if address == "brief.md" else address.split("/")[-1][:-3] + "-"
        for i, at in enumerate(range(0, len(items), width), 1):
            build(items[at : at + width], f"sections/{stem}{i}.md" if brief else f"{address[:-3]}-{i}.md")

    build(list(range(n)), "brief.md" if brief else "m.md")
    return out, len(cards)


@pytest.mark.parametrize("n", [1, 8, 9, 33, 65, 577, 1000])
def test_brief_tree_equals_recursive_model(spark, n):
    df = spark.range(n).select(F.col("id").alias("o"), F.lit(n).alias("k"))
    got = {r.o: (r.card, r.position) for r in navigation.leaf_addresses(df, F.lit("brief.md"), 8, True).collect()}
    assert got == model_tree(n, 8, True)[0]


@pytest.mark.parametrize("n", [32, 33, 1000, 2000])
def test_catalog_tree_equals_recursive_model(spark, n):
    df = spark.range(n).select(F.col("id").alias("o"), F.lit(n).alias("k"))
    got = {r.o: (r.card, r.position) for r in navigation.leaf_addresses(df, F.lit("m.md"), 32, False).collect()}
    assert got == model_tree(n, 32, False)[0]


def test_ordinals_of_hot_and_null_groups(spark):
    rows = [("hot", i) for i in range(500)] + [("b", i) for i in range(3)] + [(None, i) for i in range(4)]
    got = with_ordinal(spark.createDataFrame(rows[::-1], "g string, i int"), "g", ["i"]).collect()
    assert all(r.o == r.i for r in got) and {r.g: r.k for r in got} == {"hot": 500, "b": 3, None: 4}


@pytest.mark.parametrize("texts", [["", "", "ab", "", "c"], ["a"], [""], ["é🙂", " ", "x\n"], []])
def test_spans_slice_back(spark, texts):
    df = spark.createDataFrame([("v", i, t) for i, t in enumerate(texts, 1)], "version_id string, number int, text string")
    whole = ""
    want = {}
    for i, t in enumerate(texts, 1):
        if whole:
            whole += "\n\n"
        want[i] = (len(whole), len(whole) + len(t))
        whole += t
    assert {r.number: (r.start, r.end) for r in reading.spans(df).collect()} == want
    if texts:
        assert reading.joined_text(df).first().text == whole


def library(spark):
    meta = "struct<title:string,kind:string,brand:string,model:string,language:string,external_reference:string,aliases:array<string>>"
    v = spark.createDataFrame(
        [("v1", "d1", ("T", "guide", None, None, "en", "000123", ["AX-100"]), "a.pdf", "extracted", T[0]), ("v2", "d1", None, "a.pdf", "partial", T[1]), ("v3", "d2", (None, None, None, None, None, None, None), "b.txt", "extracted", T[0])],
        f"version_id string, document_id string, metadata {meta}, filename string, quality string, created_at timestamp_ntz",
    )
    v = v.unionByName(v).withColumn("source_hash", F.lit("AB")).withColumn("fingerprint", F.lit("ff")).withColumn("source_path", F.lit("clash")).withColumn("extra", F.create_map(F.lit("a"), F.lit("b")))
    d = spark.createDataFrame([("d1", "/x/a.pdf", "v1"), ("d2", "/x/b.txt", "v3"), ("d3", "/x/c", None)], "document_id string, source_path string, current_version string")
    p = spark.createDataFrame([("v1", 1, "Rinse the noz", None), ("v1", 2, "zle now", "assets/p"), ("v1", 2, "zle now", "assets/p"), ("v3", 1, None, None), ("v2", 1, "x", ""), ("v2", 2, " ", None)], "version_id string, number int, text string, preview string")
    return v, d, p


def test_search(spark):
    v, d, p = library(spark)
    run = lambda q, **k: {(r.document_id, r.version_id, r.matching_pages) for r in search.search(v, d, p, q, **k).collect()}
    assert run("rinse") == {("d1", "v1", "1")}
    assert run("ax100") == {("d1", "v1", "")} == run("nozzle")
    assert run("rinse zle") == {("d1", "v1", "1,2")}
    assert run("rinse absent") == set()
    assert run("") == {("d1", "v1", ""), ("d2", "v3", "")} and run("", kind="guide") == {("d1", "v1", "")} and run("", kind="document") == {("d2", "v3", "")}
    top = search.first_results(search.search(v, d, p), 1).collect()
    assert [(r.document_id, r.total, r.truncated) for r in top] == [("d1", 2, True)]
    for bad in (0, 101, True):
        with pytest.raises(ValueError, match="QUERY_LIMIT"):
            search.first_results(search.search(v, d, p), bad)


def test_versions(spark):
    v, d, p = library(spark)
    assert {(r.document_id, r.newer) for r in versions.newer_candidates(v, d).collect()} == {("d1", True), ("d2", False)}
    assert {(r.document_id, r.version_id) for r in versions.latest(v).collect()} == {("d1", "v2"), ("d2", "v3")}
    assert [r.version_id for r in versions.history(v, "d1").collect()] == ["v1", "v2"] and versions.history(v, "none").count() == 0
    assert versions.status_counts(v, d).first().asDict() == {"n_documents": 3, "n_versions": 3, "n_current": 2}
    assert {r.kind: r.n for r in versions.kind_map(v, d).collect()} == {"guide": 1, "document": 1}
    assert versions.duplicate_fingerprints(v).first().n == 2 and versions.identical_sources(v).first().n_documents == 2
    known = spark.createDataFrame([("d", "1", "v1")], "document_id string, fingerprint string, version_id string")
    assert versions.new_fingerprints(known.union(spark.createDataFrame([("d", "2", "v2"), ("d", "2", "v3")], known.schema)), known).count() == 1
    empty = v.limit(0)
    assert versions.latest(empty).count() == 0 and search.search(empty, d.limit(0), p.limit(0), "x").count() == 0


def test_quality_and_rendering(spark):
    v, d, p = library(spark)
    got = {r.version_id: (r.n_pages, r.n_with_text, r.status, r.warning) for r in quality.page_quality(v, p).collect()}
    assert got == {"v1": (2, 2, "extracted", None), "v2": (2, 1, "partial", "PAGES_WITHOUT_TEXT"), "v3": (1, 0, "empty", "NO_EXTRACTED_TEXT")}
    md = {r.version_id: r.markdown for r in reading.full_markdown(v, p).collect()}
    assert "\n## Page 2\n\nzle now\n\n[Original page preview](assets/p)\n\n" in md["v1"] and "# b.txt\n" in md["v3"] and md["v1"].startswith("---\nschema_version: 1\n")
    for t, want in (("", "EMPTY"), (" \n", "EMPTY"), ("ocr_status: needs_ocr", "OCR_REQUIRED"), ("Tier 2 lite sidecar", "METADATA_ONLY"), ("## 摘要\nx\n## 原始檔", "BRIEF_ONLY"), ("status: FULL\nx", "TEXT_UNVERIFIED")):
        assert one(spark, t, quality.sidecar_status) == want
    log = spark.createDataFrame([("Orphan cell nearest-row fallback occurred",), ("OSD warning at /secret",), ("fine",), (None,)], "x string")
    assert [r.m for r in log.select(quality.pipeline_markers(F.col("x"), F.lit(False)).alias("m")).collect()] == [["DOCLING_PIPELINE_TABLEFALLBACK"], ["DOCLING_PIPELINE_OSD", "DOCLING_PIPELINE_WARNING"], [], []]
    leaks = spark.createDataFrame([("-----BEGIN RSA PRIVATE KEY-----",), ("ghp_" + "a" * 36,), ("/home/me/x C:\\Users\\a\\b",), (None,)], "text string")
    assert {r.pattern: r.n_texts for r in quality.leak_counts(leaks).collect()} == {"private-key": 1, "github-token": 1, "google-token": 0, "cloud-document-url": 0, "private-windows-path": 1, "private-unix-path": 1}
    req = spark.createDataFrame([(".pdf", "eng+deu", "cpu", 2.0), (".zip", "eng", "cpu", 1.0), (".pdf", "Eng", "cpu", 1.0), (".pdf", "eng", "tpu", 1.0), (".pdf", "eng", "cpu", 9.0), (None, None, None, None)], "s string, l string, d string, x double")
    got = [r.c for r in req.select(quality.request_problem(F.col("s"), F.col("l"), F.col("d"), F.col("x")).alias("c")).collect()]
    assert got == [None, "DOCLING_PROFILE_UNSUPPORTED", "INVALID_OCR_LANGUAGE", "INVALID_DOCLING_DEVICE", "INVALID_DOCLING_OCR_SCALE", "DOCLING_PROFILE_UNSUPPORTED"]


def test_inventory_fixture(spark):
    rows = [
        ("source", "root", "manual.pdf", "file", 100, "a" * 64), ("brief", "root", "manual.pdf.md", "file", 100, None), ("notes", "root", "_NOTES.md", "file", 100, None), ("map", "root", "_AI_MAP.md", "file", 0, None), ("old", "archive", "manual.pdf", "file", 0, None),
        ("orphan", "root", "missing.docx.md", "file", 0, None), ("no-brief", "root", "form.docx", "file", 100, "A" * 64), ("dir", "root", "form.docx.md", "folder", None, None), ("twin", "root", "manual.pdf", "file", 100, "b" * 64), ("pdf", "root", "pdf", "file", None, None),
    ]
    e = spark.createDataFrame(rows, "file_id string, parent_id string, name string, kind string, size long, sha256 string").withColumn("top_id", F.lit("clash"))
    places = spark.createDataFrame([(r[0], "archive" if r[1] == "archive" else "root", "rooted") for r in rows], "file_id string, top_id string, tree_state string")
    roots = spark.createDataFrame([("root", "root"), ("archive", "archive")], "file_id string, root_role string")
    sc = inventory.scoped(e.drop("top_id").join(places, "file_id"), roots)
    assert {r["class"]: r.n for r in inventory.class_counts(sc).collect()} == {"source_documents": 4, "sidecars": 2, "human_note_files": 1, "generated_files": 1, "archived_files": 1, "folder": 1, "files": 9}
    assert {r.file_id for r in inventory.without_sidecar(sc).collect()} == {"no-brief", "pdf"}
    assert {r.file_id for r in inventory.without_original(sc).collect()} == {"orphan"}
    assert {r.file_id for r in inventory.empty_files(sc).collect()} == {"orphan"}
    assert [(r.name, r.n) for r in inventory.name_conflicts(sc).collect()] == [("manual.pdf", 2)]
    assert [(r.sha256, r.n) for r in inventory.identical_bytes(sc).collect()] == [("a" * 64, 2)]
    bad = spark.createDataFrame([("", "p", "n", "file", 1), ("a", "p", None, "file", 1), ("b", "p", "n", "link", 1), ("c", "p", "n", "file", -1), ("d", "d", "n", "folder", None), ("ok", None, "n", "file", None)], "file_id string, parent_id string, name string, kind string, size long")
    assert {r.problem for r in inventory.violations(bad).collect()} == {"missing id", "missing name", "unknown kind", "negative size", "own parent"}


def test_tables(spark):
    cell = "t string, row int, col int, rowspan int, colspan int, text string, header boolean"
    cells = spark.createDataFrame([("a", 0, 0, 2, 1, "<x> & \"'\n", True), ("a", 0, 1, 1, 2, "b", None), ("b", 0, 0, 2, 2, "x", None), ("b", 1, 1, 1, 1, "y", None)], cell)
    size = spark.createDataFrame([("a", 2, 3), ("b", 2, 2), ("c", 20000, 1), ("d", 1, 1)], "t string, rows int, cols int")
    assert [(r.t, r.r, r.c, r.n) for r in tables.overlaps(cells, ["t"]).collect()] == [("b", 1, 1, 2)]
    html = {r.t: r.html for r in tables.table_html(cells.filter("t = 'a'"), size, ["t"]).collect()}
    assert html["a"] == '<table>\n<tr><th rowspan="2" colspan="1">&lt;x&gt; &amp; &quot;&#x27;<br></th><td rowspan="1" colspan="2">b</td></tr>\n<tr><td></td><td></td></tr>\n</table>'
    assert html["d"] == "<table>\n<tr><td></td></tr>\n</table>" and "c" not in html
    wide = spark.createDataFrame([("a", 0, 2, 1, 2, "out", None)], cell)
    assert {(r.t, r.problem) for r in tables.span_problems(wide, size, ["t"]).collect()} == {("c", "dimensions"), ("a", "span")}
    rows = spark.createDataFrame([("t", 0, 0, 2, 1, "A", True), ("t", 0, 1, 1, 2, "B", False), ("t", 1, 0, 1, 1, "C", False), ("t", 1, 1, 1, 1, "D", False)], "k string, r int, i int, rowspan int, colspan int, text string, header boolean")
    assert {(r.text, r.row, r.col) for r in tables.place_in_grid(rows, "k").collect()} == {("A", 0, 0), ("B", 0, 1), ("C", 1, 1), ("D", 1, 2)}
    cov = tables.page_coverage(spark.createDataFrame([("v", 1), ("v", 1), ("v", 4)], "version_id string, number int"), spark.createDataFrame([("v", 3), ("w", 2), ("z", 0)], "version_id string, n int"))
    assert {r.version_id: (r.missing, r.extra, r.duplicated) for r in cov.collect()} == {"v": (2, 1, 1), "w": (2, 0, 0), "z": (0, 0, 0)}
    left = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, position int, item string")
    assert tables.paired_by_position(left, left.limit(1), "k").filter("right_item is null").count() == 1


def test_assets(spark):
    sha = "0" * 64
    a = spark.createDataFrame([("v", f"assets/{sha}.png", sha, "5", "image/png", "x"), ("v", "assets/bad.png", sha, "5", "m", "r"), ("v", f"assets/{sha}.pdf", sha, "-1", "m", "r"), ("v", f"assets/{sha}.bin", sha, "1", None, "r"), ("w", f"assets/{sha}.bin", sha, str(200 << 20), "m", "r")], "version_id string, asset string, sha256 string, bytes string, media_type string, role string")
    assert {(r.version_id, r.problem) for r in assets.manifest_problems(a).collect()} == {("v", "address"), ("v", "size"), ("v", "metadata"), ("w", "total")}
    refs = spark.createDataFrame([("v", f"assets/{sha}.png", "image"), ("v", "assets/none", "preview"), ("v", None, "image")], "version_id string, asset string, kind string")
    assert [(r.asset, r.kind) for r in assets.unresolved(refs, a).collect()] == [("assets/none", "preview")]
    f = lambda rows: spark.createDataFrame(rows, "path string, bytes long, sha256 string")
    diff = assets.file_differences(f([("a", 1, "X"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")]), f([("a", 1, "x"), ("b", 2, "y"), ("c", 1, "y"), ("e", 1, "x")]))
    assert {(r.path, r.problem) for r in diff.collect()} == {("b", "size"), ("c", "hash"), ("d", "missing"), ("e", "extra")}
    paths = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/a",)], "path string")
    assert [(r.inner, r.outer) for r in assets.overlapping_paths(paths).collect()] == [("/a/b", "/a")]


def test_health(spark):
    s = spark.createDataFrame([(1, "a", T[0], T[0], True, None), (2, "b", T[5], T[5], True, None), (3, "c", T[5], T[4], False, "io"), (4, "c", T[4], T[4], True, None)], "scan_id long, root string, attempted_at timestamp_ntz, success_at timestamp_ntz, complete boolean, error string")
    roots = spark.createDataFrame([(x,) for x in "abcd"], "root string")
    h = health.source_health(roots, s, T[6])
    assert {r.root: r.state for r in h.collect()} == {"a": "stale", "b": "fresh", "c": "incomplete", "d": "never_scanned"}
    assert health.all_fresh(h).first().fresh is False and health.all_fresh(h.limit(0)).first().fresh is True
    assert health.source_health(roots.filter("root = 'b'"), s, T[7]).first().state == "fresh"  # exactly the age is not stale
    seen = spark.createDataFrame([("p", "s1", 0.0), ("q", "s2", 0.0), ("r", "s3", 995.0), ("n", "s4", 0.0)], "path string, signature string, mtime double")
    old = spark.createDataFrame([("p", "s1", 100.0), ("q", "other", 100.0), ("r", "s3", 100.0)], "path string, signature string, stable_since double")
    assert {r.path: (r.state, r.stable_since) for r in health.settle_states(seen, old, 1000.0).collect()} == {"p": ("staged", 100.0), "q": ("waiting", 1000.0), "r": ("waiting", 100.0), "n": ("waiting", 1000.0)}


def test_casefold_rule_on_many_characters():
    text = "".join(chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000)
    assert tx.fold(text) == "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())
    assert re.fullmatch(r"\w*", tx.fold(text))
