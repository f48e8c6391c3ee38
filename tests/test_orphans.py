from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfmark.operators import orphans

T = [datetime(2024, m, 1) for m in range(1, 7)]
REF = "`group` string, row_key string, key string, at timestamp_ntz, period string"
TARGET = "`group` string, key string, until timestamp_ntz"


def brute(refs, targets):
    out = set()
    for g, row, key, at, period in refs:
        if key is None:
            continue
        ends = [u for h, k, u in targets if (h, k) == (g, key)]
        if not ends or at is not None and all(u is not None and u <= at for u in ends):
            out.add((g, row, key, period))
    return out


def run(spark, refs, targets, heavy):
    df = orphans.orphan_rows(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET), heavy)
    return {tuple(r) for r in df.collect()}


keys = st.sampled_from(["a", "b", "c", None])
times = st.sampled_from([*T, None])
ref = st.tuples(st.sampled_from(["g", "h"]), st.sampled_from(["r1", "r2", "r3"]), keys, times, st.sampled_from(["p1", "p2", None]))
target = st.tuples(st.sampled_from(["g", "h"]), keys, times)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ref, max_size=14), st.lists(target, max_size=6), st.sampled_from([1, 3, 10_000]))
def test_equals_brute_force_however_keys_are_split(spark, refs, targets, heavy):
    assert run(spark, refs, targets, heavy) == brute(refs, targets)


def test_hot_key_is_split_and_whole(spark):
    refs = [("g", f"r{i}", "hot" if i % 3 else f"k{i}", T[2], "p") for i in range(300)]
    targets = [("g", "hot", T[1]), *[("g", f"k{i}", None) for i in range(0, 300, 2)]]
    assert run(spark, refs, targets, 50) == brute(refs, targets) and len(brute(refs, targets)) > 200


def test_library_fields(spark):
    entries = spark.createDataFrame(
        [
            ("f1", "root", "folder", "folder", T[0], None), ("f1", "gone", "folder", "folder", T[1], None), ("f1", "gone", "folder", "folder", T[1], None),
            ("a", "f1", "x.PDF", "file", T[0], None), ("s", "f1", "x.PDF.md", "file", T[2], None), ("t", "f1", "y.docx.md", "file", T[2], None), ("u", "", "z.txt.md", "file", T[2], None), ("w", None, "z.txt", "file", T[3], None),
            ("d", " ", "note.md", "file", T[2], None), ("e", "f2", "q.md", "folder", T[2], None), ("f2", "root", "old", "folder", T[0], T[1]), ("late", "f2", "n", "file", T[0], None), (None, "x", "y", "file", T[0], None),
        ],
        "file_id string, parent_id string, name string, kind string, captured_at timestamp_ntz, removed_at timestamp_ntz",
    ).withColumn("integrity", orphans.F.lit(None).cast("map<string,string>"))
    roots = spark.createDataFrame([("root", "R", "root")], "file_id string, name string, root_role string")
    versions = spark.createDataFrame([("v1", "d1", T[0]), ("v2", "none", T[1]), ("v2", "none", T[1]), ("v3", None, T[1]), ("v4", "d2", T[3])], "version_id string, document_id string, created_at timestamp_ntz")
    documents = spark.createDataFrame([("d1", None), ("d2", T[3])], "document_id string, removed_at timestamp_ntz")
    found = orphans.report_columns(orphans.orphan_rows(*orphans.library_references(orphans.rows_in_effect(entries), roots, versions, documents)))
    assert {tuple(r) for r in found.collect()} == {
        ("entries", "parent_id", "f1", "gone", "2024-02"), ("entries", "parent_id", "e", "f2", "2024-03"), ("entries", "name", "t", "y.docx", "2024-03"),
        ("versions", "document_id", "v2", "none", "2024-02"), ("versions", "document_id", "v4", "d2", "2024-04"),
    }


@pytest.mark.parametrize("rows", [[], [("g", "r", None, None, None)]])
def test_nothing_to_refer_to(spark, rows):
    assert run(spark, rows, [], 1) == set()
    refs, targets = spark.createDataFrame(rows, REF), spark.createDataFrame([], TARGET)
    assert orphans.orphan_counts(refs, targets).count() == 0
