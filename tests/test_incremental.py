from datetime import datetime

import pytest

from shelfmark.operators import incremental as inc

T = [datetime(2024, 1, d) for d in range(1, 20)]
SCHEMA = "source_path string, source_hash string, landed_at timestamp_ntz, cutoff timestamp_ntz"


def source(spark, rows):
    return inc.with_partition(spark.createDataFrame(rows, SCHEMA), "source_path", 8)


def brute(rows):
    first, cut = {}, {}
    for p, h, at, c in rows:
        k = p, h
        first[k] = min([x for x in (first.get(k), at) if x], default=None)
        cut[k] = c
    return {k for k in first if cut[k] is None or first[k] and first[k] > cut[k]}


BASE = [(f"/a/{i}", f"h{i}", T[i], T[5]) for i in range(12)] + [("/a/3", "h3", T[1], T[5]), ("/a/9", "h9", T[9], T[5]), ("/n/1", "x", None, None), (None, "y", T[1], None)]


def result(df):
    rows = [tuple(r) for r in df.drop("run").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_only_changed_partitions_are_recomputed(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    got, changed = inc.run_incremental(source(spark, BASE), inc.new_content, folder, 8)
    assert result(got) == brute(BASE) and changed
    got, changed = inc.run_incremental(source(spark, BASE[::-1]), inc.new_content, folder, 8)
    assert result(got) == brute(BASE) and changed == []
    more = [*BASE, ("/a/1", "new", T[15], T[5])]
    got, changed = inc.run_incremental(source(spark, more), inc.new_content, folder, 8)
    assert result(got) == brute(more) and len(changed) == 1
    # A repeated row changes the fingerprint but not the result; a partition that empties loses its rows.
    got, changed = inc.run_incremental(source(spark, [*more, more[-1]]), inc.new_content, folder, 8)
    assert result(got) == brute(more) and len(changed) == 1
    fewer = [r for r in [*more, more[-1]] if r[0] != "/a/11"]
    got, changed = inc.run_incremental(source(spark, fewer), inc.new_content, folder, 8)
    assert result(got) == brute(fewer) and len(changed) == 1
    got, _ = inc.run_incremental(source(spark, []), inc.new_content, folder, 8)
    assert result(got) == set()


def test_a_run_that_dies_is_made_good(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    inc.run_incremental(source(spark, BASE), inc.new_content, folder, 8)
    more = [*BASE, ("/a/2", "late", T[16], T[5])]

    def dies(rows):
        out = inc.new_content(rows)
        return out.withColumn("source_hash", inc.F.when(inc.F.col("source_hash") == "late", inc.F.raise_error(inc.F.lit("lost"))).otherwise(inc.F.col("source_hash")))

    with pytest.raises(Exception, match="lost"):
        inc.run_incremental(source(spark, more), dies, folder, 8)
    assert inc.last_run(spark, folder) == 1
    got, changed = inc.run_incremental(source(spark, more), inc.new_content, folder, 8)
    assert result(got) == brute(more) and len(changed) == 1 and inc.last_run(spark, folder) == 2


def test_fingerprint_ignores_order_and_counts_repeats(spark):
    f = lambda rows: sorted(map(tuple, inc.fingerprints(source(spark, rows)).collect()))
    assert f(BASE) == f(BASE[::-1]) != f([*BASE, BASE[0]])
    assert f([("/p", None, None, None)]) != f([("/p", "", None, None)])


def test_rows_keep_the_run_they_came_out_in(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/s"
    schema = "root string, " + SCHEMA
    base = [(r[0][:2] if r[0] else None, *r) for r in BASE]
    make = lambda rows: spark.createDataFrame(rows, schema)
    first, _ = inc.bring_up_to_date(make(base), folder)
    assert {r.run for r in first.collect()} == {1} and result(first) == brute(BASE)
    more = [*base, ("/a", "/a/1", "new", T[15], T[5])]

    def dies():
        raise KeyError("lost")

    with pytest.raises(KeyError):
        inc.bring_up_to_date(make(more), folder, dies)
    again, changed = inc.bring_up_to_date(make(more), folder)
    assert len(changed) == 1 and {tuple(r) for r in again.filter("run = 2").collect()} == {("/a/1", "new", 2)}
    assert result(again) == brute([r[1:] for r in more])
    # Partitions laid out anew: everything is recomputed, nothing counts as new.
    monkeypatch.setattr(inc, "PART_ROWS", 2)
    anew, changed = inc.bring_up_to_date(make(more), folder)
    assert len(changed) > 2 and result(anew) == brute([r[1:] for r in more]) and {r.run for r in anew.collect()} == {1, 2}


def test_a_run_that_another_committed_fails(spark, tmp_path):
    folder = f"file://{tmp_path}/s"

    def other():
        inc.run_incremental(source(spark, BASE), inc.new_content, folder, 8)

    with pytest.raises(Exception, match="(?i)exist"):
        inc.run_incremental(source(spark, BASE), inc.new_content, folder, 8, other)
    assert inc.last_run(spark, folder) == 1


def test_only_changed_partitions_are_read(spark, tmp_path):
    folder, seen = f"file://{tmp_path}/s", []
    inc.run_incremental(source(spark, BASE), inc.new_content, folder, 8)

    def compute(rows):
        seen.append(rows._jdf.queryExecution().executedPlan().toString())
        return inc.new_content(rows)

    inc.run_incremental(source(spark, [*BASE, BASE[1]]), compute, folder, 8)
    assert "PartitionFilters: [isnotnull(part" in seen[0] or "PartitionFilters: [(part" in seen[0] or "part#" in seen[0].split("PartitionFilters")[1][:80]


def test_roots_and_cutoffs(spark):
    scans = spark.createDataFrame(
        [(1, "/l/a", T[3], T[4], True, None), (2, "/l/a", T[9], T[9], False, None), (3, "/l/a", T[8], T[8], True, "io"), (4, "/l/a2", T[5], None, True, None), (5, "/l/a/deep", T[7], T[7], True, None)],
        "scan_id long, root string, attempted_at timestamp_ntz, success_at timestamp_ntz, complete boolean, error string",
    )
    docs = spark.createDataFrame([("d1", "/l/a/x.pdf"), ("d2", "/l/a2/x.pdf"), ("d3", "/l/a/deep/y"), ("d4", "/else/z"), ("d5", None)], "document_id string, source_path string")
    versions = spark.createDataFrame([("d1", "AB", T[2]), ("d1", "ab", T[6]), ("d1", "cd", T[6]), ("d2", "ef", T[0]), ("d3", "gh", T[7]), ("d3", "ij", T[8]), ("d4", "kl", T[0]), ("no", "mn", T[9]), ("d1", None, T[9])], "document_id string, source_hash string, landed_at timestamp_ntz")
    got = inc.new_content(inc.with_partition(inc.landed_sources(versions, docs, scans), "source_path", 4, "root")).select("source_path", "source_hash")
    assert result(got) == {("/l/a/x.pdf", "cd"), ("/l/a2/x.pdf", "ef"), ("/l/a/deep/y", "ij"), ("/else/z", "kl")}
