from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfmark.operators import hierarchy as hi

ROOTS = [("R1", "one", "root"), ("R2", "two", "archive")]


def brute(nodes):
    parent = {f: (p if p and p.strip() else None) for f, p, _ in nodes}
    out = {}
    for f in parent:
        chain, cur = [f], parent[f]
        while True:
            if cur is None:
                out[f] = (chain[-1], len(chain) - 1, "loose")
            elif cur in ("R1", "R2"):
                out[f] = (cur, len(chain), "rooted")
            elif cur not in parent:
                out[f] = (chain[-1], len(chain) - 1, "loose")
            elif cur in chain:
                out[f] = (min(chain[chain.index(cur) :]), -1, "cycle")
            else:
                chain.append(cur)
                cur = parent[cur]
                continue
            break
    return out


def run(spark, nodes, lines=False, most=hi.MAX_COMPONENT):
    df = spark.createDataFrame(nodes, "file_id string, parent_id string, name string").withColumn("top_id", hi.F.lit(1)).withColumn("ring", hi.F.lit(1))
    return hi.resolve(df, spark.createDataFrame(ROOTS, "file_id string, name string, root_role string"), lines, most)


def places(df):
    return {r.file_id: (r.top_id, r.tree_depth, r.tree_state) for r in hi.places(df).collect()}


names = [f"n{i}" for i in range(9)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from(names), st.sampled_from([*names, "R1", "R2", "gone", None, "", " "]), max_size=9), st.sampled_from([2, hi.MAX_COMPONENT]))
def test_equals_brute_force_in_one_task_and_by_pointers(spark, parents, most):
    nodes = [(f, p, f"name-{f}") for f, p in parents.items()]
    assert places(run(spark, nodes, most=most)) == brute(nodes)


def test_deep_chain_wide_folder_and_rings(spark):
    nodes = [("c0", "R1", "c0"), *[(f"c{i}", f"c{i - 1}", f"c{i}") for i in range(1, 300)], *[(f"w{i}", "c5", f"w{i}") for i in range(500)]]
    nodes += [("r1", "r2", "a"), ("r2", "r3", "b"), ("r3", "r1", "c"), ("t1", "r1", "d"), ("t2", "t1", "e"), ("self", "self", "s"), ("child", "self", "s2")]
    want = brute(nodes)
    for most in (10, hi.MAX_COMPONENT):
        got = run(spark, nodes, True, most)
        assert places(got) == want
        rows = {r.file_id: r for r in got.collect()}
        assert rows["c2"].path == ["one", "c0", "c1", "c2"] and rows["c2"].ancestors == ["R1", "c0", "c1"]
        assert rows["w3"].path[-1] == "w3" and len(rows["c299"].ancestors) == 300
        assert rows["t2"].path == ["e"] and rows["t2"].ancestors == []
        counts = {r.ancestor_id: r.n_descendants for r in hi.descendant_counts(got).collect()}
        assert counts["R1"] == 800 and counts["c5"] == 500 + 294 and "t1" not in counts
        assert {r.file_id for r in hi.cycle_members(got).collect()} == {"r1", "r2", "r3", "t1", "t2", "self", "child"}


def test_hot_parent_is_split(spark, monkeypatch):
    monkeypatch.setattr(hi, "MIN_HEAVY_ROWS", 20)
    nodes = [("f", "R1", "f"), *[(f"x{i}", "f", "x") for i in range(60)], *[(f"y{i}", None, "y") for i in range(30)]]
    assert places(run(spark, nodes)) == brute(nodes)


def test_empty_and_null_tables(spark):
    assert places(run(spark, [])) == {}
    assert places(run(spark, [("a", None, None), ("b", "a", None)])) == {"a": ("a", 0, "loose"), "b": ("a", 1, "loose")}


def test_traversal_itself():
    top, depth, state, lines = hi.traverse(["a", "b", "c", "d", "e"], [None, "a", "b", "e", "d"])
    assert top == ["a", "a", "a", "d", "d"] and depth == [0, 1, 2, -1, -1] and state == ["tree"] * 3 + ["cycle"] * 2 and lines[2] == [0, 1]
