"""Parent-child rows turned into full hierarchies, with rings detected (problem 7).

Method: connected components are found, each component is co-located, and an iterative depth-first traversal with node
colouring gives paths, descendants and back-edge cycles.

What makes it hold at any size:

* Only nodes that are somebody's parent (inner nodes) take part in the traversal. All other rows take their result from
  their parent's row; hot parents go by broadcast (``skew.lookup``), so a folder with a third of all rows is no problem.
* Components come from pointer doubling over inner nodes: as many rounds as the logarithm of the depth, each written to
  the shared folder.
* A component with more than ``MAX_COMPONENT`` inner nodes is not sent to one task. It is taken exactly by the pointers
  themselves (top and steps are known from the doubling; paths are doubled the same way).

Defined results: rows without file_id are left out; a parent_id of null, empty or spaces is none; a parent found nowhere
ends the chain at the row itself; a row that is its own parent is a ring of one. An inventory root ends every chain, also
if entries has a row of its name. Repeated rows count once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.skew import MIN_HEAVY_ROWS, heavy_keys, lookup
from shelfmark.session import path_of, remove, written

#: Inner nodes of a component that one task may hold (some tens of MB).
MAX_COMPONENT = 200_000
#: Components are packed into groups of about so many inner nodes for one traversal call.
GROUP_NODES = 20_000
#: Tasks of the traversal at most; beyond that a task has several groups, one after another.
MAX_TASKS = 10_000


def inner_nodes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """id, name, parent, is_root of every row or root that is the parent of some row; parent is null at a chain's end."""
    root_ids = roots.filter(F.col("file_id").isNotNull()).groupBy(F.col("file_id").alias("id")).agg(F.min("name").alias("name"))
    named = nodes.select(F.col("file_id").alias("id"), "name", F.when(F.trim("parent_id") != "", F.col("parent_id")).alias("parent"), F.lit(False).alias("is_root"))
    named = named.unionByName(root_ids.select("id", "name", F.lit(None).cast("string").alias("parent"), F.lit(True).alias("is_root")))
    named = named.groupBy("id").agg(F.max(F.struct("is_root", "name", "parent")).alias("_n")).select("id", "_n.name", "_n.parent", "_n.is_root")
    parents = nodes.filter(F.trim("parent_id") != "").select(F.col("parent_id").alias("id")).distinct()
    inner = written(named.join(parents, "id", "left_semi"), "inner")
    # A parent that is found nowhere ends the chain.
    there = inner.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    heavy = heavy_keys(inner.groupBy("parent").count(), "parent", "count")
    return lookup(inner, there, "parent", heavy).select("id", "name", F.when(F.col("_there"), F.col("parent")).alias("parent"), "is_root")


def _heavy(rows: DataFrame, key: str, n: int) -> list:
    """Heavy keys of n rows; fewer rows than make one heavy are not counted."""
    return heavy_keys(rows.groupBy(key).count(), key, "count") if n >= MIN_HEAVY_ROWS else []


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def components(inner: DataFrame) -> DataFrame:
    """id, name, parent, is_root, ptr, steps, label, ring of each inner node.

    Pointer doubling: after round k a pointer reaches 2^k steps up or the top. label is the top, or for rings the smallest
    id of the ring; ring tells that the chain never ends. A round writes only the nodes whose chain has not ended before.
    """
    state = written(inner.select("id", "name", "parent", "is_root", F.coalesce("parent", "id").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("parent").isNull().alias("done"), F.coalesce("parent", "id").alias("low")), "pointers")
    ended, open_ = [state.filter("done")], state.filter(~F.col("done"))
    left = open_.count()
    extra = None
    reach = 1
    while left and (extra is None or reach < 2 * extra):
        jump = _union([*ended, open_]).select(F.col("id").alias("ptr"), F.col("ptr").alias("_p"), F.col("steps").alias("_s"), F.col("done").alias("_d"), F.col("low").alias("_l"))
        moved = lookup(open_, jump, "ptr", _heavy(open_, "ptr", left), "inner").select("id", "name", "parent", "is_root", F.col("_p").alias("ptr"), (F.col("steps") + F.col("_s")).alias("steps"), F.col("_d").alias("done"), F.least("low", "_l").alias("low"))
        state = written(moved, "pointers")
        ended.append(state.filter("done"))
        open_ = state.filter(~F.col("done"))
        before, left, reach = left, open_.count(), reach * 2
        if left == before:  # a round that ends no chain: what is left hangs on rings
            extra = left
    cols = ["id", "name", "parent", "is_root", "ptr", "steps"]
    out = _union(ended).select(*cols, F.col("ptr").alias("label"), F.lit(False).alias("ring"))
    if not left:
        return out
    # A pointer that went as far as there are such nodes lies on the ring, and its own smallest id is that of the whole ring.
    ring = open_.select(F.col("id").alias("ptr"), F.col("low").alias("_ring"))
    bound = lookup(open_, ring, "ptr", _heavy(open_, "ptr", left), "inner")
    return out.unionByName(bound.select(*cols, F.col("_ring").alias("label"), F.lit(True).alias("ring")))


def traverse(ids: list[str], parents: list[str | None], with_lines: bool = True) -> tuple[list[str], list[int], list[str], list[list[int]]]:
    """Iterative depth-first traversal with node colouring over whole components.

    Returns for each node: top (for nodes in or on a ring the ring's smallest id), depth (-1 for those), state (tree or
    cycle), ancestors as positions from the top down to the parent (empty for cycle or without with_lines).
    """
    at = {x: i for i, x in enumerate(ids)}
    children: dict[int, list[int]] = {}
    tops = []
    up = [-1] * len(ids)
    for i, p in enumerate(parents):
        if p is None:
            tops.append(i)
        else:
            up[i] = at[p]
            children.setdefault(at[p], []).append(i)
    white, grey, black = 0, 1, 2
    colour = [white] * len(ids)
    top, depth, state = [""] * len(ids), [-1] * len(ids), ["cycle"] * len(ids)
    lines: list[list[int]] = [[] for _ in ids]
    for t in tops:
        stack = [(t, 0)]
        colour[t], top[t], depth[t], state[t] = grey, ids[t], 0, "tree"
        trail: list[int] = []
        while stack:
            node, k = stack.pop()
            own = children.get(node, ())
            if k == 0:
                if with_lines:
                    lines[node] = trail.copy()
                trail.append(node)
            if k < len(own):
                stack.append((node, k + 1))
                child = own[k]
                if colour[child] == white:
                    colour[child], top[child], depth[child], state[child] = grey, ids[t], len(trail), "tree"
                    stack.append((child, 0))
            else:
                colour[node] = black
                trail.pop()
    for start in range(len(ids)):  # what no top reaches: walk up; meeting a grey node is a back edge, which closes a ring
        if colour[start] != white:
            continue
        trail, node = [], start
        while colour[node] == white:
            colour[node] = grey
            trail.append(node)
            node = up[node]
        name = min(ids[x] for x in trail[trail.index(node) :]) if colour[node] == grey else top[node]
        for x in trail:
            top[x], colour[x] = name, black
    return top, depth, state, lines


_RESULT = "id string, top_id string, tree_depth long, ring boolean, ancestors array<string>, path array<string>"


def _traverse_group(pdf: pd.DataFrame, with_lines: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable")
    ids, names = pdf["id"].tolist(), pdf["name"].tolist()
    parents = [p if isinstance(p, str) else None for p in pdf["parent"]]
    top, depth, state, lines = traverse(ids, parents, with_lines)
    return pd.DataFrame({
        "id": ids, "top_id": top, "tree_depth": depth, "ring": [s == "cycle" for s in state],
        "ancestors": [[ids[j] for j in x] for x in lines],
        "path": [[names[j] for j in x] + [names[i]] for i, x in enumerate(lines)],
    })


def _doubled_paths(big: DataFrame) -> DataFrame:
    """Ancestors and paths of components too large for one task, by doubling arrays along the pointers."""
    spark = big.sparkSession
    a = F.when(F.col("parent").isNotNull() & ~F.col("ring"), F.array("parent")).otherwise(F.array().cast("array<string>"))
    state = written(big.select("id", "name", "label", "steps", "ring", F.when(~F.col("ring"), F.col("parent")).alias("ptr"), a.alias("line"), F.array("name").alias("path")), "paths")
    while state.filter(F.col("ptr").isNotNull()).limit(1).count():
        jump = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_p"), F.col("line").alias("_line"), F.col("path").alias("_path"))
        go = state.filter(F.col("ptr").isNotNull())
        moved = lookup(go, jump, "ptr", heavy_keys(go.groupBy("ptr").count(), "ptr", "count"), "inner")
        moved = moved.select("id", "name", "label", "steps", "ring", F.col("_p").alias("ptr"), F.concat("_line", "line").alias("line"), F.concat("_path", "path").alias("path"))
        old = path_of(state)
        state = written(state.filter(F.col("ptr").isNull()).unionByName(moved), "paths")
        for p in old:
            remove(spark, p)
    return state.select("id", F.col("label").alias("top_id"), F.when(F.col("ring"), F.lit(-1)).otherwise(F.col("steps")).cast("long").alias("tree_depth"), "ring", F.col("line").alias("ancestors"), "path")


def inner_tree(nodes: DataFrame, roots: DataFrame, with_lines: bool, max_component: int = MAX_COMPONENT) -> DataFrame:
    """id, top_id, tree_depth, ring, ancestors, path, rooted of each inner node."""
    parts = written(components(inner_nodes(nodes, roots)), "components")
    sizes = parts.groupBy("label").count()
    # Small components share a traversal call; no component is divided.
    total = parts.count()
    groups = max(1, -(-total // GROUP_NODES))
    sized = lookup(parts, sizes, "label", heavy_keys(sizes, "label", "count") if total >= MIN_HEAVY_ROWS else [])
    small = sized.filter(F.col("count") <= max_component).withColumn("_g", F.when(F.col("count") >= GROUP_NODES, F.xxhash64("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(groups))))
    done = small.select("_g", "id", "name", "parent").repartition(min(groups, MAX_TASKS), "_g").groupBy("_g").applyInPandas(lambda pdf: _traverse_group(pdf, with_lines), _RESULT)
    big = sized.filter(F.col("count") > max_component)
    if sizes.filter(F.col("count") > max_component).limit(1).count():
        steps = F.when(F.col("ring"), F.lit(-1)).otherwise(F.col("steps")).cast("long")
        none = F.array().cast("array<string>")
        plain = big.select("id", F.col("label").alias("top_id"), steps.alias("tree_depth"), "ring", none.alias("ancestors"), F.array("name").alias("path"))
        done = done.unionByName(_doubled_paths(big) if with_lines else plain)
    is_root = parts.filter("is_root").select(F.col("id").alias("top_id"), F.lit(True).alias("rooted"))
    if is_root.limit(10_001).count() <= 10_000:
        rooted = done.join(F.broadcast(is_root), "top_id", "left")
    else:
        done = written(done, "traversed")
        rooted = lookup(done, is_root, "top_id", heavy_keys(done.groupBy("top_id").count(), "top_id", "count"))
    return rooted.withColumn("rooted", F.coalesce("rooted", F.lit(False)))


def resolve(in_effect: DataFrame, roots: DataFrame, with_lines: bool = True, max_component: int = MAX_COMPONENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """file_id, top_id, tree_depth, tree_state, ancestors (ids from the top), path (names from the top) of each row in effect.

    Without with_lines ancestors and path are not formed (their size is the sum of all depths). carry: columns of in_effect that go along.
    """
    kept = [F.col(c).alias(f"_c_{c}") for c in carry]
    nodes = in_effect.select("file_id", F.when(F.trim("parent_id") != "", F.col("parent_id")).alias("parent_id"), "name", *kept)
    tree = written(inner_tree(nodes, roots, with_lines, max_component), "tree")
    up = tree.select(F.col("id").alias("parent_id"), "top_id", "tree_depth", "ring", "rooted", F.concat("ancestors", F.array("id")).alias("_line"), "path")
    heavy = heavy_keys(nodes.groupBy("parent_id").count(), "parent_id", "count", MIN_HEAVY_ROWS)
    placed = lookup(nodes, up, "parent_id", heavy)
    loose = F.col("top_id").isNull()
    state = F.when(loose, "loose").when(F.col("ring"), "cycle").when(F.col("rooted"), "rooted").otherwise("loose")
    return placed.select(
        "file_id",
        F.when(loose, F.col("file_id")).otherwise(F.col("top_id")).alias("top_id"),
        F.when(loose, F.lit(0)).when(F.col("ring"), F.lit(-1)).otherwise(F.col("tree_depth") + 1).cast("long").alias("tree_depth"),
        state.alias("tree_state"),
        F.when(loose | F.col("ring"), F.array().cast("array<string>")).otherwise(F.col("_line")).alias("ancestors"),
        F.when(loose | F.col("ring"), F.array("name")).otherwise(F.concat("path", F.array("name"))).alias("path"),
        *[F.col(f"_c_{c}").alias(c) for c in carry],
    )


def places(resolved: DataFrame) -> DataFrame:
    """file_id, top_id, tree_depth, tree_state."""
    return resolved.select("file_id", "top_id", "tree_depth", "tree_state")


def descendants(resolved: DataFrame) -> DataFrame:
    """ancestor_id, file_id, distance: one row per node and ancestor (the node's own row has distance 0)."""
    line = F.concat(F.col("ancestors"), F.array("file_id"))
    return resolved.select("file_id", F.posexplode(line).alias("_i", "ancestor_id"), F.size(line).alias("_n")).select("ancestor_id", "file_id", (F.col("_n") - 1 - F.col("_i")).cast("long").alias("distance"))


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """ancestor_id, n_descendants, max_distance; partial sums are formed before the shuffle."""
    return descendants(resolved).filter("distance > 0").groupBy("ancestor_id").agg(F.count("*").alias("n_descendants"), F.max("distance").alias("max_distance"))


def cycle_members(resolved: DataFrame) -> DataFrame:
    """ring_id, file_id of every row in a ring or hanging on one."""
    return resolved.filter("tree_state = 'cycle'").select(F.col("top_id").alias("ring_id"), "file_id")
