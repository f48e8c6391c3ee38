"""Navigation trees with bounded fanout: briefs over pages, catalogs over entries.

Ordinals are resolved level by level by a fold: n items and fanout f give one card if n <= f, else groups of ceil(n / f). Every
level shrinks a group by f, so ``LEVELS`` levels hold f ** LEVELS items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import excerpt, label, stripped
from shelfmark.operators.ordinals import with_ordinal
from shelfmark.operators.reading import front_matter, identity_fields
from shelfmark.operators.versions import once, pages_once

BRIEF_FANOUT, CATALOG_FANOUT = 8, 32
LEVELS = 12


def _child(parent: Column, i: Column, brief: bool) -> Column:
    stem = F.regexp_replace(F.substring_index(parent, "/", -1), r"\.md$", "")
    if brief:
        return F.when(parent == "brief.md", F.concat(F.lit("sections/"), i, F.lit(".md"))).otherwise(F.concat(F.lit("sections/"), stem, F.lit("-"), i, F.lit(".md")))
    return F.concat(F.regexp_replace(parent, r"\.md$", ""), F.lit("-"), i, F.lit(".md"))


def leaf_addresses(items: DataFrame, root: Column, fanout: int, brief: bool, with_trail: bool = False) -> DataFrame:
    """Adds card (address of the leaf card), position in it (from 0) and depth. items: with o and k of :func:`with_ordinal`.

    with_trail: also trail, the branch lines above the item from the root down: card, i (line, from 1), first (place of the line's first
    item in the card's list, from 1) and child (address).
    """
    trail = "array<struct<card:string,i:bigint,first:bigint,child:string>>"
    start = F.struct(root.alias("card"), F.col("o").cast("long").alias("position"), F.col("k").cast("long").alias("k"), F.lit(0).alias("depth"), F.array().cast(trail).alias("trail"))

    def down(at: Column, _: Column) -> Column:
        width = F.ceil(at["k"] / fanout)
        i = F.floor(at["position"] / width)
        child = _child(at["card"], (i + 1).cast("string"), brief)
        step = F.struct(at["card"].alias("card"), (i + 1).cast("long").alias("i"), (i * width + 1).cast("long").alias("first"), child.alias("child"))
        deeper = F.struct(
            child.alias("card"), F.pmod(at["position"], width).cast("long").alias("position"), F.least(width, at["k"] - i * width).cast("long").alias("k"), (at["depth"] + 1).alias("depth"),
            (F.concat(at["trail"], F.array(step)) if with_trail else at["trail"]).cast(trail).alias("trail"),
        )
        return F.when(at["k"] > fanout, deeper).otherwise(at)

    walked = items.withColumn("_w", F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, down))
    return walked.select(*items.columns, *(["_w.trail"] if with_trail else []), "_w.card", "_w.position", "_w.depth")


def brief_leaves(pages: DataFrame) -> DataFrame:
    """version_id, number, card, position, depth, line: the leaf line of every page."""
    own = pages.filter(F.col("version_id").isNotNull() & F.col("number").isNotNull()).dropDuplicates(["version_id", "number"]).select("version_id", "number", "text", "preview")
    leaves = leaf_addresses(with_ordinal(own, "version_id", ["number"]), F.lit("brief.md"), BRIEF_FANOUT, True)
    target = F.when(F.col("card") == "brief.md", F.lit("full.md")).otherwise(F.lit("../full.md"))
    n = F.col("number").cast("string")
    shown = F.concat(excerpt(F.col("text")), F.when(F.coalesce("preview", F.lit("")) != "", F.lit(" (page preview available)")).otherwise(F.lit("")))
    line = F.concat(F.lit("- [Page "), n, F.lit("]("), target, F.lit("#page-"), n, F.lit("): "), shown)
    return leaves.select("version_id", "number", "card", "position", "depth", line.alias("line"))


def brief_cards(pages: DataFrame) -> DataFrame:
    """version_id, card, markdown: the leaf cards' lines in order."""
    lines = brief_leaves(pages).groupBy("version_id", "card").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))  # at most 8 lines a card
    return lines.select("version_id", "card", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))


def _joined(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, body: the lines (position, line) of each card in order; a card has at most as many as its fanout."""
    grouped = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))
    return grouped.select(*keys, F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("body"))


# Texts of the brief cards.
BRIEF_METHOD = "extractive-navigation-v2"
BRIEF_HEAD = "# Document brief\n\nVerbatim excerpts for navigation; not a complete answer or a verified fact summary.\n\n"
BRIEF_EMPTY = "No extracted text. Inspect extraction status before using this document.\n"


def full_briefs(versions: DataFrame, pages: DataFrame) -> DataFrame:
    """version_id, card, markdown: all brief cards of each version, leaves and branches, with front matter and heading.

    A branch line names the pages below it and hints at the first one. Versions without pages have one card that says so; versions
    without document, source hash or quality have none.
    """
    own = pages_once(pages).select("version_id", "number", "text", "preview")
    leaves = leaf_addresses(with_ordinal(own, "version_id", ["number"]), F.lit("brief.md"), BRIEF_FANOUT, True, True)
    n = F.col("number").cast("string")
    target = F.when(F.col("card") == "brief.md", F.lit("full.md")).otherwise(F.lit("../full.md"))
    shown = F.concat(excerpt(F.col("text")), F.when(F.coalesce("preview", F.lit("")) != "", F.lit(" (page preview available)")).otherwise(F.lit("")))
    leaf = leaves.select("version_id", "card", "position", F.concat(F.lit("- [Page "), n, F.lit("]("), target, F.lit("#page-"), n, F.lit("): "), shown).alias("line"))
    below = leaves.select("version_id", "number", "text", F.explode("trail").alias("t")).groupBy("version_id", "t.card", "t.i", "t.child").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.min_by(F.coalesce("text", F.lit("")), "number").alias("text"))
    link = F.when(F.col("card") == "brief.md", F.col("child")).otherwise(F.substring_index("child", "/", -1))
    hint = label(F.substring(stripped(F.col("text")), 1, 100))
    branch = below.select("version_id", "card", F.col("i").alias("position"), F.concat(F.lit("- [Pages "), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"), F.lit("]("), link, F.lit("): "), hint).alias("line"))
    v = once(versions).filter(F.col("document_id").isNotNull() & F.col("source_hash").isNotNull() & F.col("quality").isNotNull())
    front = front_matter([*identity_fields(), ("fulltext_sha256", F.lower("markdown_hash") if "markdown_hash" in v.columns else F.lit(None).cast("string")), ("brief_method", F.lit(BRIEF_METHOD))])
    heads = v.select("version_id", F.concat(front, F.lit(BRIEF_HEAD)).alias("head"))
    joined = heads.join(_joined(leaf.unionByName(branch), "version_id", "card"), "version_id", "left")
    return joined.select("version_id", F.coalesce("card", F.lit("brief.md")).alias("card"), F.concat("head", F.coalesce("body", F.lit(BRIEF_EMPTY))).alias("markdown"))


def catalog_cards(entries: DataFrame, group: str, order: list[str], root: Column, title: Column) -> DataFrame:
    """group, card, markdown: all catalog cards of each group, leaves and branches.

    entries: group, order columns, label, destination (address from the bundle's top). Branch lines number the entries of their card's list
    and name the first one.
    """
    own = entries.select(group, *order, "destination", label(F.col("label")).alias("label"))
    leaves = leaf_addresses(with_ordinal(own, group, order), root, CATALOG_FANOUT, False, True)
    up = F.when(F.contains("card", F.lit("/")), F.lit("../")).otherwise(F.lit(""))
    leaf = leaves.select(group, "card", "position", F.concat(F.lit("- ["), "label", F.lit("]("), up, "destination", F.lit(")")).alias("line"))
    below = leaves.select(group, "o", "label", F.explode("trail").alias("t")).groupBy(group, "t.card", "t.i", "t.first", "t.child").agg(F.count("*").alias("n"), F.min_by("label", "o").alias("label"))
    places = F.concat(F.col("first").cast("string"), F.lit("-"), (F.col("first") + F.col("n") - 1).cast("string"))
    branch = below.select(group, "card", F.col("i").alias("position"), F.concat(F.lit("- [Entries "), places, F.lit(": "), "label", F.lit("]("), F.substring_index("child", "/", -1), F.lit(")")).alias("line"))
    return _joined(leaf.unionByName(branch), group, "card").select(group, "card", F.concat(F.lit("# "), label(title), F.lit("\n\n"), "body").alias("markdown"))


def kind_address(kind: Column) -> Column:
    return F.concat(F.lit("groups/"), F.substring(F.sha2(kind, 256), 1, 16), F.lit(".md"))


def kind_catalogs(current: DataFrame) -> DataFrame:
    """kind, card, markdown: the catalogs of the current versions (version_id, document_id, metadata, filename) of each kind."""
    kind = F.coalesce("metadata.kind", F.lit("document"))
    shown = F.concat(F.coalesce("metadata.title", "filename", F.lit("")), F.lit(" / "), "version_id")
    entries = current.select(kind.alias("kind"), "document_id", "version_id", shown.alias("label"), F.concat(F.lit("documents/"), "version_id", F.lit("/brief.md")).alias("destination"))
    return catalog_cards(entries, "kind", ["document_id", "version_id"], kind_address(F.col("kind")), F.col("kind"))


# Fixed value: the last line of the library's map.
MAP_END = "\nRead [governance](00_CONSTITUTION.md) before following document links.\n"


def library_map(current: DataFrame) -> DataFrame:
    """card, markdown: the catalog of the kinds, from _AI_MAP.md on."""
    kinds = current.groupBy(F.coalesce("metadata.kind", F.lit("document")).alias("kind")).agg(F.count("*").alias("n"))
    entries = kinds.select(F.lit("kinds").alias("g"), "kind", F.concat("kind", F.lit(": "), F.col("n").cast("string"), F.lit(" documents")).alias("label"), kind_address(F.col("kind")).alias("destination"))
    cards = catalog_cards(entries, "g", ["kind"], F.lit("_AI_MAP.md"), F.lit("Library map"))
    return cards.select("card", F.when(F.col("card") == "_AI_MAP.md", F.concat("markdown", F.lit(MAP_END))).otherwise(F.col("markdown")).alias("markdown"))


def catalog_leaves(entries: DataFrame, group: str, order: list[str], text: Column, root: Column) -> DataFrame:
    """group, order columns, card, position, depth, label: where every entry stands in its group's catalog."""
    own = entries.select(group, *order, label(text).alias("label"))
    return leaf_addresses(with_ordinal(own, group, order), root, CATALOG_FANOUT, False).drop("o", "k")


def tree_sizes(leaves: DataFrame, group: str) -> DataFrame:
    """group, n_leaf_cards, depth."""
    return leaves.groupBy(group).agg(F.count_distinct("card").alias("n_leaf_cards"), F.max("depth").alias("depth"))
