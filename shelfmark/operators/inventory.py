"""Audit of a folder inventory: scope, classes, sidecars, conflicts.

Works on rows in effect (``orphans.rows_in_effect`` or a snapshot): file_id, parent_id, name, kind, and for the byte checks size and
integrity. Counts over hot folders are pre-aggregated; sibling checks are anti-joins on folder and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import SOURCE_EXTENSIONS, extension, is_sidecar
from shelfmark.operators.skew import heavy_keys, lookup

# Names of generated files.
GENERATED_NAMES = ["_AI_MAP.md", "_AI_NAV.md", "FILE_INDEX.json", "FILE_INDEX_SUMMARY.md", "index_build_status.json", "00_ARCHIVE_LEDGER.md", "archive_ledger.json"]
NOTES_NAME = "_NOTES.md"


def in_effect_full(entries: DataFrame) -> DataFrame:
    """The newest row of each file_id with size and sha256."""
    sha = F.try_element_at("integrity", F.lit("sha256"))
    own = entries.filter(F.col("file_id").isNotNull()).select("file_id", F.struct("captured_at", "parent_id", "name", "kind", "size", sha.alias("sha256"), "removed_at").alias("_e"))
    best = own.groupBy("file_id").agg(F.max("_e").alias("_e"))
    return best.select("file_id", "_e.parent_id", "_e.name", "_e.kind", "_e.size", "_e.sha256", "_e.captured_at", "_e.removed_at")


def violations(entries: DataFrame) -> DataFrame:
    """file_id, problem of rows that no inventory may hold."""
    p = (
        F.when(F.coalesce(F.trim("file_id"), F.lit("")) == "", "missing id")
        .when(F.coalesce(F.trim("name"), F.lit("")) == "", "missing name")
        .when(~F.coalesce(F.col("kind").isin("file", "folder"), F.lit(False)), "unknown kind")
        .when(F.col("size") < 0, "negative size")
        .when(F.col("parent_id") == F.col("file_id"), "own parent")
    )
    return entries.select("file_id", p.alias("problem")).filter(F.col("problem").isNotNull())


CARRIED = ("parent_id", "name", "kind", "size", "sha256", "captured_at", "removed_at")


def scoped(resolved: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries under some root, with archived: whether that root is an archive.

    resolved: of ``hierarchy.resolve`` with ``CARRIED`` columns carried along, so the entries are not joined again. Roots are broadcast if
    they are at most 10,000.
    """
    roles = roots.groupBy(F.col("file_id").alias("top_id")).agg(F.max(F.col("root_role") == "archive").alias("archived"))
    rooted = resolved.filter(F.col("tree_state") == "rooted").select("file_id", "top_id", *[c for c in CARRIED if c in resolved.columns])
    if roots.limit(10_001).count() <= 10_000:
        return rooted.join(F.broadcast(roles), "top_id")
    return lookup(rooted, roles, "top_id", heavy_keys(rooted.groupBy("top_id").count(), "top_id", "count"), "inner")


def file_class() -> Column:
    """Class of an inventory row; the first that applies."""
    name = F.col("name")
    return (
        F.when(F.col("kind") == "folder", "folder")
        .when(F.col("archived"), "archived_files")
        .when(name.isin(GENERATED_NAMES), "generated_files")
        .when(is_sidecar(name), "sidecars")
        .when(extension(name).isin(SOURCE_EXTENSIONS), "source_documents")
        .when(name == NOTES_NAME, "human_note_files")
        .otherwise("other_files")
    )


def classified(scope: DataFrame) -> DataFrame:
    return scope.withColumn("class", file_class())


def class_counts(scope: DataFrame) -> DataFrame:
    """class, n: each class present, and all files."""
    by = classified(scope).groupBy("class").agg(F.count("*").alias("n"))
    files = by.filter(F.col("class") != "folder").agg(F.lit("files").alias("class"), F.sum("n").alias("n")).filter(F.col("n").isNotNull())
    return by.unionByName(files)


def _sibling(col: Column) -> Column:
    return F.concat(F.coalesce("parent_id", F.lit("")), F.lit("\x02"), col)


def without_sidecar(scope: DataFrame) -> DataFrame:
    """file_id of source documents without a text file beside them; folders of that name don't count."""
    files = scope.filter(F.col("kind") == "file").select(_sibling(F.col("name")).alias("_s")).distinct()
    return classified(scope).filter(F.col("class") == "source_documents").withColumn("_s", _sibling(F.concat("name", F.lit(".md")))).join(files, "_s", "left_anti").select("file_id")


def without_original(scope: DataFrame) -> DataFrame:
    """file_id of sidecars without their original."""
    files = scope.filter(F.col("kind") == "file").select(_sibling(F.col("name")).alias("_s")).distinct()
    return classified(scope).filter(F.col("class") == "sidecars").withColumn("_s", _sibling(F.regexp_replace("name", r"\.md$", ""))).join(files, "_s", "left_anti").select("file_id")


def empty_files(scope: DataFrame) -> DataFrame:
    """file_id of files of size 0, but for archived and generated ones."""
    return classified(scope).filter((F.col("size") == 0) & ~F.col("class").isin("folder", "archived_files", "generated_files")).select("file_id")


def name_conflicts(scope: DataFrame) -> DataFrame:
    """parent_id, name, n of names that a folder holds more than once, folders and archived rows included."""
    return scope.groupBy("parent_id", "name").agg(F.count("*").alias("n")).filter("n > 1")


def identical_bytes(scope: DataFrame) -> DataFrame:
    """sha256 (lower case), size, n of source documents with the same bytes."""
    ok = F.coalesce(F.col("sha256").rlike("^[a-fA-F0-9]{64}$"), F.lit(False)) & (F.col("size") > 0)
    return classified(scope).filter((F.col("class") == "source_documents") & ok).groupBy(F.lower("sha256").alias("sha256"), "size").agg(F.count("*").alias("n")).filter("n > 1")


def snapshot_problems(entries: DataFrame) -> DataFrame:
    """file_id, problem (id, name, kind, size, duplicate) of rows that one snapshot may not hold; the first that applies.

    Identifiers are counted before the rows are joined, so a repeated one costs no large group.
    """
    counts = entries.groupBy(F.col("file_id").alias("_f")).agg(F.count("*").alias("_n"))
    problem = (
        F.when(F.coalesce("file_id", F.lit("")) == "", "id")
        .when(F.coalesce("name", F.lit("")) == "", "name")
        .when(~F.coalesce(F.col("kind").isin("file", "folder"), F.lit(False)), "kind")
        .when(F.col("size") < 0, "size")
    )
    own = entries.select("file_id", problem.alias("problem"))
    several = counts.filter(F.col("_n") > 1).select(F.col("_f").alias("file_id"), F.lit("duplicate").alias("_p"))
    # A row without another problem is a duplicate if its identifier stands several times.
    plain = own.filter("problem IS NULL").select("file_id").distinct().join(several, "file_id").select("file_id", F.col("_p").alias("problem"))
    return own.filter("problem IS NOT NULL").distinct().unionByName(plain)


def merged_integrity(entries: DataFrame) -> DataFrame:
    """file_id, integrity: the hashes of all observations merged; of one name the latest observation's holds."""
    each = entries.filter(F.col("file_id").isNotNull() & F.col("integrity").isNotNull()).select("file_id", "captured_at", F.explode("integrity").alias("name", "value")).filter("value IS NOT NULL")
    last = each.groupBy("file_id", "name").agg(F.max(F.struct("captured_at", "value")).alias("m"))
    merged = last.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "m.value"))).alias("integrity"))  # a few hashes each
    return entries.filter(F.col("file_id").isNotNull()).select("file_id").distinct().join(merged, "file_id", "left")
