"""References to records that are missing, removed or arrive later (problem 2).

Method: skew-aware split. References are pre-aggregated per key and period; the heaviest keys (a bounded number) are
checked against a broadcast of their targets, the remaining keys by a shuffle join; both results are united.

Input contract of :func:`orphan_rows`:

* references: group (which reference field), row_key, key, at (time of the reference), period.
* targets: group, key, until (time from which the target is gone; null = never).

A reference is an orphan if no target row with its group and key exists, or every such target has ``until`` not later
than ``at``. A null key is no reference. A null ``at`` is an orphan only if the target has no row. Empty inputs give
no rows; repeated references give one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.skew import MIN_HEAVY_ROWS, among, heavy_keys

_SEP = "\x01"
_NEVER = "9999-12-31 00:00:00"


def _keyed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("key").isNotNull()).withColumn("_k", F.concat(F.col("group"), F.lit(_SEP), F.col("key")))


def orphan_rows(references: DataFrame, targets: DataFrame, min_heavy_rows: int = MIN_HEAVY_ROWS) -> DataFrame:
    """group, row_key, key, period of each orphan reference, distinct."""
    refs = _keyed(references.select("group", "row_key", "key", "at", "period"))
    never = F.lit(_NEVER).cast("timestamp_ntz")
    ends = _keyed(targets).groupBy("_k").agg(F.max(F.coalesce(F.col("until"), never)).alias("until"))

    # Pre-aggregated: one row per key and period (references without time share one), however many rows a key has.
    refs = refs.withColumn("_period", F.coalesce("period", F.lit("")))
    per_key = refs.groupBy("_k", "_period").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    heavy = heavy_keys(per_key.groupBy("_k").agg(F.sum("n").alias("n")), "_k", "n", min_heavy_rows)
    orphan_key = F.col("until").isNull() | (F.col("until") <= F.col("last_at"))

    def orphans(few: bool) -> DataFrame:
        mine = (lambda df: df.filter(among(F.col("_k"), heavy))) if few else (lambda df: df.filter(~among(F.col("_k"), heavy))) if heavy else (lambda df: df)
        if few:  # at most as many target and verdict rows as there are heavy keys
            keys = mine(per_key).groupBy("_k").agg(F.max("last_at").alias("last_at")).join(F.broadcast(mine(ends)), "_k", "left").filter(orphan_key).select("_k", "until")
            rows = mine(refs).join(F.broadcast(keys), "_k")
        else:
            keys = mine(per_key).join(mine(ends), "_k", "left").filter(orphan_key).select("_k", "_period", "until")
            rows = mine(refs).join(keys, ["_k", "_period"])
        return rows.filter(F.col("until").isNull() | (F.col("until") <= F.col("at")))

    found = orphans(False)
    if heavy:
        found = found.unionByName(orphans(True))
    return found.select("group", "row_key", "key", "period").distinct()


def orphan_counts(references: DataFrame, targets: DataFrame) -> DataFrame:
    """group, period, n_references, n_orphans, n_missing_keys: the report per table and period."""
    totals = references.filter(F.col("key").isNotNull()).groupBy("group", "period").agg(F.count_distinct("row_key", "key").alias("n_references"))
    orphans = orphan_rows(references, targets).groupBy("group", "period").agg(F.count("*").alias("n_orphans"), F.count_distinct("key").alias("n_missing_keys"))
    return totals.join(orphans, ["group", "period"], "left").na.fill(0, ["n_orphans", "n_missing_keys"])


def rows_in_effect(entries: DataFrame) -> DataFrame:
    """The row with the greatest captured_at of each file_id.

    Equal times are broken by the other columns' order, so that the result is the same however rows arrive. Rows without
    file_id are left out; a row without captured_at is older than any other.
    """
    cols = ["captured_at", "parent_id", "name", "kind", "removed_at"]
    return entries.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max(F.struct(*cols)).alias("_e")).select("file_id", *[F.col(f"_e.{c}").alias(c) for c in cols])


#: Extensions of originals that can have a sidecar.
SIDECAR_ORIGINALS = ["pdf", "docx", "xlsx", "txt", "md", "pptx"]


def library_references(in_effect: DataFrame, roots: DataFrame, versions: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The three reference fields of the library as (references, targets) for :func:`orphan_rows`."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    base = F.regexp_extract("name", rf"(?s)^(.+\.(?i:{'|'.join(SIDECAR_ORIGINALS)}))\.md\z", 1)
    place = lambda name: F.concat(F.coalesce(F.col("parent_id"), F.lit("")), F.lit("\x02"), name)
    by_parent = in_effect.filter(F.trim("parent_id") != "").select(F.lit("entries.parent_id").alias("group"), F.col("file_id").alias("row_key"), F.col("parent_id").alias("key"), F.col("captured_at").alias("at"))
    by_name = in_effect.filter((F.col("kind") == "file") & (base != "")).select(F.lit("entries.name").alias("group"), F.col("file_id").alias("row_key"), place(base).alias("key"), F.col("captured_at").alias("at"))
    by_document = versions.filter(F.trim("document_id") != "").select(F.lit("versions.document_id").alias("group"), F.col("version_id").alias("row_key"), F.col("document_id").alias("key"), F.col("created_at").alias("at"))
    refs = by_parent.unionByName(by_name).unionByName(by_document).withColumn("period", month(F.col("at")))

    gone = F.col("removed_at").alias("until")
    targets = (
        in_effect.select(F.lit("entries.parent_id").alias("group"), F.col("file_id").alias("key"), gone)
        .unionByName(roots.select(F.lit("entries.parent_id").alias("group"), F.col("file_id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("until")))
        .unionByName(in_effect.filter(F.col("kind") == "file").select(F.lit("entries.name").alias("group"), place(F.col("name")).alias("key"), gone))
        .unionByName(documents.select(F.lit("versions.document_id").alias("group"), F.col("document_id").alias("key"), gone))
    )
    return refs, targets


def report_columns(found: DataFrame) -> DataFrame:
    """table_name, field_name, row_key, missing_key, period_month of orphan rows."""
    return found.select(
        F.substring_index("group", ".", 1).alias("table_name"),
        F.substring_index("group", ".", -1).alias("field_name"),
        "row_key",
        F.when(F.col("group") == "entries.name", F.substring_index("key", "\x02", -1)).otherwise(F.col("key")).alias("missing_key"),
        F.col("period").alias("period_month"),
    ).distinct()
