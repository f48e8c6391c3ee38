"""Health of source roots, and what a scan sees: missing, waiting, staged."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds for which a successful scan holds.
MAX_AGE = 172_800
#: Seconds for which a file must be unchanged.
SETTLE = 30


def last_scans(scans: DataFrame) -> DataFrame:
    """The row with the greatest attempted_at of each root; equal times by scan_id."""
    s = scans.filter(F.col("root").isNotNull()).groupBy("root").agg(F.max(F.struct("attempted_at", "scan_id", "success_at", "complete", "error")).alias("_s"))
    return s.select("root", "_s.attempted_at", "_s.success_at", "_s.complete", "_s.error")


def source_health(roots: DataFrame, scans: DataFrame, now: datetime, max_age: int = MAX_AGE) -> DataFrame:
    """root, state of every root: never_scanned, incomplete, stale or fresh; the first that applies."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("success_at").cast("timestamp"))
    joined = roots.select("root").distinct().join(last_scans(scans), "root", "left")
    state = (
        F.when(F.col("attempted_at").isNull(), "never_scanned")
        .when(~F.coalesce("complete", F.lit(False)) | F.col("success_at").isNull(), "incomplete")
        .when(age > max_age * 1_000_000, "stale")
        .otherwise("fresh")
    )
    return joined.select("root", state.alias("state"))


def all_fresh(health: DataFrame) -> DataFrame:
    """One row: fresh, true if every root is."""
    return health.agg(F.coalesce(F.bool_and(F.col("state") == "fresh"), F.lit(True)).alias("fresh"))


def missing_sources(known: DataFrame, seen: DataFrame, complete_roots: DataFrame) -> DataFrame:
    """path of known files (root, path) that a complete scan of their root did not see. Incomplete roots report nothing."""
    return known.join(complete_roots.select("root").distinct(), "root", "left_semi").join(seen.select("path").distinct(), "path", "left_anti").select("path")


def settle_states(observed: DataFrame, previous: DataFrame, now: float, settle: float = SETTLE) -> DataFrame:
    """path, signature, stable_since, state (waiting or staged) of each observed file.

    observed: path, signature, mtime. previous: path, signature, stable_since. A new or changed file starts its time anew.
    """
    old = previous.select("path", F.col("signature").alias("_old"), F.col("stable_since").alias("_since"))
    joined = observed.select("path", "signature", "mtime").join(old, "path", "left")
    same = F.coalesce(F.col("_old") == F.col("signature"), F.lit(False))
    since = F.when(same, F.col("_since")).otherwise(F.lit(float(now)))
    waiting = ~same | (F.lit(float(now)) - since < settle) | (F.lit(float(now)) - F.col("mtime") < settle)
    return joined.select("path", "signature", since.alias("stable_since"), F.when(waiting, "waiting").otherwise("staged").alias("state"))


def scan_report(with_root, scans: DataFrame, documents: DataFrame) -> DataFrame:
    """root, attempted_at, success_at, complete, n_known, n_missing of each root after its last scan.

    success_at is that of the last scan that succeeded, whatever came after; an incomplete last scan reports nothing missing. with_root:
    gives paths their innermost root. Known are the documents under a root; missing are those of them that are removed.
    """
    last = last_scans(scans)
    whole = F.coalesce("complete", F.lit(False)) & F.col("error").isNull()
    kept = scans.filter(F.col("root").isNotNull() & whole).groupBy("root").agg(F.max("success_at").alias("success_at"))
    placed = with_root(documents.select("document_id", "source_path", "removed_at"), last.select("root", F.col("attempted_at").alias("cutoff")))
    known = placed.filter("root IS NOT NULL").groupBy("root").agg(F.count("*").alias("n_known"), F.count("removed_at").alias("n_gone"))
    joined = last.drop("success_at").join(kept, "root", "left").join(known, "root", "left").withColumn("_whole", whole)
    return joined.select("root", "attempted_at", "success_at", F.col("_whole").alias("complete"), F.coalesce("n_known", F.lit(0)).alias("n_known"), F.when(F.col("_whole"), F.coalesce("n_gone", F.lit(0))).otherwise(0).cast("long").alias("n_missing"))
