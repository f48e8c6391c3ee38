"""Versions and documents: current, latest, history, duplicates, counts.

Version rows can be delivered several times; every operator works on :func:`once`. Null version_ids are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.text import canonical, digest

COLUMNS = ["document_id", "fingerprint", "source_hash", "markdown_hash", "extraction_hash", "brief_hash", "metadata", "filename", "quality", "created_at"]


def once(versions: DataFrame) -> DataFrame:
    """One row per version_id of the known columns that are there; landed_at (where there) is the earliest."""
    cols = [c for c in COLUMNS if c in versions.columns]
    landed = [F.min("landed_at").alias("landed_at")] if "landed_at" in versions.columns else []
    grouped = versions.filter(F.col("version_id").isNotNull()).groupBy("version_id").agg(F.max(F.struct(*cols)).alias("_v"), *landed)
    return grouped.select("version_id", *[F.col(f"_v.{c}").alias(c) for c in cols], *(["landed_at"] if landed else []))


def pages_once(pages: DataFrame) -> DataFrame:
    """One row per version_id and number; if deliveries differ, the one that sorts last."""
    rest = [c for c in ("text", "preview", "width", "height", "coordinate_system") if c in pages.columns]
    grouped = pages.filter(F.col("version_id").isNotNull() & F.col("number").isNotNull()).groupBy("version_id", "number").agg(F.max(F.struct(*rest)).alias("_p"))
    return grouped.select("version_id", "number", *[F.col(f"_p.{c}").alias(c) for c in rest])


def current(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """The versions that are some document's current one, with document_id and source_path of that document."""
    docs = documents.filter(F.col("current_version").isNotNull()).select(F.col("current_version").alias("version_id"), F.col("document_id").alias("_document"), "source_path")
    joined = once(versions).join(docs, "version_id")
    return joined.drop("document_id").withColumnRenamed("_document", "document_id")


def latest(versions: DataFrame, key: str = "document_id") -> DataFrame:
    """The version with the greatest created_at of each key; equal times go to the greatest version_id."""
    v = once(versions).filter(F.col(key).isNotNull())
    return v.groupBy(key).agg(F.max(F.struct("created_at", "version_id", "quality")).alias("_l")).select(key, "_l.version_id", "_l.created_at", "_l.quality")


def latest_by_path(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """source_path with its latest version: what a scan compares with."""
    return latest(versions).join(documents.select("document_id", "source_path"), "document_id").select("source_path", "version_id", "created_at", "quality")


def history(versions: DataFrame, document_id: str) -> DataFrame:
    """All versions of one document, oldest first; an unknown document has none."""
    return once(versions).filter(F.col("document_id") == document_id).select("version_id", "created_at", "quality").orderBy("created_at", "version_id")


def history_positions(versions: DataFrame) -> DataFrame:
    """document_id, version_id, position (from 1) in the document's history."""
    by = W.partitionBy("document_id").orderBy("created_at", "version_id")
    return once(versions).filter(F.col("document_id").isNotNull()).select("document_id", "version_id", "created_at").withColumn("position", F.row_number().over(by)).drop("created_at")


def newer_candidates(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, version_id, newer: whether the document has a version made after its current one.

    The latest time per document is pre-aggregated and joined by key instead of one look-up a row.
    """
    last = once(versions).groupBy(F.col("document_id").alias("_d")).agg(F.max("created_at").alias("_last"))
    joined = current(versions, documents).join(last, F.col("document_id") == F.col("_d"), "left")
    return joined.select("document_id", "version_id", F.coalesce(F.col("_last") > F.col("created_at"), F.lit(False)).alias("newer"))


def status_counts(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: n_documents, n_versions, n_current."""
    n = documents.agg(F.count("*").alias("n_documents"), F.count("current_version").alias("n_current"))
    m = versions.agg(F.count_distinct("version_id").alias("n_versions"))
    return n.join(F.broadcast(m)).select("n_documents", "n_versions", "n_current")  # one row each


def quality_histogram(versions: DataFrame) -> DataFrame:
    """quality, n."""
    return once(versions).groupBy("quality").agg(F.count("*").alias("n"))


def kind_map(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """kind, n of the current versions; a missing kind counts as document."""
    return current(versions, documents).groupBy(F.coalesce("metadata.kind", F.lit("document")).alias("kind")).agg(F.count("*").alias("n"))


def publishable(versions: DataFrame) -> DataFrame:
    """version_id of the versions whose extraction is complete."""
    return once(versions).filter(F.col("quality") == "extracted").select("version_id")


def duplicate_fingerprints(versions: DataFrame) -> DataFrame:
    """document_id, fingerprint (lower case), n, first_version of fingerprints that a document has more than once."""
    v = once(versions).filter(F.col("document_id").isNotNull() & F.col("fingerprint").isNotNull())
    g = v.groupBy("document_id", F.lower("fingerprint").alias("fingerprint")).agg(F.count("*").alias("n"), F.min("version_id").alias("first_version"))
    return g.filter("n > 1")


def new_fingerprints(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """document_id, fingerprint, version_id (the smallest) of each incoming document and fingerprint that is not known yet (idempotent ingest)."""
    one = incoming.groupBy("document_id", "fingerprint").agg(F.min("version_id").alias("version_id"))
    return one.join(known.select("document_id", "fingerprint").distinct(), ["document_id", "fingerprint"], "left_anti")


def identical_sources(versions: DataFrame) -> DataFrame:
    """source_hash, n_versions, n_documents of source bytes kept for several documents."""
    v = once(versions).filter(F.col("source_hash").isNotNull())
    g = v.groupBy(F.lower("source_hash").alias("source_hash")).agg(F.count("*").alias("n_versions"), F.count_distinct("document_id").alias("n_documents"))
    return g.filter("n_documents > 1")


def unchanged(observed: DataFrame, latest_versions: DataFrame) -> DataFrame:
    """path of observed files (path, sha256) whose latest version (path, sha256, quality) was extracted from the same bytes."""
    old = latest_versions.filter(F.col("quality") == "extracted").select("path", F.lower("sha256").alias("sha256"))
    return observed.select("path", F.lower("sha256").alias("sha256")).join(old, ["path", "sha256"], "left_semi").select("path")


def audit_tail(events: DataFrame, limit: int = 100) -> DataFrame:
    """The last events by sequence, newest first; limit from 1 to 1000."""
    if type(limit) is not int or not 1 <= limit <= 1000:
        raise ValueError("QUERY_LIMIT")
    return events.orderBy(F.desc("event_id")).limit(limit)


def replayed(events: DataFrame, opens: str = "purchase", closes: str = "error") -> DataFrame:
    """key, event_id of the event in force for each user_id after replaying the log: the last opening event, unless a closing one came later."""
    some = events.filter(F.col("event_type").isin(opens, closes) & F.col("user_id").isNotNull())
    last = some.groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("_e"))
    return last.filter(F.col("_e.event_type") == opens).select("user_id", F.col("_e.event_id").alias("event_id"))


HASHES = ["source_hash", "markdown_hash", "extraction_hash", "brief_hash"]


def hash_problems(versions: DataFrame) -> DataFrame:
    """version_id, field, problem (missing, address) of content addresses that are no SHA-256."""
    every = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("h")) for c in HASHES])
    rows = versions.filter(F.col("version_id").isNotNull()).select("version_id", F.inline(every))
    problem = F.when(F.col("h").isNull(), "missing").when(~F.col("h").rlike(r"^[0-9a-fA-F]{64}\z"), "address")
    return rows.select("version_id", "field", problem.alias("problem")).filter("problem IS NOT NULL").distinct()


def verified(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """version_id, field, problem (missing, hash) of the four contents of each version against the store.

    blobs: address (the hash that names it), content. A content whose own hash is not its address counts as damaged.
    """
    every = F.array(*[F.struct(F.lit(c).alias("field"), F.lower(c).alias("address")) for c in HASHES])
    have = blobs.select(F.lower("address").alias("address"), (F.sha2("content", 256) == F.lower("address")).alias("_ok")).groupBy("address").agg(F.bool_and("_ok").alias("_ok"))
    wanted = once(versions).select("version_id", F.inline(every)).join(have, "address", "left")
    problem = F.when(F.col("_ok").isNull(), "missing").when(~F.col("_ok"), "hash")
    return wanted.select("version_id", "field", problem.alias("problem")).filter("problem IS NOT NULL")


# What a fingerprint names besides the contents.
RENDERER, _BRIEF_METHOD = "fulltext-v2", "extractive-navigation-v2"


def composed_fingerprints(versions: DataFrame) -> DataFrame:
    """version_id, sha256 of the canonical JSON of source, metadata, extraction, renderer and brief method."""
    meta = F.struct(*[F.col(f"metadata.{f}").alias(f) for f in ("aliases", "brand", "external_reference", "kind", "language", "model", "title")])
    whole = canonical(("source", F.lower("source_hash")), ("metadata", meta), ("extraction", F.lower("extraction_hash")), ("renderer", F.lit(RENDERER)), ("brief_method", F.lit(_BRIEF_METHOD)))
    return once(versions).select("version_id", digest(whole).alias("sha256"))


def identity_conflicts(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """document_id, path, problem of incoming rows that contradict the library: path (it belongs to another document) or document (it has another path)."""
    own = incoming.select("document_id", "path").filter(F.col("path").isNotNull()).distinct()
    by_path = known.select("path", F.col("document_id").alias("_owner"))
    by_document = known.select("document_id", F.col("path").alias("_at"))
    joined = own.join(by_path, "path", "left").join(by_document, "document_id", "left")
    problem = F.when(F.col("_owner") != F.col("document_id"), "path").when(F.col("_owner").isNull() & (F.col("_at") != F.col("path")), "document")
    return joined.select("document_id", "path", problem.alias("problem")).filter("problem IS NOT NULL")
