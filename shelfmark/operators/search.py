"""Lexical search over the current versions.

A term counts in a version's metadata and all of its pages together, as if they were written one after another and folded, so it may
cross their borders. Pages are tested one by one; only their edges, up to the longest term less one character on each side, are put
together to a version's row, so no row holds a version's whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import folded, folded_exact, search_terms
from shelfmark.operators.versions import current, newer_candidates, pages_once

MAX_QUERY, MAX_RESULTS = 500, 100
_FIELDS = ["aliases", "brand", "external_reference", "kind", "language", "model", "title"]


def metadata_text(meta: str = "metadata") -> Column:
    """The metadata as folded canonical JSON reads: names and values of the fields that are set, in order of name."""
    parts = []
    for f in _FIELDS:
        value = F.col(f"{meta}.{f}")
        shown = F.array_join(value, "") if f == "aliases" else value
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f), shown)))
    return F.concat_ws("", *parts)


def exactly_folded(df: DataFrame, col: Column, name: str) -> DataFrame:
    """Adds name: the folded text. ASCII texts are folded natively; the others go through Python."""
    df = df.withColumn(name, col)
    other = folded_exact(F.when(F.col(name).rlike(r"[^\x00-\x7F]"), F.col(name)))
    return df.withColumn("_other", other).withColumn(name, F.coalesce("_other", folded(F.col(name)))).drop("_other")


def search(versions: DataFrame, documents: DataFrame, pages: DataFrame, query: str = "", kind: str | None = None) -> DataFrame:
    """document_id, version_id, matching_pages (numbers, comma-separated) of the current versions that hold all terms.

    matching_pages are the pages that hold a term by themselves. Without terms everything matches, without pages.
    """
    if not isinstance(query, str) or len(query) > MAX_QUERY:
        raise ValueError("QUERY_LIMIT")
    terms = search_terms(query)
    found = current(versions, documents).select("document_id", "version_id", "metadata")
    if kind is not None:
        found = found.filter(F.coalesce("metadata.kind", F.lit("document")) == kind)
    if not terms:
        return found.select("document_id", "version_id", F.lit("").alias("matching_pages"))
    own = pages_once(pages.select("version_id", "number", "text")).join(found.select("version_id").distinct(), "version_id", "left_semi")
    text = exactly_folded(own, F.coalesce("text", F.lit("")), "t")
    names = [f"_h{i}" for i in range(len(terms))]
    edge = max(1, max(map(len, terms)) - 1)
    shown = F.when(F.length("t") <= 2 * edge, F.col("t")).otherwise(F.concat(F.substring("t", 1, edge), F.lit("\x00"), F.substring("t", -edge, edge)))
    flagged = text.select("version_id", "number", shown.alias("edges"), *[F.contains("t", F.lit(t)).alias(n) for t, n in zip(terms, names, strict=True)])
    any_term = F.lit(False)
    for n in names:
        any_term = any_term | F.col(n)
    grouped = flagged.groupBy("version_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "edges"))), lambda p: p["edges"]), "").alias("_edges"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(any_term, F.col("number")))), lambda n: n.cast("string")), ",").alias("matching_pages"),
        *[F.bool_or(n).alias(n) for n in names],
    )
    joined = exactly_folded(found.join(grouped, "version_id", "left"), metadata_text(), "_m")
    for t, n in zip(terms, names, strict=True):
        joined = joined.filter(F.coalesce(F.col(n), F.lit(False)) | F.contains(F.concat("_m", F.coalesce("_edges", F.lit(""))), F.lit(t)))
    return joined.select("document_id", "version_id", F.coalesce("matching_pages", F.lit("")).alias("matching_pages"))


def results(versions: DataFrame, documents: DataFrame, pages: DataFrame, query: str = "", kind: str | None = None, fresh: bool = True, allow_stale: bool = False) -> DataFrame:
    """The found versions with source hash, quality and whether the document has a newer version; sources must be fresh or stale ones allowed."""
    if not (fresh or allow_stale):
        raise ValueError("STALE_INDEX")
    found = search(versions, documents, pages, query, kind)
    facts = current(versions, documents).select("document_id", "version_id", F.lower("source_hash").alias("source_sha256"), F.col("quality").alias("extraction_status"), F.col("metadata.title").alias("title"))
    joined = found.join(facts, ["document_id", "version_id"]).join(newer_candidates(versions, documents), ["document_id", "version_id"])
    return joined.withColumnRenamed("newer", "newer_candidate_exists").withColumn("evidence_status", F.lit("unverified"))


def first_results(found: DataFrame, limit: int = 20) -> DataFrame:
    """The first results by document_id with total and truncated; limit from 1 to 100."""
    if type(limit) is not int or not 1 <= limit <= MAX_RESULTS:
        raise ValueError("QUERY_LIMIT")
    total = found.agg(F.count("*").alias("total"))  # one row
    top = found.orderBy("document_id", "version_id").limit(limit)
    return top.join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)
