"""Plain text files taken into the library: one new version per file whose content and metadata are not there yet.

Files beyond the size cap, outside of the roots or of another kind are refused with a code and give no version. A path keeps its document;
a new path gets one, named by the hash of the path, so that a repeated run names it alike. The metadata of the document's latest version
is inherited; without one, title is the file's name and kind is document. A fingerprint that the document has already gives no version.
Every step is a join or an expression; nothing depends on the order of files.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import canonical, digest, suffix
from shelfmark.operators.versions import RENDERER, once
from shelfmark.sources.files import EXTENSIONS, MAX_FILE_BYTES, in_scope, text_extraction

_META = "struct<title:string,kind:string,brand:string,model:string,language:string,external_reference:string,aliases:array<string>>"


def refused(files: DataFrame, roots: list[str]) -> DataFrame:
    """path, code of the files (path, length) that are not taken in: SOURCE_SCOPE, UNSUPPORTED_TYPE or FILE_TOO_LARGE, the first that applies."""
    code = (
        F.when(~in_scope(F.col("path"), roots), "SOURCE_SCOPE")
        .when(~F.coalesce(suffix(F.substring_index("path", "/", -1)).isin(EXTENSIONS), F.lit(False)), "UNSUPPORTED_TYPE")
        .when(F.col("length") > MAX_FILE_BYTES, "FILE_TOO_LARGE")
    )
    return files.select("path", code.alias("code")).filter("code IS NOT NULL")


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """path of the files that two listings (path, length, modified) show alike; what changed while it was read is left for the next scan."""
    return before.select("path", "length", "modified").intersect(after.select("path", "length", "modified")).select("path")


def ingest(files: DataFrame, documents: DataFrame, versions: DataFrame, roots: list[str], now: datetime) -> DataFrame:
    """document_id, version_id, path, fingerprint, source_hash, metadata, filename, quality, created_at, deduplicated of each text file.

    files: path, length, content. deduplicated rows name the version that is there already.
    """
    kept = files.join(refused(files, roots), "path", "left_anti").withColumn("suffix", suffix(F.substring_index("path", "/", -1)))
    texts = text_extraction(kept).join(kept.select("path", F.sha2("content", 256).alias("source_hash")), "path")
    owners = documents.select(F.col("source_path").alias("path"), "document_id")
    placed = texts.join(owners, "path", "left").withColumn("document_id", F.coalesce("document_id", F.concat(F.lit("doc-"), F.substring(F.sha2("path", 256), 1, 32))))
    known = once(versions)
    latest = known.groupBy("document_id").agg(F.max_by("metadata", F.struct("created_at", "version_id")).alias("_meta"))
    name = F.substring_index("path", "/", -1)
    with_meta = placed.join(latest, "document_id", "left").withColumn("filename", name)
    m = F.col("_meta")
    fields = {f: m[f] for f in ("title", "kind", "brand", "model", "language", "external_reference", "aliases")}
    fields["title"], fields["kind"] = F.coalesce(m["title"], F.col("filename")), F.coalesce(m["kind"], F.lit("document"))
    with_meta = with_meta.withColumn("metadata", F.struct(*[c.alias(f) for f, c in fields.items()]).cast(_META))
    extraction = F.struct(F.col("quality").alias("status"), F.col("text").alias("text"), F.col("warning").alias("warning"))
    whole = canonical(("source", F.col("source_hash")), ("metadata", F.struct(*[F.col(f"metadata.{f}").alias(f) for f in sorted(fields)])), ("extraction", extraction), ("renderer", F.lit(RENDERER)))
    printed = with_meta.withColumnRenamed("status", "quality").withColumn("fingerprint", digest(whole))
    have = known.groupBy("document_id", "fingerprint").agg(F.min("version_id").alias("_have"))
    joined = printed.join(have, ["document_id", "fingerprint"], "left")
    new_id = F.concat(F.lit("ver-"), F.substring(F.sha2(F.concat_ws("\x01", "document_id", "fingerprint"), 256), 1, 32))
    return joined.select(
        "document_id", F.coalesce("_have", new_id).alias("version_id"), "path", "fingerprint", "source_hash", "metadata", "filename", "quality", F.lit(now).cast("timestamp_ntz").alias("created_at"),
        F.col("_have").isNotNull().alias("deduplicated"),
    )
