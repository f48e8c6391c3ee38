"""Asset manifests, references and differences between declared and present files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import ASSET_ADDRESS, safe_bundle_path

#: Bytes that the assets of one extraction hold at most.
MAX_ASSET_BYTES = 128 * 1024 * 1024


def manifest_problems(assets: DataFrame) -> DataFrame:
    """version_id, asset, problem. assets: version_id, asset, sha256, bytes, media_type, role. The first that applies."""
    named = F.regexp_extract("asset", ASSET_ADDRESS, 1)
    n = F.col("bytes").try_cast("bigint")
    p = (
        F.when((F.coalesce(named, F.lit("")) == "") | ~F.col("sha256").eqNullSafe(named), "address")
        .when(n.isNull() | (n < 0), "size")
        .when(F.col("media_type").isNull() | F.col("role").isNull(), "metadata")
    )
    own = assets.select("version_id", "asset", p.alias("problem")).filter(F.col("problem").isNotNull())
    total = assets.groupBy("version_id").agg(F.sum(n).alias("t")).filter(F.col("t") > MAX_ASSET_BYTES).select("version_id", F.lit(None).cast("string").alias("asset"), F.lit("total").alias("problem"))
    return own.unionByName(total)


def asset_totals(assets: DataFrame) -> DataFrame:
    """version_id, n_assets, n_bytes."""
    return assets.groupBy("version_id").agg(F.count("*").alias("n_assets"), F.sum(F.col("bytes").try_cast("bigint")).alias("n_bytes"))


def unresolved(references: DataFrame, assets: DataFrame) -> DataFrame:
    """version_id, asset, kind of references that the version's manifest does not hold."""
    return references.filter(F.coalesce("asset", F.lit("")) != "").distinct().join(assets.select("version_id", "asset").distinct(), ["version_id", "asset"], "left_anti").select("version_id", "asset", "kind")


def unlocated_media(packaged: DataFrame, located: DataFrame) -> DataFrame:
    """Packaged media (version_id, asset) that no page refers to."""
    return packaged.select("version_id", "asset").distinct().join(located.select("version_id", "asset").distinct(), ["version_id", "asset"], "left_anti")


def file_differences(declared: DataFrame, present: DataFrame) -> DataFrame:
    """path, problem of two file lists (path, bytes, sha256): missing, extra, size, hash; the first that applies."""
    a = declared.select(F.col("path").alias("_a"), F.col("bytes").alias("_n"), F.lower("sha256").alias("_s"))
    b = present.select(F.col("path").alias("_b"), F.col("bytes").alias("_m"), F.lower("sha256").alias("_t"))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    p = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_n") != F.col("_m"), "size").when(F.col("_s") != F.col("_t"), "hash")
    return j.select(F.coalesce("_a", "_b").alias("path"), p.alias("problem")).filter(F.col("problem").isNotNull())


def path_problem(path: Column) -> Column:
    """Code of a path that a bundle may not hold."""
    return F.when(~F.coalesce(safe_bundle_path(path), F.lit(False)), "UNSAFE_PATH")


def relative_model_path(path: Column) -> Column:
    """The path with forward slashes; null if it is absolute, empty, or has empty, . or .. parts."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = (p == "") | p.startswith("/") | p.rlike(r"^[A-Za-z]:") | F.contains(p, F.lit("\x00")) | F.exists(F.split(p, "/"), lambda x: x.isin("", ".", ".."))
    return F.when(~bad, p)


def overlapping_paths(paths: DataFrame) -> DataFrame:
    """inner, outer: paths of which one lies in the other, found by joining each path's own folders with the paths."""
    words = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, 1, i), "/"))
    own = paths.select("path").distinct().select(F.col("path").alias("inner"), F.explode(folders).alias("outer"))
    return own.join(paths.select(F.col("path").alias("outer")).distinct(), "outer", "left_semi").filter("inner <> outer").select("inner", "outer")


def metadata_problems(versions: DataFrame) -> DataFrame:
    """version_id, problem: metadata fields beyond 500 characters, more than 50 aliases, or an alias beyond 200."""
    m = "metadata"
    long = None
    for f in ("title", "kind", "brand", "model", "language", "external_reference"):
        x = F.coalesce(F.length(f"{m}.{f}") > 500, F.lit(False))
        long = x if long is None else long | x
    aliases = F.coalesce((F.size(f"{m}.aliases") > 50) | F.exists(f"{m}.aliases", lambda a: a.isNull() | (F.length(a) > 200)), F.lit(False))
    p = F.when(long, "METADATA_SCHEMA").when(aliases, "METADATA_SCHEMA_ALIASES")
    return versions.select("version_id", p.alias("problem")).filter(F.col("problem").isNotNull()).distinct()


METADATA_SCHEMA = "title string, kind string, brand string, model string, language string, external_reference string, aliases array<string>"
METADATA_FIELDS = ["title", "kind", "brand", "model", "language", "external_reference", "aliases"]


def metadata_from_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, metadata, problem of metadata given as JSON text: METADATA_SCHEMA for broken JSON, other types, or unknown fields."""
    bad = {"columnNameOfCorruptRecord": "_bad"}
    parsed = df.select(key, F.from_json(text, f"{METADATA_SCHEMA}, _bad string", bad).alias("m"), F.json_object_keys(text).alias("k"))
    wrong = F.col("k").isNull() | F.col("m._bad").isNotNull() | (F.size(F.array_except("k", F.array(*map(F.lit, METADATA_FIELDS)))) > 0)
    return parsed.select(key, F.struct(*[F.col(f"m.{f}").alias(f) for f in METADATA_FIELDS]).alias("metadata"), F.when(wrong, "METADATA_SCHEMA").alias("problem"))
