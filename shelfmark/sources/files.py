"""Files as rows: recursive listing, text decoding, JSON snapshots, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import suffix

# Extensions that are ingested.
EXTENSIONS = [".txt", ".md", ".pdf", ".doc", ".docx", ".xlsx", ".pptx", ".png", ".jpg", ".jpeg", ".tiff"]
MAX_FILE_BYTES = 25 * 1024 * 1024

INVENTORY_SCHEMA = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("meta", T.StructType([T.StructField("complete", T.StringType()), T.StructField("generated_at", T.StringType())])),
    T.StructField("entries", T.ArrayType(T.StructType([
        T.StructField("file_id", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()), T.StructField("integrity", T.MapType(T.StringType(), T.StringType())),
    ]))),
])


def list_files(spark: SparkSession, roots: list[str], with_content: bool = False, with_empty: bool = True) -> DataFrame:
    """path, length, suffix (and content) of the files under the roots with an ingested extension, within the size cap.

    Without content only the listing is read. The reader leaves out files of length 0; with_empty adds them from the
    driver's listing of paths.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    clean = lambda c: F.regexp_replace(c, "^file:/*", "/")
    extra = ["content"] if with_content else []
    out = files.select(clean("path").alias("path"), "length", *extra)
    if with_empty:
        listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "p string").select(clean(F.try_url_decode(F.replace("p", F.lit("+"), F.lit("%2B")))).alias("path"))
        empty = listed.join(out.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), *[F.lit(b"").alias(c) for c in extra])
        out = out.unionByName(empty)
    out = out.withColumn("suffix", suffix(F.substring_index("path", "/", -1)))
    return out.filter(F.col("suffix").isin(EXTENSIONS) & (F.col("length") <= MAX_FILE_BYTES))


def in_scope(path: Column, roots: list[str]) -> Column:
    """The path lies under one of the roots."""
    out = F.lit(False)
    for r in roots:
        out = out | path.startswith(r.rstrip("/") + "/")
    return out


def text_extraction(files: DataFrame) -> DataFrame:
    """path, status, warning, text of plain text files (path, suffix, content): a byte-order mark is dropped; invalid UTF-8 or NUL fails."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), r"^\x{FEFF}", "")
    nul = F.contains(F.col("content").cast("string"), F.lit("\x00"))
    plain = files.filter(F.col("suffix").isin(".txt", ".md")).select("path", "suffix", text.alias("text"), valid.alias("_v"), nul.alias("_n"))
    blank = ~F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")
    images = (F.col("suffix") == ".md") & F.col("text").rlike(r"(?i)!\[|<img\b")
    status = F.when(~F.col("_v") | F.col("_n"), "failed").when(blank, "empty").when(images, "partial").otherwise("extracted")
    warning = F.when(~F.col("_v"), "INVALID_UTF8").when(F.col("_n"), "BINARY_TEXT").when(blank, "NO_EXTRACTED_TEXT").when(images, "MARKDOWN_ASSETS_NOT_IMPORTED")
    return plain.select("path", status.alias("status"), warning.alias("warning"), F.when(status != "failed", F.col("text")).alias("text"))


def content_addressed(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """sha256, length, content of the distinct contents that are not known yet (sha256)."""
    out = files.select(F.sha2("content", 256).alias("sha256"), "length", "content").dropDuplicates(["sha256"])
    return out if known is None else out.join(known.select("sha256"), "sha256", "left_anti")


def inventory_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a complete inventory snapshot; raises INVENTORY_SCHEMA or INCOMPLETE_INVENTORY otherwise."""
    raw = spark.read.text(path, wholetext=True)
    checked = raw.select(
        F.from_json("value", INVENTORY_SCHEMA).alias("s"),
        F.get_json_object("value", "$.schema_version").alias("v"),
        F.expr("schema_of_variant(variant_get(try_parse_json(value), '$.meta.complete'))").alias("kind"),
        F.get_json_object("value", "$.meta.complete").alias("complete"),
        F.from_json("value", "entries array<struct<size string>>")["entries"].alias("given"),
    )
    # A size that is there but no whole number, or below 0, is no size.
    odd = F.exists(F.arrays_zip(F.transform("given", lambda x: x["size"]).alias("g"), F.transform("s.entries", lambda x: x["size"]).alias("n")), lambda x: x["g"].isNotNull() & (x["n"].isNull() | (x["n"] < 0)))
    row = checked.select("v", "kind", "complete", F.col("s.entries").isNull().alias("none"), F.coalesce(odd, F.lit(False)).alias("odd")).limit(2).collect()
    if len(row) != 1 or row[0].v != "1.0.0" or row[0].none or row[0].odd:
        raise ValueError("INVENTORY_SCHEMA")
    if row[0].kind != "BOOLEAN" or row[0].complete != "true":
        raise ValueError("INCOMPLETE_INVENTORY")
    return checked.select(F.inline("s.entries"))


def parsed_pages(records: DataFrame) -> DataFrame:
    """path, number, text, width, height of a parser's JSON pages ([{page, text, width, height}]); raises nothing, keeps the reported numbers."""
    pages = F.from_json("pages", "array<struct<page:int,text:string,width:double,height:double>>")
    return records.select("path", F.inline(pages)).withColumnRenamed("page", "number")
