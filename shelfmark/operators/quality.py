"""Extraction quality and classification of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import SPACE, suffix
from shelfmark.operators.versions import once, pages_once

_VISIBLE = rf"(?U)[^\s\x1c-\x1f]"


def has_text(col: Column) -> Column:
    return F.coalesce(col.rlike(_VISIBLE), F.lit(False))


def page_quality(versions: DataFrame, pages: DataFrame) -> DataFrame:
    """version_id, n_pages, n_with_text, status, warning.

    No page with text: empty for plain text files, else needs_ocr. Some pages without: partial. Versions without pages count
    as without text.
    """
    counts = pages_once(pages).groupBy("version_id").agg(F.count("*").alias("n_pages"), F.count_if(has_text(F.col("text"))).alias("n_with_text"))
    v = once(versions).select("version_id", "filename").join(counts, "version_id", "left").na.fill(0, ["n_pages", "n_with_text"])
    plain = F.coalesce(suffix(F.col("filename")).isin(".txt", ".md"), F.lit(False))
    none = F.col("n_with_text") == 0
    some = F.col("n_with_text") < F.col("n_pages")
    status = F.when(none & plain, "empty").when(none, "needs_ocr").when(some, "partial").otherwise("extracted")
    warning = F.when(none, "NO_EXTRACTED_TEXT").when(some, "PAGES_WITHOUT_TEXT")
    return v.select("version_id", "n_pages", "n_with_text", status.alias("status"), warning.alias("warning"))


def markdown_images(text: Column) -> Column:
    """Markdown text that refers to images, which are not part of it."""
    return F.coalesce(text.rlike(r"(?i)!\[|<img\b"), F.lit(False))


# What tells the kinds of text beside an original, in order: status, then texts of which one or all must occur.
SIDECAR_MARKS = [
    ("OCR_REQUIRED", "any", ["ocr_status:\\s*needs_ocr", "需 OCR 後補摘要"]),
    ("METADATA_ONLY", "any", ["未做完整摘要與章節抽取", "lite sidecar"]),
    ("BRIEF_ONLY", "all", ["## 摘要", "## 原始檔"]),
]


def sidecar_status(text: Column) -> Column:
    """What a text file beside an original holds; the first that applies. It never proves a full text."""
    out = F.when(~has_text(text), "EMPTY")
    for status, how, marks in SIDECAR_MARKS:
        hits = F.array(*[text.rlike(m) for m in marks])
        out = out.when(F.exists(hits, lambda x: x) if how == "any" else F.forall(hits, lambda x: x), status)
    return out.otherwise("TEXT_UNVERIFIED")


def layout_quality(n_with_text: Column, ocr: Column) -> Column:
    """Quality of a layout parser's result: never complete without review."""
    return F.when((n_with_text == 0) & ~ocr, "needs_ocr").otherwise("partial")


# Failure codes of the layout parser that mean it can't be used here.
UNSUPPORTED_CODES = [
    "DOCLING_DEPENDENCY_MISSING", "DOCLING_DEPENDENCY_VERSION_UNVERIFIED", "DOCLING_MODEL_MANIFEST_REQUIRED", "DOCLING_INVALID_MODEL_MANIFEST", "DOCLING_MODEL_PATH_MISSING", "DOCLING_MODEL_HASH_MISMATCH",
    "DOCLING_MODEL_MANIFEST_INCOMPLETE", "DOCLING_PROFILE_UNSUPPORTED", "DOCLING_TESSERACT_MISSING", "DOCLING_TESSERACT_UNAVAILABLE", "DOCLING_TRAINEDDATA_MISSING",
]


def failure_status(code: Column) -> Column:
    return F.when(code.isin(UNSUPPORTED_CODES), "unsupported").otherwise("failed")


# What a log says of failed recognition, and what tells the markers of a pipeline's log, by code.
OCR_FAILURES = ["\\[ocr\\].*failed", "Failed loading language", "Tesseract couldn't load"]
PIPELINE_MARKS = {
    "DOCLING_PIPELINE_OSD": "\\bosd\\b|orientation\\s+and\\s+script|script\\s+detection",
    "DOCLING_PIPELINE_TABLEFALLBACK": "table[\\s_-]*fallback|fallback[\\s_-]*table|orphan[\\s_-]*cells?[^\\n]*(?:fallback|nearest[\\s-]*row)|(?:fallback|nearest[\\s-]*row)[^\\n]*orphan[\\s_-]*cells?",
    "DOCLING_PIPELINE_WARNING": "\\b(?:error|warning|failed)\\b",
}


def ocr_failed(log: Column) -> Column:
    """A parser's log tells that recognition failed although it ended well."""
    return F.coalesce(log.rlike(f"(?i){'|'.join(OCR_FAILURES)}"), F.lit(False))


def pipeline_markers(log: Column, has_errors: Column) -> Column:
    """Codes of what a pipeline's log tells, in order; errors count as a warning. The log itself is never passed on."""
    told = F.map_from_arrays(F.array(*map(F.lit, PIPELINE_MARKS)), F.array(*[F.coalesce(log.rlike(f"(?i){p}"), F.lit(False)) | (has_errors if code.endswith("WARNING") else F.lit(False)) for code, p in PIPELINE_MARKS.items()]))
    return F.map_keys(F.map_filter(told, lambda _, hit: hit))


# What a parse request may ask for, each with the code of a request that does not.
REQUEST_SUFFIXES = [".pdf", ".docx", ".pptx", ".xlsx", ".png", ".jpg", ".jpeg", ".tiff"]
REQUEST_LANGUAGE = r"^[a-z0-9_]+(?:\+[a-z0-9_]+)*$"
REQUEST_DEVICES = ["cpu", "cuda"]
REQUEST_SCALE = (0.1, 8.0)
REQUEST_CODES = ["DOCLING_PROFILE_UNSUPPORTED", "INVALID_OCR_LANGUAGE", "INVALID_DOCLING_DEVICE", "INVALID_DOCLING_OCR_SCALE"]


def request_problem(suffix_col: Column, language: Column, device: Column, scale: Column) -> Column:
    """First code of an invalid parse request; null if it is valid. A missing part is invalid."""
    valid = [suffix_col.isin(REQUEST_SUFFIXES), language.rlike(REQUEST_LANGUAGE), device.isin(REQUEST_DEVICES), ~F.isnan(scale) & scale.between(*REQUEST_SCALE)]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in zip(valid, REQUEST_CODES, strict=True)])


# What must not be in a public tree.
LEAK_PATTERNS = {
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "github-token": r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})",
    "google-token": r"ya29\.[A-Za-z0-9_-]{25,}",
    "cloud-document-url": r"(?:drive|docs)\.google\.com/(?:file/d/|drive/folders/|document/d/|spreadsheets/d/)[A-Za-z0-9_-]{15,}",
    "private-windows-path": r"(?i)[A-Za-z]:[\\/](?:Users|projects)[\\/][^\s\"']+",
    "private-unix-path": r"/(?:home|Users)/[A-Za-z0-9_.-]+/",
}


def leak_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """pattern, n_texts: texts in which each pattern occurs; one scan, zeros included."""
    counts = texts.agg(*[F.count_if(F.coalesce(F.col(text).rlike(p), F.lit(False))).alias(k) for k, p in LEAK_PATTERNS.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(f"`{k}`").alias("n_texts")) for k in LEAK_PATTERNS])
    return counts.select(F.inline(rows))


# Extensions that a public tree does not hold.
BLOCKED_SUFFIXES = [".pdf", ".doc", ".docx", ".xlsx", ".pptx", ".db", ".sqlite", ".sqlite3", ".pem", ".key", ".zip"]
#: Bytes of a file of a public tree at most.
MAX_PUBLIC_BYTES = 1_000_000


def tree_guard(files: DataFrame) -> DataFrame:
    """rule, n of files (source_path, text) that a public tree may not hold: blocked extensions, and else binary or large content."""
    blocked = F.coalesce(suffix(F.col("source_path")).isin(BLOCKED_SUFFIXES), F.lit(False))
    large = F.coalesce((F.octet_length("text") > MAX_PUBLIC_BYTES) | F.contains("text", F.lit("\x00")), F.lit(False))
    counts = files.agg(F.count_if(blocked).alias("a"), F.count_if(~blocked & large).alias("b"))
    return counts.select(F.inline(F.array(F.struct(F.lit("private-artifact-or-link").alias("rule"), F.col("a").alias("n")), F.struct(F.lit("binary-or-large-file").alias("rule"), F.col("b").alias("n")))))
