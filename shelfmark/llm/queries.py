"""Queries of the problems on training text, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import forms, language, leakage, ocr, packing, residue


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    cases = language.language_cases(_table(spark, sf, "documents"), _table(spark, sf, "versions"), _table(spark, sf, "pages"))
    return cases.select("table_name", "row_key", "page_number", "segment", "lang").distinct()


def p4_document_languages(spark: SparkSession, sf: str) -> DataFrame:
    return language.document_languages(_table(spark, sf, "documents"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return ocr.find_defects(_table(spark, sf, "pages"), _table(spark, sf, "extractions"))


def p5_repaired_pages(spark: SparkSession, sf: str) -> DataFrame:
    return ocr.repaired_pages(_table(spark, sf, "pages"), _table(spark, sf, "extractions"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return forms.look_alike_pairs(forms.library_texts(_table(spark, sf, "versions"), _table(spark, sf, "pages")))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The same as p6_found as one row per key with its class and number of links."""
    return forms.look_alike_classes(forms.library_texts(_table(spark, sf, "versions"), _table(spark, sf, "pages")))


def p6_page_forms(spark: SparkSession, sf: str) -> DataFrame:
    return forms.with_one_form(_table(spark, sf, "pages").select("version_id", "number", "text"), "text").select("version_id", "number", F.md5("form").alias("form_md5")).distinct()


def p6_token_states(spark: SparkSession, sf: str) -> DataFrame:
    return forms.token_report(_table(spark, sf, "pages"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """One packing of all texts for each class."""
    return packing.pack(packing.token_counts(_table(spark, sf, "documents")), _table(spark, sf, "containers"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf), _table(spark, sf, "containers"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p9_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.without_leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items")).select("doc_id")


def p9_without_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that leak something, their passages taken out."""
    return leakage.without_spans(_table(spark, sf, "documents"), _table(spark, sf, "eval_items")).select("doc_id", "n_spans", F.md5("text").alias("text_md5"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.find_residue(_table(spark, sf, "documents")).select("doc_id").distinct()


def p10_residue_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return residue.find_residue(_table(spark, sf, "documents")).groupBy("kind").agg(F.count("*").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_document_languages, p5_found, p5_repaired_pages, p6_found, p6_classes, p6_page_forms, p6_token_states, p8_containers, p8_fill, p9_found, p9_clean_documents, p9_without_passages, p10_found, p10_residue_kinds)}

SQL: dict[str, str] = {}
