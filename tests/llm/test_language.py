import pytest

from shelfmark.llm import language as L


@pytest.fixture(scope="module")
def model(spark, data):
    return L.fit_on(spark.read.parquet(f"{data}/documents.parquet"))


@pytest.mark.parametrize("label,code", [("en-GB", "en"), ("EN", "en"), ("eng", "en"), ("Deutsch", "de"), ("chi_tra", "zh"), ("zh-Hant", "zh"), ("中文", "zh"), ("português", "pt"), ("fr_BE", "fr"), ("", None), ("unknown", None), ("und", None), ("n/a", None), (None, None), ("it", "it"), (" es ", "es")])
def test_labels(label, code):
    assert L.label_language(label) == code


def test_held_out_accuracy(spark, model, data):
    """On pages, none of which the model has seen; labels that are wrong are a few percent."""
    v = {r.version_id: L.label_language(r.lang) for r in spark.read.parquet(f"{data}/versions.parquet").selectExpr("version_id", "metadata.language as lang").collect()}
    pages = [(v.get(r.version_id), p) for r in spark.read.parquet(f"{data}/pages.parquet").collect() if r.text for p in L.paragraphs(r.text)[:3] if len(p) > 80]
    found = model.classify([p for _, p in pages])
    pairs = [(want, lang) for (want, _), (lang, *_) in zip(pages, found, strict=True) if want and lang]
    assert len(pairs) > 200 and sum(a == b for a, b in pairs) / len(pairs) > 0.9
    assert sum(lang is None for lang, *_ in found) / len(found) < 0.02


def test_rejection_and_paragraphs(model):
    en = "The calibration team records the reference thermometer behind the cooling unit before any specimen is reported."
    de = "Der Schichtführer überträgt das Bezugsthermometer gemäß dem ausgehängten Plan, damit der Verlauf sichtbar bleibt."
    out = model.classify([en, de, "12 / 34", "", "Zk Qx", "qwrtz pfgh " * 10])
    assert [o[0] for o in out[:2]] == ["en", "de"] and out[0][2] > 0.5 and [o[0] for o in out[2:]] == [None] * 4
    assert L.paragraphs("a\nb\n \n\nc\n") == ["a\nb", "c"]
    assert L.main_language(model.classify([en, en, de]))[0] == "en" and L.main_language([]) == (None, 0.0)


def test_cases(spark, model, data):
    en = "The calibration team records the reference thermometer behind the cooling unit before any specimen is reported."
    de = "Der Schichtführer überträgt das Bezugsthermometer gemäß dem ausgehängten Plan, damit der Verlauf sichtbar bleibt."
    docs = spark.createDataFrame([(1, "en", en), (2, "German", f"{de}\n\n{en}\n\n{de}"), (3, None, de), (4, "fr", en), (5, "de", "{{a}} of {{b}}, {{c}}"), (6, None, None), (7, "", " \n"), (8, "x", en * 500), (4, "fr", en)], "doc_id long, lang string, text string")
    meta = "struct<language:string>"
    versions = spark.createDataFrame([("v1", ("en",)), ("v2", None), ("v2", None), ("v3", ("und",)), ("v4", ("de",))], f"version_id string, metadata {meta}")
    pages = spark.createDataFrame([("v1", 1, en), ("v1", 2, f"{en}\n\n{de}"), ("v1", 2, f"{en}\n\n{de}"), ("v2", 1, de), ("v3", 1, " "), ("v3", 2, None), ("v4", 1, f"{en}\n\n{en}\n\n{de}")], "version_id string, number int, text string").withColumn("lang", L.F.lit("clash"))
    import unittest.mock as mock

    with mock.patch.object(L, "fit_on", lambda _: model):
        got = {tuple(r)[:5] for r in L.language_cases(docs, versions, pages).collect()}
        assert got == {
            ("documents", "2", 0, 2, "en"), ("documents", "3", 0, 0, "de"), ("documents", "4", 0, 0, "en"), ("documents", "8", 0, 0, "en"),
            ("versions", "v1", 2, 2, "de"), ("versions", "v2", 0, 0, "de"), ("versions", "v4", 0, 0, "en"), ("versions", "v4", 1, 3, "de"),
        }
        assert L.language_cases(docs.limit(0), versions.limit(0), pages.limit(0)).count() == 0


def test_without_any_label(spark):
    """The seed texts give a model; nothing crashes on tables without rows or labels."""
    en = "The calibration team records the reference thermometer behind the cooling unit before any specimen is reported to those who asked for it."
    de = "Der Schichtführer überträgt die Werte gemäß dem ausgehängten Plan, damit der Verlauf für alle sichtbar bleibt, die danach fragen."
    docs = spark.createDataFrame([(1, None, en), (2, "unknown", f"{de}\n\n{de}\n\n{en}"), (3, None, None)], "doc_id long, lang string, text string")
    versions = spark.createDataFrame([("v", ("ＥＮＧＬＩＳＨ",)), ("w", None)], "version_id string, metadata struct<language:string>")
    pages = spark.createDataFrame([("v", 1, en), ("w", 1, de), ("w", 1, "")], "version_id string, number int, text string")
    got = {tuple(r)[:5] for r in L.language_cases(docs, versions, pages).collect()}
    assert got == {("documents", "1", 0, 0, "en"), ("documents", "2", 0, 0, "de"), ("documents", "2", 0, 3, "en"), ("versions", "w", 0, 0, "de")}
    assert L.language_cases(docs.limit(0), versions.limit(0), pages.limit(0)).count() == 0


def test_texts_in_another_script_keep_their_letters():
    assert L._spelt("оса сор") == "оса сор" and L._spelt("The sаmple is reаdy for the anаlyser") == "The sample is ready for the analyser"
