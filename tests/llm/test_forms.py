import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from shelfmark.llm import forms as f


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("ＡＢＣ－１", "ABC-1", True), ("é", "é", True), ("Denolе", "Denole", True), ("ΒΟΡ", "BOP", True), ("check", "che​ck­", True), ("a b", "a b", True), ("ﬁne", "fine", True), ("a‑b", "a-b", True), ("更", "更", True),
        ("10³/µL", "10³/μL", True), ("e\u200c\u0301", "é", True), ("10³", "103", False), ("ABC", "abc", False), ("resume", "résumé", False), ("Жук", "Kyk", False), ("Привет", "Привет", True),
    ],
)
def test_equal_looks(a, b, same):
    assert (f.one_form(a) == f.one_form(b)) is same


def test_token_states_and_spelling():
    assert [f.one_form(x) for x in ("κ", "Π", "αρι", "Ά")] == [f.one_form(x) for x in ("к", "П", "api", "Á")]
    assert f.token_state("Denolе") == "mixed" and f.token_state("СОР") == "whole" and f.token_state("Привет") == "single" == f.token_state("plain")
    assert f.consistent_spelling("Приа") == "Приа"  # already one script
    assert f.consistent_spelling("Привеa") == "Привеа"  # Cyrillic holds all letters


@given(st.text(alphabet=st.sampled_from("aeopcxABEKMHOPTX1 -é³µ"), max_size=20), st.data())
def test_disguises_are_undone(text, data):
    out = []
    for ch in text:
        group = [c for c in f._GROUP.get(ch, [ch])]
        kind = data.draw(st.sampled_from(["same", "look", "wide", "split", "hidden"]))
        out.append({"look": data.draw(st.sampled_from(group)), "wide": chr(ord(ch) + 0xFEE0) if "!" <= ch <= "~" else ch, "split": unicodedata.normalize("NFD", ch), "hidden": ch + "​"}.get(kind, ch))
    assert f.one_form("".join(out)) == f.one_form(text)
    assert f.one_form(f.one_form(text)) == f.one_form(text)


def brute(rows):
    seen = {(n, k, t) for n, k, t in rows if t is not None and f.one_form(t).strip()}
    return {(n, min(a, b), max(a, b)) for n, a, s in seen for m, b, t in seen if n == m and a < b and s != t and f.one_form(s) == f.one_form(t)}


def test_pairs_equal_brute_force_also_when_salted(spark, monkeypatch):
    rows = [("title", f"k{i}", ["abc", "аbc", "ab​c", "xyz", "", None, "​", " "][i % 8]) for i in range(40)] + [("alias", "k1", "abc"), ("alias", "k2", "abc"), ("alias", "k1", "abc"), ("alias", "k1", "abс"), ("title", "z", "é" * 20000), ("title", "y", "é" * 20000)]
    df = spark.createDataFrame(rows, "field_name string, key string, text string").withColumn("h", f.F.lit("clash")).withColumn("s", f.F.lit("clash"))
    for limit in (20_000, 4):
        monkeypatch.setattr(f, "HOT_GROUP_ROWS", limit)
        got = {tuple(r) for r in f.look_alike_pairs(f.marked(df, ["field_name", "key"], "text")).collect()}
        assert got == brute(rows) and len(got) > 50
        classes = f.look_alike_classes(f.marked(df, ["field_name", "key"], "text")).collect()
        title = [r.n_links for r in classes if r.field_name == "title"]  # one text a key there
        assert sum(title) == 2 * sum(n == "title" for n, *_ in got) and {(r.field_name, r.key) for r in classes} == {(n, k) for n, a, b in got for k in (a, b)}
    assert f.look_alike_pairs(f.marked(df.limit(0), ["field_name", "key"], "text")).count() == 0


def test_forms_of_a_table(spark):
    df = spark.createDataFrame([(1, "ａb"), (2, None), (3, "plain"), (4, "")], "id int, text string").withColumn("form", f.F.lit("clash"))
    assert {r.id: r.form for r in f.with_one_form(df, "text").collect()} == {1: "ab", 2: None, 3: "plain", 4: ""}
