import random

import pytest

from shelfmark.llm import leakage as L

WORDS = [f"w{i}" for i in range(4000)]


def brute(text, item, zh):
    """Any part of the item, against any part of the text, with at most one word in twelve replaced, left out or put in."""
    a = L.chars_of(item) if zh else L.words_of(item)
    b = L.chars_of(text) if zh else L.words_of(text)
    least = L.CHARS if zh else L.WORDS
    for i in range(len(a) - least + 1):
        row = [0] * (len(b) + 1)  # fewest differences of a[i:j] against a part of b that ends at each place
        for j in range(i, min(len(a), i + 2 * least)):
            new = [row[0] + 1]
            for k, w in enumerate(b):
                new.append(min(row[k] + (a[j] != w), row[k + 1] + 1, new[k] + 1))
            row = new
            n = j + 1 - i
            if n >= least and 12 * min(row) <= n:
                return True
    return False


@pytest.mark.parametrize("zh", [False, True])
def test_equals_brute_force(zh):
    rng = random.Random(5)
    alphabet = [chr(0x4E00 + i) for i in range(300)] if zh else WORDS
    join = "" if zh else " "
    items = [(i, "zh" if zh else "en", join.join(rng.choices(alphabet, k=rng.randint(30, 110)))) for i in range(6)]
    texts = []
    for _ in range(60):
        item = items[rng.randrange(6)][2]
        part = list(item) if zh else item.split()
        n = rng.randint(15, min(len(part), 90))
        s = rng.randint(0, len(part) - n)
        cut = part[s : s + n]
        for k in sorted(rng.sample(range(n), rng.randint(0, n // 9)), reverse=True):
            what = rng.random()
            cut[k : k + 1] = [rng.choice(alphabet)] if what < 0.5 else [] if what < 0.75 else [cut[k], rng.choice(alphabet)]
        texts.append(join.join([*rng.choices(alphabet, k=20), *cut, *rng.choices(alphabet, k=20)]))
    got = set(L.Matcher(items).leaks(texts))
    assert got == {(t, i) for t, text in enumerate(texts) for i, _, item in items if brute(text, item, zh)}
    assert len(got) > 10 and len(got) < 60


def test_forms_case_and_a_word_more_or_less():
    item = " ".join(WORDS[:40])
    m = L.Matcher([(7, "en", item)])
    quote = WORDS[5:33]
    disguised = ", ".join(quote).upper().replace("W1", "Ｗ1") + "."
    assert m.leaks([disguised]) == [(0, 7)]
    assert m.leaks([" ".join([*quote[:12], "extra", *quote[12:]])]) == [(0, 7)]
    assert m.leaks([" ".join([*quote[:12], *quote[13:]])]) == [(0, 7)]
    assert m.leaks([" ".join([*quote[:9], *quote[10:18], *quote[19:]])]) == [(0, 7)]  # left out at two places
    assert m.leaks([" ".join(quote[:20]), None, "", " ", "\n"]) == []
    assert m.leaks(["y " * 50_000 + " ".join(quote)]) == [(0, 7)]


def test_operator(spark, monkeypatch):
    items = [(1, "en", " ".join(WORDS[:60])), (2, "en", " ".join(WORDS[100:160])), (3, None, "第一行" * 20), (4, "en", None), (5, "en", "short")]
    docs = [(1, "x " + " ".join(WORDS[10:50])), (1, "x " + " ".join(WORDS[10:50])), (2, " ".join(WORDS[0:60] + WORDS[90:160])), (3, None), (4, ""), (5, "前" + "第一行" * 16)]
    i = spark.createDataFrame(items, "item_id long, lang string, text string").withColumn("doc_id", L.F.lit(1))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", L.F.lit(1))
    for most in (2_000_000, 10):  # by broadcast, and by shuffle
        monkeypatch.setattr(L, "BROADCAST_CHARS", most)
        assert {tuple(r) for r in L.find_leaks(d, i).collect()} == {(1, 1), (2, 1), (2, 2), (5, 3)}
    assert {r.doc_id for r in L.without_leaks(d, i).collect()} == {3, 4}
    assert L.find_leaks(d.limit(0), i).count() == 0 and L.find_leaks(d, i.limit(0)).count() == 0


def test_spans_are_removed(spark):
    items = spark.createDataFrame([(1, "en", " ".join(WORDS[:60])), (3, "zh", "甲乙丙丁戊己庚辛壬癸" * 5)], "item_id long, lang string, text string")
    quote = WORDS[10:50]
    quote[7], quote[20:21] = "other", []
    docs = [(1, "Before this. " + ",\n".join(quote).upper() + " After it."), (2, "before " * 30), (3, "前文。" + "甲乙丙丁戊，己庚辛壬癸" * 4 + "後文。"), (4, " ".join(WORDS[0:60]) + " x y z " + " ".join(WORDS[0:60]))]
    got = {r.doc_id: (r.text, r.n_spans) for r in L.without_spans(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {1: ("Before this.  After it.", 1), 3: ("前文。後文。", 1), 4: (" x y z ", 2)}
    left = spark.createDataFrame([(k, v[0]) for k, v in got.items()], "doc_id long, text string")
    assert L.find_leaks(left, items).count() == 0
