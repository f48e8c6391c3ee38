import random

import pytest

from shelfmark.llm import ocr as O

SENTENCES = [
    "The calibration team records the reference thermometer behind the cooling unit.", "Before each run, the receiving desk labels the filter cassette within the agreed window.", "During the night routine, a trained technician verifies the maintenance record.",
    "The document curator releases the sealed transport box with a lint-free cloth.", "Whenever the drawer was moved, the archive clerk compares the carry-over protocol.", "An external assessor re-tests the incubation plate against the acceptance limit.",
]
NOISE = [("n", "ri"), ("t", "f"), ("e", "c"), ("m", "rn"), ("i", "!"), ("w", "vv"), ("h", "b"), ("o", "0")]


def made(rng, n_pages, noisy=0.1):
    """Pages of a scanned version and the defects in them."""
    pages, truth, rest = [], set(), ""
    for number in range(1, n_pages + 1):
        lines = ["Tadore Calibrator change notice - Ed. 15", f"- {number + 6} -", ""]
        truth |= {(number, 1, "header"), (number, 2, "page_no")}
        words = (rest + " " if rest else "").split() + " ".join(rng.choices(SENTENCES, k=6)).split()
        rest = ""
        line = ""
        for k, w in enumerate(words):
            core = w.strip(".,")
            if rng.random() < noisy and len(core) > 5 and "-" not in core and w[0].islower():
                a, b = rng.choice([x for x in NOISE if x[0] in core[1:-1]] or [("", "")])
                if a and core.count(a) and (bad := core[0] + core[1:-1].replace(a, b, 1) + core[-1]) != core:
                    w = w.replace(core, bad)
                    lines.append(line)
                    line = w
                    truth.add((number, len(lines) + 1, "char"))
                    lines.append(line)
                    line = ""
                    continue
            if len(line) + len(w) > 55:
                if len(w) > 8 and "-" not in w and k < len(words) - 1:
                    lines.append(f"{line} {w[:4]}-".strip())
                    truth.add((number, len(lines), "hyphen"))
                    line = w[4:]
                    continue
                lines.append(line)
                line = ""
            line = f"{line} {w}".strip()
        lines.append(line)
        lines = [x for i, x in enumerate(lines) if x or i < 3]
        pages.append((number, lines))
    return pages, truth


@pytest.fixture(scope="module")
def words():
    import re
    from collections import Counter

    return dict(Counter(re.findall(r"[a-z]+(?:[-'][a-z]+)*", " ".join(SENTENCES * 50).lower())))


@pytest.fixture(scope="module")
def editor(words):
    rng = random.Random(1)
    pages = ["\n".join(x) for _ in range(60) for _, x in made(rng, 3)[0]]
    return O.train_editor(O.training_pairs(pages, words), words)


def test_editor_on_held_out_noise(words, editor):
    rng = random.Random(2)
    e, tried, right, kept = O.Editor(editor, words), 0, 0, 0
    for w in words:
        for a, b in NOISE:
            if len(w) > 5 and a in w[1:-1] and "-" not in w and (bad := w[0] + w[1:-1].replace(a, b, 1) + w[-1]) not in words:
                tried += 1
                got = e.fixed(bad)
                right += bool(got and got[0] == w)
    for _ in range(200):
        kept += e.fixed("".join(rng.choices("bcdfgklmnprstvxz", k=8))) is None
    assert tried > 60 and right / tried > 0.9 and kept == 200


def test_round_trip(words, editor):
    rng = random.Random(3)
    r = O.Repairer(words, editor, None)
    hits = extra = missed = 0
    for _ in range(20):
        pages, truth = made(rng, 5)
        # The line breaks of misread words move; only structural defects are compared by line there.
        got, texts = r.version([(n, "\n".join(x)) for n, x in pages])
        a = {d for d in got if d[2] in ("header", "page_no")}
        b = {d for d in truth if d[2] in ("header", "page_no")}
        hits, extra, missed = hits + len(a & b), extra + len(a - b), missed + len(b - a)
        whole = " ".join(texts[n] for n in sorted(texts))
        unknown = [w for w in O._WORDS.findall(whole.lower()) if w not in words]
        assert len(unknown) <= 0.02 * len(whole.split()) and "Tadore" not in whole
    assert hits >= 200 and not extra and not missed


def test_breaks_and_own_hyphens(words, editor):
    r = O.Repairer(words, editor, None)
    pages = [(1, "The calibration team records the refer-\nence thermometer with a lint-\nfree cloth. The archive cle¬\nrk verifies the mainte-"), (2, "nance record behind the cooling unit.")]
    defects, texts = r.version(pages)
    assert {d for d in defects if d[2] == "hyphen"} == {(1, 1, "hyphen"), (1, 3, "hyphen"), (1, 4, "hyphen")}
    assert texts[1] == "The calibration team records the reference thermometer with a lint-free cloth. The archive clerk verifies the maintenance" and texts[2] == "record behind the cooling unit."


@pytest.mark.parametrize("line,shape", [("- 12 -", "decorated"), ("[l2]", "decorated"), ("Page 9 of 123", "word"), ("Seite 2", "word"), ("第 36 頁", "word"), ("l0 / 95", "total"), ("lxiv", "roman"), ("55", "plain"), ("limit.", None), ("", None), ("8.7", None), ("The 5", None)])
def test_page_number_shapes(line, shape):
    got = O.page_number(line)
    assert (got and got[0]) == shape


def test_headings_that_do_not_recur_stay(words, editor):
    r = O.Repairer(words, editor, None)
    pages = [(n, f"{'NOTICE 8.1' if n == 2 else 'The calibration team records'}\nthe thermometer behind the cooling unit.") for n in (1, 2)] + [(3, ""), (4, " \n")]
    assert r.version(pages)[0] == []


def test_headers_that_do_not_look_like_headings(words, editor):
    r = O.Repairer(words, editor, None)

    def headers(lines):
        return {d[:2] for d in r.version([(n, f"{x}\n{SENTENCES[n - 1]}\n{SENTENCES[(n + 2) % 6]}") for n, x in enumerate(lines, 1)])[0] if d[2] == "header"}

    assert headers([f"{x}    Tadore Calibrator change notice" for x in ("l7", "18", "l9", "20")]) == {(n, 1) for n in range(1, 5)}
    assert headers(["Gome Inc. Quality manual, part b.", "Gome Labs, quality manual"] * 3) == {(n, 1) for n in range(1, 7)}
    assert headers(["If two controls drift upwards, the team"] * 2 + ["cold", "warm", "wet"]) == set()


def test_operator(spark):
    rng = random.Random(4)
    pages, extractions, clean = [], [], " ".join(SENTENCES * 3)
    for i in range(30):
        for n, x in made(rng, 4)[0]:
            pages.append((f"s{i}", n, "\n".join(x)))
        extractions.append((f"s{i}", '{"ocr_language":"eng"}' if i % 3 else '"{\\"settings\\": {\\"ocr_language\\": \\"eng\\"}"'))
    pages += [(f"c{i}", n, clean) for i in range(40) for n in (1, 2)] + [("s0", 1, pages[0][2]), ("s1", 9, None), (None, 1, "x"), ("s2", None, "x")]
    extractions += [(f"c{i}", '{"settings": {"ocr_language": null}}') for i in range(40)] + [("c1", '{"cut'), (None, "{}"), ("s5", None)]
    p = spark.createDataFrame(pages, "version_id string, number int, text string").withColumn("certain", O.F.lit(1)).withColumn("block", O.F.lit(1))
    x = spark.createDataFrame(extractions, "version_id string, payload string")
    rows = O.find_defects(p, x).collect()
    assert {r.version_id for r in rows} == {f"s{i}" for i in range(30)} and {r.defect for r in rows} == {"hyphen", "char", "header", "page_no"}
    assert len(rows) == len(set(rows)) and sum(r.defect == "header" for r in rows) == 120
    assert O.repaired_pages(p, x).count() >= 120
    assert O.find_defects(p.limit(0), x.limit(0)).count() == 0


def test_blocks_give_the_same_as_the_whole(spark, words, editor, monkeypatch):
    rng = random.Random(6)
    pages = [(n, "\n".join(x)) for n, x in made(rng, 40, 0)[0]]
    whole = {d for d in O.Repairer(words, editor, None).version(pages)[0] if d[2] == "hyphen"}
    monkeypatch.setattr(O, "BLOCK_PAGES", 8)
    df = O._in_blocks(spark.createDataFrame([("v", n, t) for n, t in pages], "version_id string, number int, text string"))
    parts = set()
    for b in range(5):
        own = sorted((r.number, r.text) for r in df.filter(O.F.col("block") == b).collect())
        parts |= {d for d in O.Repairer(words, editor, None).version(own)[0] if d[2] == "hyphen" and b * 8 < d[0] <= b * 8 + 8}
    assert parts == whole and len(whole) > 40


def test_recurrence_is_decided_in_the_version_not_in_a_block(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(O, "BLOCK_PAGES", 8)
    monkeypatch.setattr(O, "CONTEXT_PAGES", 2)
    heads = {n: ("Tadore Calibrator change notice", "Gome Laboratory handbook")[n % 2] for n in range(1, 18)} | {2: "Appendix of Kezodo forms", 15: "Appendix of Kezodo forms"}
    rows = [("v", n, "\n".join([heads[n], *rng.sample(SENTENCES, 4), str(n + 6)])) for n in heads] + [(f"c{i}", 1, " ".join(SENTENCES)) for i in range(20)]
    p = spark.createDataFrame(rows, "version_id string, number int, text string")
    found = O.find_defects(p, spark.createDataFrame([("v", '{"ocr_language":"eng"}')], "version_id string, payload string"))
    assert {(r.page_number, r.defect) for r in found.filter("line_no in (1, 6)").collect()} >= {(n, d) for n in heads for d in ("header", "page_no")}
