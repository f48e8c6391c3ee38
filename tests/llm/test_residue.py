import random
from re import _constants as C
from re import _parser

import pytest

from shelfmark.llm import residue as R

RUNNING = "The sampling nurse weighs the reagent pack (QF-1234) on the left-hand tray until a second reading agrees. " * 8


@pytest.mark.parametrize(
    "text,kind",
    [
        (None, None), ("", None), (" \n", None), (RUNNING, None), ("Short ordinary sentence [3/5] (3 °C).", None),
        ("Issued by {{approver}} on {{form_code}} for [Your site].", "placeholder"), ("{% a_b %} of #site#, valid for %DEVICE_NAME%.", "placeholder"), (RUNNING + "\n\nStore ${site} at @@OWNER@@ and ask <<x>>.", "placeholder"),
        ("由[待補]於[待補]核發，單位：[待補]。", "placeholder"), ("[à compléter] de [insérer la date], valable pour ${owner}.", "placeholder"), ("(to be completed) of (to be completed)", "placeholder"),
        (RUNNING + "The label designer writes {{lot}} in its manual where the printer later puts the lot.", None), (RUNNING + "Trainees see the prompt [INSERT DATE] on mock form 4.", None), ("```\n{{a}} {{b}}\n```\n" + RUNNING, None),
        ("Lorem ipsum dolor sit amet consectetur adipiscing elit.", "filler"), (RUNNING + "\n\nXxxxx xxxx xxxxxx xxx xxxx.\nasdf asdf asdf qwer qwer", "filler"), ("Your content here.\nSample text goes here.", "filler"), (RUNNING + "The poster uses the words lorem ipsum as an example.", None),
        ("404 Not Found\nThe requested page /x could not be located on this server.\nHome | Search", "error_page"), ("Please enable JavaScript to view this page.", "error_page"), ("<html><head><title>A</title></head><body><p>Zugriff verweigert. Bitte melden Sie sich erneut an.</p></body></html>", "error_page"),
        ("Instrucción de la cámara fría\n\nAcceso denegado. Inicie sesión de nuevo. Incidencia DA88D1.", "error_page"), (RUNNING + "The middleware shows error 404 when a worksheet was archived.", None), (RUNNING + "Open the viewer only in a browser with JavaScript enabled.", None), ("x" * 100_000, None),
    ],
)
def test_kinds(text, kind):
    assert R.residue_kind(text) == kind


def test_operator_equals_rule_on_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("kind", R.F.lit("clash"))
    want = {(r.doc_id, k) for r in docs.collect() if (k := R.residue_kind(r.text))}
    assert {(r.doc_id, r.kind) for r in R.find_residue(docs).collect()} == want and want
    assert R.find_residue(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "Home | Search | Imprint\n" * 60 + "404 Not Found\nThe requested page /x could not be located on this server.", "Please sign on again. Your session has timed out. " * 40,
        "<HTML><BODY>" + "<p>Zugriff verweigert. Bitte melden Sie sich erneut an.</p>" * 20, "410 Gone\n403 Forbidden\n", "Catalogue\n" * 90 + "Bitte versuchen Sie es später.",
    ],
)
def test_error_pages_of_any_length(spark, text):
    assert R.residue_kind(text) == "error_page"
    assert R.find_residue(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1


def a_match(pattern: str, rng: random.Random) -> str:
    """A text that the pattern finds, its branches chosen by chance; what looks around is left out."""

    def one_of(items):
        kind, value = rng.choice(items)
        if kind is C.RANGE:
            return chr(rng.randint(*value))
        if kind is C.LITERAL:
            return chr(value)
        return {C.CATEGORY_DIGIT: "7", C.CATEGORY_WORD: "k", C.CATEGORY_SPACE: " ", C.CATEGORY_NOT_WORD: "-", C.CATEGORY_NOT_DIGIT: "k", C.CATEGORY_NOT_SPACE: "k"}[value]

    def write(tree):
        out = ""
        for op, arg in tree:
            if op is C.LITERAL:
                out += chr(arg)
            elif op is C.IN:
                out += rng.choice("kK ") if arg[0][0] is C.NEGATE else one_of(arg)
            elif op is C.ANY:
                out += rng.choice("k -")
            elif op is C.BRANCH:
                out += write(rng.choice(arg[1]))
            elif op is C.SUBPATTERN:
                out += write(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                out += "".join(write(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
        return out

    return write(_parser.parse(pattern))


def test_every_error_sentence_has_a_stem():
    rng = random.Random(1)
    some = [x for pattern, n in ((R._ERROR, 6000), (R._SCRIPT, 1500)) for x in (a_match(pattern.pattern, rng) for _ in range(n)) if pattern.search(x)]
    some += [x.upper() for x in some if R._ERROR.search(x.upper())] + [x.replace("i", c) for x in some for c in "\u0130\u0131" if R._ERROR.search(x.replace("i", c))]
    assert len(some) > 10_000 and [x for x in some if not R._has_stem(x)] == []


def test_latin_gate_holds_for_every_latin_paragraph():
    rng = random.Random(2)
    latin = sorted(R.LATIN_FILLER)
    for _ in range(3000):
        words = [rng.choice(latin if rng.random() < 0.75 else ["tray", "valve", "Wärme", "7", "x1"]) for _ in range(rng.randint(5, 25))]
        text = rng.choice(["\n\n  - 1. ", "\u00a0", "("]) + "".join(w + rng.choice([" ", " ", ", ", "-", "/", "_", "'", ". "]) for w in words)
        own = R._WORD.findall(text.casefold())
        if sum(w in R.LATIN_FILLER for w in own) >= 0.7 * len(own):
            assert R._may_be_latin(text.casefold())


@pytest.mark.parametrize(
    "end", ["\n\nExcepteur sint occaecat cupidatat non", "\n\nUt enim ad minim veniam, quis nostrud", "\n\naaaa bbbb cccc dddd", "\n\nfoo bar foo bar foo bar foo bar", "\nApproved by: (TBD)", "\n(Datum eintragen)", "\n\uff5b\uff5bowner\uff5d\uff5d"]
)
def test_cases_at_the_end_of_long_texts(spark, end):
    text = RUNNING * 30 + end
    assert R.residue_kind(text) in ("placeholder", "filler")
    assert R.find_residue(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1
