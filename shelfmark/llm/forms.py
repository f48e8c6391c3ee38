"""Visually identical text with different characters brought to one form (problem 6).

Method: the scripts in which each letter of a token could be written (its own and those that have a look-alike of it) are
intersected across the token. That finds mixed tokens and whole-script confusables; the token is written in the consistent
script, Latin before others. The remaining forms are normalised: width forms, composed accents, compatibility ideographs,
ligatures, invisible characters, spaces and hyphens.

Letter case, missing accents and raised digits are visible and stay. Null stays null; a text without any visible character
becomes the empty text; texts are taken whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrow import map_batches
from shelfmark.operators.skew import heavy_keys, lookup
from shelfmark.session import written

# The confusable letters of Latin, Greek, Cyrillic and Armenian in Unicode's data (case by case, those that differ by more
# than script left out), each line the letters of one look, Latin first where it has one.
LOOK_ALIKES = """
A Α А
Æ Ӕ
Á Ά
Ă Ӑ
Ä Ӓ
B Β В
C С Ϲ
Ç Ҫ
E Ε Е
È Ѐ
É Έ
Ĕ Ӗ
Ë Ё
F Ϝ
G Ԍ
H Η Н
I Ι І Ӏ
Í Ί
Ï Ϊ Ї
J Ј Ϳ
K Κ К
M Μ М Ϻ
N Ν
O Ο О Օ
Ó Ό
Ö Ӧ
Ɵ Θ Ѳ Ө ϴ
P Ρ Р
Q Ԛ
S Ѕ Տ
T Τ Т
U Ս
V Ѵ
W Ԝ
X Χ Х
Y Υ У Ү ϒ
Ý Ύ ϓ
Ȳ Ӯ
Ÿ Ϋ Ӱ ϔ
Ɏ Ұ
Z Ζ
Ʒ З Ӡ
Þ Ϸ
Ɔ Ͻ
Ə Ә
Ɛ Ԑ
Ʃ Σ
Ʌ Λ Л
Ƕ Ԋ
a α а
æ ӕ
á ά
ă ӑ
ä ӓ
ƅ ь
c с ϲ
ç ҫ
d ԁ
e е ҽ
è ѐ
ĕ ӗ
ë ё
ę ҿ
f ք
g ց
h һ հ
ħ ћ
i ι і
í ί
ï ϊ ї
j ј ϳ
l ӏ
n ո ռ
ƞ η
o ο о օ σ
ó ό
ö ӧ
p ρ р
q ԛ գ զ
r г
ŕ ѓ
ɍ ғ
s ѕ
u υ ս
ú ύ
ü ϋ
v ν ѵ
w ѡ ԝ ա
x х
y у ү γ
ȳ ӯ
ÿ ӱ
ɏ ұ
ß β
þ ϸ
ĸ κ к
ǝ ә
ȝ ӡ
ȷ յ
ɸ φ ф
Γ Г
Π П
Φ Ф Փ
Ψ Ѱ
π п
ψ ѱ
τ т
δ ծ
ε є ԑ
"""
_SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in ("Latin", "Cyrillic", "Greek", "Armenian")}
# Hyphens of one look.
HYPHENS = "‐‑－﹣"
# Decompositions that change the look and are therefore not applied.
VISIBLE_TAGS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}͏ᅟᅠㅤﾠ]+")
_SPACES = regex.compile(r"[\p{Zs}\t]")
_OTHER_LETTERS = regex.compile(r"[\p{Script=Greek}\p{Script=Cyrillic}\p{Script=Armenian}]")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_KEPT = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x80, 0x33FF) if unicodedata.decomposition(chr(c)).startswith(VISIBLE_TAGS)) + "]")
_HYPHEN = re.compile(f"[{HYPHENS}]")


#: Signs that are written between letters of any script.
COMMON_LETTERS = "μ"


def _script(ch: str) -> str | None:
    if ch in COMMON_LETTERS:
        return None
    return next((n for n, p in _SCRIPTS.items() if p.match(ch)), None)


_GROUP = {ch: line.split() for line in LOOK_ALIKES.strip().splitlines() for ch in line.split()}


#: A letter of another script, and a token with one: all other tokens are in their one spelling.
_FOREIGN = r"\u0370-\u03bb\u03bd-\u058f"
_HAS_FOREIGN = re.compile(f"[{_FOREIGN}]")
_FOREIGN_TOKEN = re.compile(rf"(?:[^\W_]|[\u0300-\u036f])*[{_FOREIGN}](?:[^\W_]|[\u0300-\u036f])*")


#: Look-alikes that normalisation would turn into a letter of another look; they are spelt in Latin before.
_EARLY = {ch: g[0] for ch, g in _GROUP.items() if unicodedata.normalize("NFKC", ch) not in (ch, g[0])}
_HAS_EARLY = re.compile(f"[{''.join(_EARLY)}]")


@lru_cache(maxsize=4096)
def _spellings(ch: str) -> dict[str, str] | None:
    """Script to spelling of a letter; null for characters that belong to every script."""
    own = _script(ch)
    if own is None:
        return None
    found = {own: ch}
    for other in _GROUP.get(ch, ()):
        found.setdefault(_script(other), other)
    return found


@lru_cache(maxsize=65536)
def consistent_spelling(token: str) -> str:
    """The token in one script, if there is one in which all of its letters have that look; else letter by letter, Latin first."""
    scripts: set[str] | None = None
    for ch in token:
        if (s := _spellings(ch)) is not None:
            scripts = set(s) if scripts is None else scripts & set(s)
    if scripts is None:
        return token
    order = [s for s in _SCRIPTS if s in scripts] or list(_SCRIPTS)
    spell = lambda s: next(s[k] for k in [*order, *s] if k in s)
    return "".join(ch if (s := _spellings(ch)) is None else spell(s) for ch in token)


def token_state(token: str) -> str:
    """single, mixed (no common script as written) or whole (one other script, all of it looking Latin)."""
    written = {s for ch in token if (s := _script(ch))}
    if len(written) > 1:
        return "mixed"
    if written and written != {"Latin"} and consistent_spelling(token) != token:
        return "whole"
    return "single"


def one_form(text: str) -> str:
    """The one form of all texts that look like this one."""
    if text.isascii():
        return text
    if not _UNUSUAL.search(text):
        return text.replace("µ", "μ")
    return _full_form(text)


def _full_form(text: str) -> str:
    if _HAS_EARLY.search(text):
        text = _HAS_EARLY.sub(lambda m: _EARLY[m.group()], text)
    if _KEPT.search(text):
        text = "".join(p if _KEPT.match(p) else unicodedata.normalize("NFKC", p) for p in re.split(f"({_KEPT.pattern})", text) if p)
        text = unicodedata.normalize("NFC", text)
    else:
        text = unicodedata.normalize("NFKC", _HYPHEN.sub("-", text))
    text = _SPACES.sub(" ", _INVISIBLE.sub("", _HYPHEN.sub("-", text)))
    if _HAS_FOREIGN.search(text):
        text = _FOREIGN_TOKEN.sub(lambda m: consistent_spelling(m.group()), text)
    return unicodedata.normalize("NFC", text)  # what an invisible character kept apart is composed now


#: A character that may need more than the micro sign does: all but the Latin letters and signs that are their own form, and ideographs.
_UNUSUAL = re.compile("[^\x00-\x7fµ" + "".join(re.escape(chr(c)) for c in range(0xA1, 0x180) if _full_form(chr(c)) == chr(c)) + "\u4e00-\u9fff]")


def with_one_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """Adds ``out`` (in place of a column of that name), the one form of ``text``. ASCII texts do not go through Python."""
    df = df.drop(out)
    plain = F.coalesce(~F.col(text).rlike(r"[^\x00-\x7F]"), F.lit(True))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    other = map_batches(df.filter(~plain), lambda c: {**c, out: [one_form(t) for t in c[text]]}, f"{fields}, `{out}` string")
    return df.filter(plain).withColumn(out, F.col(text)).unionByName(other)


def marked(df: DataFrame, fields: list[str], text: str) -> DataFrame:
    """fields with h (of the text) and s (of its one form), for texts with a visible character."""
    names = ", ".join(f"`{f}` {df.schema[f].dataType.simpleString()}" for f in fields)
    plain = ~F.col(text).rlike(r"[^\x00-\x7F]")
    rows = df.select(*fields, text).filter(F.col(text).isNotNull())
    native = rows.filter(plain).filter(F.col(text).rlike(r"[!-~]")).select(*fields, F.md5(text).alias("h"), F.md5(text).alias("s"))

    def digest(c: dict[str, list]) -> dict[str, list]:
        from hashlib import md5

        forms = [one_form(t) for t in c[text]]
        keep = [i for i, f in enumerate(forms) if f and not f.isspace()]
        hexes = lambda v: [md5(v[i].encode("utf-8", "surrogatepass")).hexdigest() for i in keep]
        return {**{f: [c[f][i] for i in keep] for f in fields}, "h": hexes(c[text]), "s": hexes(forms)}

    return native.unionByName(map_batches(rows.filter(~plain), digest, f"{names}, h string, s string"))


#: Rows with one look from which the group is salted.
HOT_GROUP_ROWS = 20_000
SALTS = 16


def _groups(rows: DataFrame) -> DataFrame:
    """g, n, n_spellings of the looks that stand in different characters; rows: of :func:`marked`, with g."""
    spellings = rows.groupBy("g", "h").agg(F.count("*").alias("n"))
    return written(spellings.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("n_spellings")).filter("n_spellings > 1"), "looks")


def _with_group(rows: DataFrame) -> DataFrame:
    """The rows once each, written: they are read for the groups and for the join, and their forms should be made once."""
    return written(rows.distinct(), "forms").withColumn("g", F.concat_ws("\x01", "field_name", "s"))


def _among_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of the groups with their counts; the largest groups are not shuffled by their name."""
    return lookup(rows, groups, "g", heavy_keys(groups, "g", "n"), "inner")


def look_alike_classes(rows: DataFrame) -> DataFrame:
    """field_name, key, class_id, spelling_id, n_links of each row whose text has a look-alike in other characters.

    n_links: the rows of its class in another spelling. It says the same as :func:`look_alike_pairs` in one row a row. rows: field_name, key, h,
    s of :func:`marked`.
    """
    rows = _with_group(rows)
    counts = rows.groupBy("g", "h").agg(F.count("*").alias("_own")).withColumn("_gh", F.concat("g", F.lit("\x01"), "h"))
    mine = _among_groups(rows, _groups(rows)).withColumn("_gh", F.concat("g", F.lit("\x01"), "h"))
    both = lookup(mine, counts.select("_gh", "_own"), "_gh", heavy_keys(counts, "_gh", "_own"), "inner")
    return both.select("field_name", "key", F.col("s").alias("class_id"), F.col("h").alias("spelling_id"), (F.col("n") - F.col("_own")).alias("n_links"))


def look_alike_pairs(rows: DataFrame) -> DataFrame:
    """field_name, key_a, key_b: keys whose texts have one form but are different strings.

    rows: field_name, key, h, s of :func:`marked`. Equal texts are no pair, so a group of copies gives none. Groups with
    different texts are joined within; groups of ``HOT_GROUP_ROWS`` and more are divided by salt on one side.
    """
    rows = _with_group(rows)
    mine = _among_groups(rows, _groups(rows)).select("g", "field_name", "key", "h", "n")
    salted = F.when(F.col("n") >= HOT_GROUP_ROWS, F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(F.lit(0))
    every = F.when(F.col("n") >= HOT_GROUP_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = mine.select("g", "field_name", F.col("key").alias("key_a"), F.col("h").alias("h_a"), salted.cast("int").alias("_salt"))
    b = mine.select("g", F.col("key").alias("key_b"), F.col("h").alias("h_b"), F.explode(every).alias("_salt"))
    return a.join(b, ["g", "_salt"]).filter((F.col("key_a") < F.col("key_b")) & (F.col("h_a") != F.col("h_b"))).select("field_name", "key_a", "key_b").distinct()


def library_texts(versions: DataFrame, pages: DataFrame) -> DataFrame:
    """field_name, key, h, s of titles, aliases and page texts."""
    v = versions.filter(F.col("version_id").isNotNull())
    title = v.select(F.lit("title").alias("field_name"), F.col("version_id").alias("key"), F.col("metadata.title").alias("text")).distinct()
    alias = v.select(F.lit("alias").alias("field_name"), F.col("version_id").alias("key"), F.explode("metadata.aliases").alias("text")).distinct()
    page = pages.select(F.lit("page_text").alias("field_name"), F.concat("version_id", F.lit("#"), F.col("number").cast("string")).alias("key"), "text")
    return marked(title.unionByName(alias).unionByName(page).filter(F.col("key").isNotNull()), ["field_name", "key"], "text")


def token_report(pages: DataFrame) -> DataFrame:
    """state, n_tokens: tokens of the page texts with letters of other scripts, by state; whole texts, all pages."""

    def count(c: dict[str, list]) -> dict[str, list]:
        states: dict[str, int] = {}
        for t in c["text"]:
            for m in _TOKEN.finditer(_INVISIBLE.sub("", t)):
                if _OTHER_LETTERS.search(m.group()):
                    k = token_state(m.group())
                    states[k] = states.get(k, 0) + 1
        return {"state": list(states), "n": list(states.values())}

    some = pages.select("text").filter(F.col("text").rlike(r"[\p{IsGreek}\p{IsCyrillic}\p{IsArmenian}]"))
    return map_batches(some, count, "state string, n long").groupBy("state").agg(F.sum("n").alias("n_tokens"))
