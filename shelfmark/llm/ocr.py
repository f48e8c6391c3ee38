"""Noise in text from scanned pages repaired into readable paragraphs (problem 5).

Method: an averaged-perceptron character editor predicts keep, replace, delete, insert and line-join operations; page-position
features decide what is furniture (running headers, page numbers).

* The vocabulary of ordinary words is counted over all pages without hard line breaks. A word is ordinary from a share
  ``ORDINARY_SHARE`` of all words on, so there are at most ``1 / ORDINARY_SHARE`` of them, whatever the corpus.
* The editor is trained on misread words of a bounded sample (``TRAINING_PAGES`` scanned pages), each paired with the only
  ordinary word that one small edit gives. At each place of an unknown word keep competes with the operations that apply there: an
  operation is out if it leads keep by less than any misreading of the sample did. Those left are tried best first and count if they
  give an ordinary word; if none does, pairs of operations that the editor prefers to keep are tried.
* Words under three characters and Chinese characters are not repaired.
* A version's pages are read in order in blocks of ``BLOCK_PAGES`` with the neighbouring pages as context, so that even a
  version with a third of all pages spreads over many tasks. What recurs exactly at the edges of its pages is counted over
  the whole version before.

Defined results: pages without text have no lines; pages delivered twice count once; a version with one page has no
recurring line. Versions count as scanned by the recognition language of their extraction record, also in damaged records; if
the record is cut off before that, by hard line breaks of their pages.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from shelfmark.llm.arrow import map_batches
from shelfmark.llm.perceptron import AveragedPerceptron, feature_ids
from shelfmark.llm.sample import bounded_sample
from shelfmark.session import written

ORDINARY_SHARE = 2e-5
#: An ordinary word occurs at least so often.
ORDINARY_LEAST = 4
#: Pages of the sample at most, in runs of up to ``TRAINING_RUN`` pages of a version that are chosen by their hash.
TRAINING_PAGES = 6000
TRAINING_RUN = 20
TRAINING_EPOCHS = 8
BLOCK_PAGES = 64
#: Pages on each side of a block that are read as its context: two left and two right ones.
CONTEXT_PAGES = 4
#: Different words of the sample in which a misreading is seen at least to become one of the editor's operations.
LEAST_SEEN = 3
#: Two different words are enough if they are seen so often.
SEEN_OFTEN = 6
#: The same for characters put in or left out, which are easily taken for another word's form.
LEAST_SEEN_LENGTH = 5
#: Share of a version's pages on which bare page numbers of one shape stand at least, if they can't be read.
RECURS = 0.4
# Marks at a break inside a word.
MARKS = "-¬­‐"
# The words of printed page numbers.
PAGE_WORDS = ("page", "seite", "página", "pagina", "pág", "p", "s", "第", "頁", "页")
PAGE_OF = ("of", "von", "de", "sur", "/", "共")

_WORDS = re.compile(r"[a-zß-öø-ÿœ]+(?:[-'’][a-zß-öø-ÿœ]+)*")
_STRIP = ".,;:()[]{}\"“”„«»?…、。，；：（）"
_PAREN = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_HAN = re.compile(r"[㐀-鿿]")
_TAIL = re.compile(rf"([^\W\d_][^\s()\[\]]*|[^\W_][^\s()\[\]]*)[{MARKS}]$")
_HEAD = re.compile(r"^[^\s()\[\],.;:!?]*(?:![^\s()\[\],.;:!?]+)*")


def scanned_versions(extractions: DataFrame) -> DataFrame:
    """version_id, certain: versions with a recognition language, or (not certain) with nothing but records cut off before it."""
    raw = extractions.filter(F.col("version_id").isNotNull()).select(
        "version_id",
        F.col("payload").rlike(r'ocr_language\\*"\s*:\s*\\*"[^"\\]').alias("scanned"),
        (F.col("payload").contains("ocr_language") | F.expr("try_parse_json(regexp_replace(payload, '^[\\\\s\\\\x{FEFF}]+', ''))").isNotNull()).alias("readable"),
    )
    marks = raw.groupBy("version_id").agg(F.max("scanned").alias("scanned"), F.max("readable").alias("readable"))
    return marks.filter(F.col("scanned") | ~F.col("readable")).select("version_id", F.col("scanned").alias("certain"))


_HARD_BREAK = r"[^\n]\n[^\n]"


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n over all pages without hard line breaks."""

    def count(c: dict[str, list]) -> dict[str, list]:
        n: Counter[str] = Counter()
        for t in c["text"]:
            n.update(_WORDS.findall(t.casefold()))
        return {"word": list(n), "n": list(n.values())}

    clean = pages.select("text").filter(F.col("text").isNotNull() & ~F.col("text").rlike(_HARD_BREAK))
    return map_batches(clean, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ordinary_words(pages: DataFrame) -> dict[str, int]:
    """Word to count of the ordinary words; their number is bounded by their share."""
    counts = written(word_counts(pages), "word-counts")
    with_total = counts.groupBy().agg(F.sum("n").alias("total")).first().total or 0
    return {r.word: r.n for r in counts.filter(F.col("n") >= max(ORDINARY_LEAST, with_total * ORDINARY_SHARE)).collect()}


def one_edit(word: str, other: str) -> tuple[int, str, str] | None:
    """(place, part of word, part of other) where two words differ in one place by at most two characters."""
    p = 0
    while p < min(len(word), len(other)) and word[p] == other[p]:
        p += 1
    s = 0
    while s < min(len(word), len(other)) - p and word[-1 - s] == other[-1 - s]:
        s += 1
    a, b = word[p : len(word) - s], other[p : len(other) - s]
    return (p, a, b) if len(a) <= 2 and len(b) <= 2 else None


class EditIndex:
    """Ordinary words by what is left when up to two neighbouring characters are taken out; labels the training words."""

    def __init__(self, words: dict[str, int]) -> None:
        self.index: dict[tuple[str, str], list[str]] = defaultdict(list)
        for w in words:
            if len(w) >= 3:
                for r in (0, 1, 2):
                    for i in range(len(w) - r + 1):
                        self.index[w[:i], w[i + r :]].append(w)

    def near(self, word: str) -> set[str]:
        return {w for r in (0, 1, 2) for i in range(len(word) - r + 1) for w in self.index.get((word[:i], word[i + r :]), ())}


def operation(a: str, b: str) -> str | None:
    """Name of the edit that turns part a of a misread word into part b, applied at its first character.

    One character may stand for one or two, and two for one; two for two is no misreading but another word.
    """
    if len(a) == 1 and b:
        return f"replace:{a}>{b}"
    if len(a) == 1:
        return f"delete:{a}>"
    if len(a) == 2 and len(b) == 1:
        return f"merge:{a}>{b}"
    if not a and len(b) == 1:
        return f"insert:>{b}"
    return None


def apply_operation(word: str, i: int, op: str) -> str:
    """The word after the operation; unchanged where it does not apply."""
    a, _, b = op.partition(":")[2].partition(">")
    return word[:i] + b + word[i + len(a) :] if word.startswith(a, i) else word


def character_features(word: str) -> list[list[int]]:
    """Feature ids of each character of a word, and of its end (for insertions there)."""
    w = f"^^{word}$$$"
    out = []
    for i in range(2, len(word) + 3):
        a, b, c, d, e = w[i - 2], w[i - 1], w[i], w[i + 1], w[i + 2] if i + 2 < len(w) else "$"
        out.append(feature_ids([f"0{c}", f"1{b}{c}", f"2{c}{d}", f"3{b}{c}{d}", f"4{a}{b}{c}", f"5{c}{d}{e}", f"6{b}{d}", f"7{a}{b}{d}{e}", f"8{a}{b}{c}{d}", f"9{b}{c}{d}{e}"]))
    return out


def training_pairs(pages: list[str], words: dict[str, int]) -> list[tuple[str, str, int]]:
    """(misread, ordinary, times seen) for words of the sample to which exactly one ordinary word is near."""
    index, seen = EditIndex(words), Counter()
    for text in pages:
        broken = False
        for line in text.split("\n"):
            tokens = _PAREN.sub(" ", line).split()[broken:]  # what continues a broken word is no word
            broken = line.rstrip()[-1:] in tuple(MARKS)
            if line.isupper():
                continue  # a heading
            for token in tokens:
                t = token.strip(_STRIP).casefold()
                if len(t) >= 4 and t not in words and t[-1] not in MARKS and not t.isdigit():
                    seen[t] += 1
    near = {t: sorted(index.near(t)) for t in seen}
    pairs = [(t, n[0], seen[t]) for t, n in near.items() if len(n) == 1]
    # Words with several ordinary words near take the one whose edit, in whole, is most usual among the others.
    usual = Counter(e[1:] for w, o, _ in pairs if (e := one_edit(w, o)))
    for t, n in near.items():
        if len(n) > 1:
            ranked = sorted(((usual[e[1:]], o) for o in n if (e := one_edit(t, o))), reverse=True)
            if ranked and ranked[0][0] >= LEAST_SEEN:
                pairs.append((t, ranked[0][1], seen[t]))
    return pairs


def train_editor(pairs: list[tuple[str, str, int]], words: dict[str, int]) -> AveragedPerceptron:
    """The editor from labelled pairs and from ordinary words, which are all kept."""
    edits = [(w, e) for w, o, _ in pairs if (e := one_edit(w, o)) and operation(e[1], e[2])]
    kinds, times = Counter(), Counter()
    for w, o, n in pairs:
        if (e := one_edit(w, o)) and (op := operation(e[1], e[2])):
            kinds[op] += 1
            times[op] += n

    def usual(op: str) -> bool:
        if op.startswith(("insert", "delete")):
            return kinds[op] >= LEAST_SEEN_LENGTH
        return kinds[op] >= LEAST_SEEN or kinds[op] == 2 and times[op] >= SEEN_OFTEN

    classes = ["keep", *sorted(filter(usual, kinds))]
    at = {c: i for i, c in enumerate(classes)}
    examples = []
    for w, (i, a, b) in edits:
        y = at.get(operation(a, b))
        if y is None:
            continue
        for k, ids in enumerate(character_features(w)):
            if k == i:
                examples.append((ids, y))
            elif abs(k - i) > len(a):
                examples.append((ids, 0))
    for w in words:
        examples += [(ids, 0) for ids in character_features(w)]
    model = AveragedPerceptron(classes).train(examples, TRAINING_EPOCHS)
    leads = [model.scores(np.array([character_features(w)[i]]))[0] for w, (i, a, b) in edits if operation(a, b) in at]
    model.floor = min((float(x[at[operation(a, b)]] - x[0]) for x, (a, b) in zip(leads, [(a, b) for _, (_, a, b) in edits if operation(a, b) in at], strict=True)), default=0.0)
    return model


class Editor:
    """Corrects words by the perceptron's predictions; results are kept by word."""

    def __init__(self, model: AveragedPerceptron, words: dict[str, int]) -> None:
        self.model, self.words = model, words
        self.known: dict[str, tuple[str, int] | None] = {}
        #: Classes by what they replace; those that put something in apply at every place.
        self.one: dict[str, list[int]] = defaultdict(list)
        self.two: dict[str, list[int]] = defaultdict(list)
        self.put_in: list[int] = []
        for c, name in enumerate(model.classes):
            if c:
                a = name.partition(":")[2].partition(">")[0]
                (self.put_in if not a else self.one[a] if len(a) == 1 else self.two[a]).append(c)

    def learn(self, tokens: set[str]) -> None:
        """Decide many words at once."""
        todo = [t for t in tokens if t not in self.known and len(t) >= 3]
        for t in tokens:
            self.known.setdefault(t, None)
        for s in range(0, len(todo), 2000):
            part = todo[s : s + 2000]
            features = [character_features(t) for t in part]
            scores = self.model.scores(np.array([f for own in features for f in own]))
            gain = scores - scores[:, :1]
            at = 0
            for t, own in zip(part, features, strict=True):
                self.known[t] = self._first(t, self._moves(t, gain[at : at + len(own)]))
                at += len(own)

    def _moves(self, word: str, gain: np.ndarray) -> list[tuple[float, int, str]]:
        """(lead over keep, place, operation) of all operations that apply somewhere in the word and that keep does not beat, best first."""
        where, what = [], []
        for i in range(len(word) + 1):
            own = [*self.one.get(word[i : i + 1], ()), *self.two.get(word[i : i + 2], ()), *self.put_in]
            where += [i] * len(own)
            what += own
        if not where:
            return []
        leads = gain[where, what]
        order = [k for k in np.argsort(-leads, kind="stable").tolist() if leads[k] >= self.model.floor]
        return [(float(leads[k]), where[k], self.model.classes[what[k]]) for k in order]

    def _first(self, word: str, moves: list[tuple[float, int, str]]) -> tuple[str, int] | None:
        for _, i, op in moves:
            if (w := apply_operation(word, i, op)) in self.words and w != word:
                return w, i
        if len(word) < 6:
            return None
        sure = [(i, op) for lead, i, op in moves if lead > 0]
        for n, (i, op) in enumerate(sure):
            for j, op2 in sure[n + 1 :]:
                if abs(i - j) >= 2:
                    (x, ox), (y, oy) = sorted([(i, op), (j, op2)], reverse=True)
                    if (w := apply_operation(apply_operation(word, x, ox), y, oy)) in self.words:
                        return w, y
        return None

    def fixed(self, word: str) -> tuple[str, int] | None:
        """(ordinary word, place of the first misread character) or null."""
        if word not in self.known:
            self.learn({word})
        return self.known[word]


# --- furniture -------------------------------------------------------------------------------------------------------

_DIGIT_LOOKS = str.maketrans("lIi!|OoSsBZzgq", "11111005582299")
_NUMBERISH = re.compile(r"^[0-9lIi!|OoSsBZzgq]{1,5}$")
_ROMAN = re.compile(r"^[ivxlcIVXLC1!|]{1,8}$")
_EDGE_NUMBER = re.compile(r"^(?:[0-9lIi!|OoSsBZzgq]{1,5}\s{2,})|(?:\s{2,}[0-9lIi!|OoSsBZzgq]{1,5})$")


def _is_page_word(t: str) -> bool:
    t = t.casefold().rstrip(".")
    return t in PAGE_WORDS or len(t) >= 4 and any(len(w) >= 4 and abs(len(w) - len(t)) <= 1 and (e := one_edit(t, w)) is not None and len(e[1]) <= 1 + (len(t) > len(w)) and len(e[2]) <= 2 for w in PAGE_WORDS)


def page_number(line: str) -> tuple[str, int | None] | None:
    """(shape, number) of a line that holds only a printed page number; number is null where it can't be read."""
    s = line.strip()
    if not s or len(s) > 24:
        return None
    bare = s.strip("-–—[](){}·•|~* ")
    decorated = bare != s
    if m := re.match(r"^第\s*(\S{1,5})\s*(?:[頁页]|/\s*(\S{1,5}))(?:.{0,3}共\s*\S{1,5}\s*[頁页])?$", bare):
        return ("word", _arabic(m.group(1)))
    t = bare.replace("/", " / ").split()
    if not t:
        return None
    if len(t) >= 2 and _is_page_word(t[0]) and len(t[0]) > 1 | (not t[0].endswith(".")):
        return ("word", _arabic(t[1])) if _NUMBERISH.match(t[1]) or _ROMAN.match(t[1]) and len(t) == 2 else None
    if len(t) == 3 and t[1].casefold() in PAGE_OF and _NUMBERISH.match(t[0]) and _NUMBERISH.match(t[2]):
        return ("total", _arabic(t[0]))
    if len(t) == 1 and _NUMBERISH.match(t[0]) and any(ch.isdigit() for ch in t[0]):
        return ("decorated" if decorated else "plain", _arabic(t[0]))
    if len(t) == 1 and _ROMAN.match(t[0]) and not decorated | t[0].isupper():
        return ("roman", _roman(t[0]))
    if len(t) == 1 and decorated and _NUMBERISH.match(t[0]):
        return ("decorated", _arabic(t[0]))
    return None


def _arabic(t: str) -> int | None:
    d = t.translate(_DIGIT_LOOKS)
    return int(d) if d.isascii() and d.isdigit() else None


def _roman(t: str) -> int | None:
    t = t.casefold().replace("1", "i").replace("!", "i").replace("|", "i")
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    n = [value[c] for c in t]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0], strict=True))


def running_key(line: str) -> tuple[str, tuple[str, ...]]:
    """The part of a possible running line that recurs, and its numbers as they read with digit look-alikes undone."""
    s = _EDGE_NUMBER.sub("", line.strip()).strip()
    tokens = s.casefold().split()
    numbers = tuple(t.translate(_DIGIT_LOOKS) for t in s.split() if any(c.isdigit() for c in t) and _NUMBERISH.match(t.replace(".", "0").replace(",", "0")))
    return " ".join(tokens), numbers


def edge_lines(lines: list[str]) -> list[tuple[str, list[int]]]:
    """(side, up to three lines from the edge on) of a page; nothing for a blank page."""
    where = [i for i, x in enumerate(lines) if x.strip()]
    return [("top", where[:3]), ("bottom", where[::-1][:3])] if where else []


def line_name(side: str, key: tuple[str, tuple[str, ...]]) -> str:
    return "\n".join([side, key[0], *key[1]])


def step_name(side: str, step: int) -> str:
    return f"{side} {step}"


def edge_keys(number: int, text: str) -> set[str]:
    """What can recur at the edges of a page: possible running lines, and how far page numbers are from the page's place."""
    lines, out = text.split("\n"), set()
    for side, order in edge_lines(lines):
        for rank, i in enumerate(order):
            if p := page_number(lines[i]):
                if p[1] is not None:
                    out.add(step_name(side, p[1] - number))
            elif rank <= 1:
                out.add(line_name(side, running_key(lines[i])))
    return out


def same_running(a: tuple[str, tuple], b: tuple[str, tuple]) -> bool:
    """Two lines are one running line but for misread characters."""
    if a == b:
        return True
    if abs(len(a[0]) - len(b[0])) > 3 or len(a[1]) == len(b[1]) and a[1] != b[1]:
        return False
    x, y = a[0].split(), b[0].split()
    if 2 * sum((Counter(x) & Counter(y)).values()) < min(len(x), len(y)) - 1:
        return False
    return sum(((Counter(a[0]) - Counter(b[0])) + (Counter(b[0]) - Counter(a[0]))).values()) <= 6


#: A short word with a capital and a full stop inside of a line.
_ABBREVIATION = re.compile(r"\b[^\W\d_a-zß-öø-ÿ][a-zß-öø-ÿ]{0,3}\. ")


def _looks_like_heading(line: str) -> bool:
    """Neither the beginning nor the end nor the middle of running text."""
    s = line.strip()
    return not s[:1].islower() and s[-1:] not in MARKS + ".,;:。，；：" and not re.search(r"[.,;] [^\W\d]|[。，；]", _ABBREVIATION.sub("", s))


def position_features(line: str, rank: int, side: str, width: int, words: dict[str, int]) -> list[int]:
    """Features of a line at the edge of a page whose longest line has width characters."""
    s = line.strip()
    t = [x.strip(_STRIP).casefold() for x in s.split()]
    known = sum(x in words for x in t if x.isalpha()) / max(1, sum(x.isalpha() for x in t))
    end = "letter" if s[-1:].isalpha() else "digit" if s[-1:].isdigit() else s[-1:]
    first = "lower" if s[:1].islower() else "upper" if s[:1].isupper() else "digit" if s[:1].isdigit() else "han" if _HAN.match(s) else "other"
    return feature_ids([
        "bias", f"rank{rank}", f"side{side}", f"first{first}", f"end{end}", f"first{first}end{end}", f"known{round(4 * known)}", f"long{min(5, 5 * len(s) // max(1, width))}",
        f"capitals{round(4 * sum(x[:1].isupper() for x in s.split()) / max(1, len(t)))}", f"stop{bool(re.search('[.,;。，；]', s[:-1]))}", f"bracket{bool(re.search(r'[()]', s))}", f"shout{s.isupper()}",
    ])


def join_features(left: str, right: str, mark: str, words: dict[str, int]) -> list[int]:
    """Features of a break between two parts of a word; whether the joined word is known is not among them."""
    return feature_ids([
        "bias", f"mark{mark}", f"left{left in words}", f"right{right in words}", f"both{left in words and right in words}", f"long{min(len(left), 6)}", f"rest{min(len(right), 6)}",
        f"end{left[-2:]}", f"start{right[:2]}", f"seam{left[-1:]}{right[:1]}", f"whole{left}", f"tail{right}",
    ])


def breaks_of(lines: list[str]) -> Iterator[tuple[str, str, str]]:
    """(left part, right part, mark) of the breaks between text lines that follow each other."""
    for a, b in zip(lines, lines[1:], strict=False):
        if m := _TAIL.search(a.rstrip()):
            head = _HEAD.match(b.lstrip()).group().strip(_STRIP).casefold()
            if head[:1].isalpha():
                yield m.group(1).strip(_STRIP).casefold(), head, a.rstrip()[-1]


def train_joins(texts: list[str], words: dict[str, int]) -> AveragedPerceptron | None:
    """Whether a break is joined or its mark belongs to the word; learned from breaks that the ordinary words decide."""
    examples = []
    for text in texts:
        for left, right, mark in breaks_of([x for x in text.split("\n") if x.strip()]):
            joined, own = words.get(left + right, 0), words.get(f"{left}-{right}", 0)
            if joined or own:
                examples.append((join_features(left, right, mark, words), int(joined < own)))
    return AveragedPerceptron(["join", "own"]).train(examples, 4) if {y for _, y in examples} == {0, 1} else None


class Repairer:
    """Finds and repairs the defects of scanned versions."""

    def __init__(self, words: dict[str, int], editor: AveragedPerceptron, furniture: AveragedPerceptron | None, joins: AveragedPerceptron | None = None) -> None:
        self.words, self.editor, self.furniture, self.joins = words, Editor(editor, words), furniture, joins

    def running_lines(self, pages: list[tuple[int, list[str]]], recurring: frozenset[str] | set[str] = frozenset()) -> dict[tuple[int, int], str]:
        """(page, line from 0) to header or page_no; recurring has the edge keys that stand on several pages of the version."""
        edges = {}
        shaped: list[tuple[int, int, str, tuple[str, int | None]]] = []
        candidates: dict[str, list[tuple[int, int, tuple, int]]] = {"top": [], "bottom": []}
        full = 0
        for n, (_, lines) in enumerate(pages):
            sides = edge_lines(lines)
            full += bool(sides)
            for side, order in sides:
                edges[n, side] = order
                for rank, i in enumerate(order):
                    if p := page_number(lines[i]):
                        shaped.append((n, i, side, p))
                    elif rank <= 1:
                        candidates[side].append((n, i, running_key(lines[i]), rank))
        # Page numbers: a decorated shape stands for itself, a bare number must count with another page or stand alone on its page.
        steps = Counter((side, p[1] - pages[n][0]) for n, _, side, p in shaped if p[1] is not None)
        shapes = Counter((side, p[0]) for _, _, side, p in shaped)
        numbers = {}
        for n, i, side, p in shaped:
            counted = p[1] is not None and (steps[side, p[1] - pages[n][0]] >= 2 or step_name(side, p[1] - pages[n][0]) in recurring)
            if p[0] in ("word", "total", "decorated") or counted or full == 1 or shapes[side, p[0]] >= max(2, RECURS * full):
                numbers[n, i] = side
        running: dict[tuple[int, int], str] = {}
        for side, found in candidates.items():
            groups: list[tuple[tuple, list]] = []
            for c in found:
                for key, members in groups:
                    if same_running(key, c[2]):
                        members.append(c)
                        break
                else:
                    groups.append((c[2], [c]))
            for _, members in groups:
                exact = Counter(own for _, own in {(m[0], m[2]) for m in members})  # pages of each
                for own in exact:
                    if exact[own] == 1 and line_name(side, own) in recurring:
                        exact[own] = 2
                if len({m[0] for m in members}) >= 2 or max(exact.values()) >= 2:
                    for n, i, own, rank in members:
                        heading = _looks_like_heading(_EDGE_NUMBER.sub("", pages[n][1][i].strip()))
                        # Running text may recur word by word on two pages; a line that does not look like a heading needs more than that.
                        often = exact[own] >= max(3, RECURS * full) or exact[own] >= 2 and (heading or self.furniture is not None and self._is_furniture(pages[n][1], i, rank, side))
                        if often or heading and self._is_furniture(pages[n][1], i, rank, side):
                            running[n, i] = side
        out = {}
        for (n, _side), order in edges.items():  # furniture is what reaches from the edge without a text line between
            for i in order:
                if (n, i) in running:
                    out[n, i] = "header"
                elif (n, i) in numbers:
                    out[n, i] = "page_no"
                else:
                    break
        return out

    def _is_furniture(self, lines: list[str], i: int, rank: int, side: str) -> bool:
        if self.furniture is None:
            return True
        features = position_features(lines[i], rank, side, max(map(len, lines)), self.words)
        return bool(self.furniture.scores(np.array([features]))[0].argmax())

    def _keeps_mark(self, left: str, right: str, mark: str) -> bool:
        if self.joins is None:
            return left in self.words and right in self.words and min(len(left), len(right)) > 3
        return bool(self.joins.scores(np.array([join_features(left, right, mark, self.words)]))[0].argmax())

    def _tokens(self, line: str, inside: str) -> tuple[list[tuple[int, str]], str]:
        """(place, word) of the line's words outside of brackets, and the bracket open at its end."""
        if inside:
            k = line.find(")" if inside == "(" else "]")
            if k < 0:
                return [], inside
            line = " " * (k + 1) + line[k + 1 :]
        if "(" in line or "[" in line:
            line = _PAREN.sub(lambda m: " " * len(m.group()), line)
            cut = max(line.rfind("("), line.rfind("["))
            inside = line[cut] if cut >= 0 else ""
            if cut >= 0:
                line = line[:cut]
        else:
            inside = ""
        return [(m.start(), m.group()) for m in re.finditer(r"\S+", line)], inside

    def version(self, pages: list[tuple[int, str]], recurring: frozenset[str] | set[str] = frozenset()) -> tuple[list[tuple[int, int, str]], dict[int, str]]:
        """Defects (page number, line from 1, defect) and repaired text by page number, of pages in order."""
        split = [(number, text.split("\n")) for number, text in pages]
        running = self.running_lines(split, recurring)
        defects = [(split[n][0], i + 1, kind) for (n, i), kind in running.items()]
        lines = [(n, i, x) for n, (_, ls) in enumerate(split) for i, x in enumerate(ls) if x.strip() and (n, i) not in running]
        # First all unknown words, so that the editor can decide them together.
        broken: dict[int, tuple[str, str]] = {}
        words: list[list[tuple[int, str]]] = []
        inside = ""
        for k, (_n, _i, x) in enumerate(lines):
            tokens, inside = self._tokens(x, inside)
            words.append(tokens)
            if k + 1 < len(lines) and (m := _TAIL.search(x.rstrip())) and tokens and not inside:
                head = _HEAD.match(lines[k + 1][2].lstrip()).group()
                if head[:1].isalpha() or head[:1].isdigit() or head[:1] == "!":
                    broken[k] = (m.group(1), head)
        plan = []
        unknown: set[str] = set()
        for k in range(len(lines)):
            tokens = words[k]
            first = 1 if k - 1 in broken and tokens and not lines[k][2][: tokens[0][0]].strip() else 0
            last = len(tokens) - 1 if k in broken else len(tokens)
            for place, token in tokens[first:last]:
                t = token.strip(_STRIP).casefold()
                if t and t not in self.words and not t.replace("-", "").isdigit() and not _HAN.search(t):
                    plan.append((k, place, token, t))
                    unknown.add(t)
        joins = {}
        for k, (left, head) in broken.items():
            a, b = left.strip(_STRIP).casefold(), head.strip(_STRIP).casefold()
            joins[k] = (left, head, a, b)
            if a + b not in self.words and f"{a}-{b}" not in self.words:
                unknown |= {a + b, f"{a}-{b}"}
        self.editor.learn(unknown)

        hits: set[tuple[int, str]] = set()
        fixes: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for k, _place, token, t in plan:
            fixed = self.editor.fixed(t) or (self.editor.fixed(t.rstrip("!")) if t.endswith("!") else None)
            if fixed and any(c.isalpha() for c in t):
                if t.endswith("!") and t[:-1] in self.words:
                    continue
                hits.add((k, "char"))
                fixes[k].append((token, _recased(token, t, fixed[0])))
        glued: dict[int, str] = {}
        for k, (left, head, a, b) in joins.items():
            joined, hyphened = a + b, f"{a}-{b}"
            mark = lines[k][2].rstrip()[-1]
            result = None
            if joined in self.words and self.words[joined] >= self.words.get(hyphened, 0):
                own = False
            elif hyphened in self.words:
                own = mark in "-‐"
            else:
                fixed, fixed_own = self.editor.fixed(joined), self.editor.fixed(hyphened)
                own = fixed is None and fixed_own is not None
                result = fixed_own if own else fixed
                if result:
                    at_left = result[1] < len(a) or own and result[1] == len(a)
                    hits.add((k if at_left else k + 1, "char"))
                elif mark in "-‐":  # neither word is known: the join operation decides
                    own = self._keeps_mark(a, b, mark)
            if not own and not (head[:1].isupper() and not left.isupper()):
                hits.add((k, "hyphen"))
            text = result[0] if result else (hyphened if own else joined)
            glued[k] = _recased(left + head, (hyphened if own else joined), text)
        defects += [(split[lines[k][0]][0], lines[k][1] + 1, d) for k, d in hits]
        return defects, self._paragraphs(split, lines, fixes, joins, glued)

    def _paragraphs(self, split: list, lines: list, fixes: dict, joins: dict, glued: dict) -> dict[int, str]:
        out: dict[int, list[str]] = {number: [] for number, _ in split}
        skip = ""
        previous = None
        for k, (n, i, x) in enumerate(lines):
            s = x.strip()
            if skip:
                s, skip = s[len(skip) :], ""
            for token, word in fixes.get(k, ()):
                s = s.replace(token, word, 1)
            if k in joins:
                left, head = joins[k][:2]
                s = s[: len(s) - len(left) - 1] + glued[k]
                skip = head
            own = out[split[n][0]]
            gap = previous is None or previous[0] != n or any(not y.strip() for y in split[n][1][previous[1] + 1 : i])
            if own and gap and previous[0] == n:
                own.append("\n\n" + s)
            elif own:
                own.append(s if _HAN.search(s[:1]) or s[:1] in "，。、；：)" or skip == "" and k - 1 in joins and s[:1] in ".,;:" else " " + s.lstrip())
            else:
                own.append(s.lstrip())
            previous = (n, i)
        return {number: "".join(parts) for number, parts in out.items()}


def _recased(token: str, t: str, word: str) -> str:
    core = token.strip(_STRIP)
    new = word.upper() if core.isupper() and len(core) > 1 else word[:1].upper() + word[1:] if core[:1].isupper() else word
    return token.replace(core, new, 1) if core else word


def train(pages: DataFrame, scanned: DataFrame, words: dict[str, int]) -> tuple[AveragedPerceptron, AveragedPerceptron | None, AveragedPerceptron | None]:
    """The character editor, the furniture model and the join model, from a bounded sample of scanned pages."""
    placed = scanned.withColumn("run", F.floor((F.col("number") - 1) / TRAINING_RUN))
    chosen = bounded_sample(placed.select("version_id", "run").distinct(), ["version_id", "run"], TRAINING_PAGES // 5)
    wanted = scanned.sparkSession.createDataFrame([(r.version_id, r.run) for r in chosen], "version_id string, run long")  # at most a few hundred rows
    picked = placed.join(F.broadcast(wanted), ["version_id", "run"])
    rows = picked.orderBy("version_id", "number").limit(TRAINING_PAGES).collect()
    versions: dict[tuple, list[tuple[int, list[str]]]] = defaultdict(list)
    for r in rows:
        versions[r.version_id, r.run].append((r.number, r.text.split("\n")))
    plain = Repairer(words, AveragedPerceptron(["keep"]), None)
    examples, texts = [], []
    for own in versions.values():
        running = plain.running_lines(own)
        texts += ["\n".join(x for i, x in enumerate(lines) if (n, i) not in running) for n, (_, lines) in enumerate(own)]
        if len(own) < 4:
            continue
        for n, (_, lines) in enumerate(own):
            where = [i for i, x in enumerate(lines) if x.strip()]
            width = max(map(len, lines))
            for side, order in (("top", where), ("bottom", where[::-1])):
                for rank, i in enumerate(order[:2]):
                    if running.get((n, i)) == "header":
                        examples += [(position_features(lines[i], r, x, width, words), 1) for x in ("top", "bottom") for r in (0, 1)]
            for i in where[3:-3]:
                examples.append((position_features(lines[i], i % 2, ("top", "bottom")[i // 2 % 2], width, words), 0))
    editor = train_editor(training_pairs(texts, words), words)
    both = {y for _, y in examples}
    furniture = AveragedPerceptron(["text", "furniture"]).train(examples, 4) if len(both) == 2 else None
    return editor, furniture, train_joins(texts, words)


def scanned_pages(pages: DataFrame, extractions: DataFrame) -> DataFrame:
    """version_id, number, text of the pages of scanned versions."""
    marks = written(scanned_versions(extractions), "scanned-versions")
    # Written, its size is known: Spark broadcasts it below its threshold of bytes and shuffles beyond.
    rows = pages.select("version_id", "number", "text").filter(F.col("text").isNotNull() & F.col("number").isNotNull()).join(marks, "version_id")
    return rows.filter(F.col("certain") | F.col("text").rlike(_HARD_BREAK)).select("version_id", "number", "text")


def _with_recurring(scanned: DataFrame) -> DataFrame:
    """Adds recurring: the edge keys of a page that stand on other pages of its version too; null in versions of one block."""
    long = scanned.filter(F.col("number") > BLOCK_PAGES).select("version_id").distinct()
    if long.isEmpty():
        return scanned.withColumn("recurring", F.lit(None).cast("array<string>"))

    def keys(c: dict[str, list]) -> dict[str, list]:
        rows = [(v, n, k) for v, n, t in zip(c["version_id"], c["number"], c["text"], strict=True) for k in edge_keys(n, t)]
        return {name: [r[i] for r in rows] for i, name in enumerate(("version_id", "number", "name"))}

    own = map_batches(scanned.join(long, "version_id", "left_semi").select("version_id", "number", "text"), keys, "version_id string, number int, name string").distinct()
    several = own.groupBy("version_id", "name").agg(F.count("*").alias("n")).filter("n >= 2").drop("n")
    return scanned.join(own.join(several, ["version_id", "name"]).groupBy("version_id", "number").agg(F.collect_set("name").alias("recurring")), ["version_id", "number"], "left")


def _in_blocks(scanned: DataFrame) -> DataFrame:
    """Adds block, and the pages next to a block as its context."""
    k = F.col("number") - 1
    b = F.floor(k / BLOCK_PAGES)
    at = F.pmod(k, F.lit(BLOCK_PAGES))
    before, after = F.when((at < CONTEXT_PAGES) & (b != 0), b - 1), F.when(at >= BLOCK_PAGES - CONTEXT_PAGES, b + 1)
    return scanned.select(*scanned.columns, F.explode(F.array_compact(F.array(b, before, after))).alias("block"))


def _over_versions(pages: DataFrame, extractions: DataFrame, schema: str, rows_of) -> DataFrame:
    scanned = written(scanned_pages(pages, extractions), "scanned")
    words = ordinary_words(pages)
    models = train(pages, scanned, words)
    shared = pages.sparkSession.sparkContext.broadcast((words, [m.packed() if m else None for m in models]))
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = None
        key, own, recurring = None, [], set()

        def done() -> list[tuple]:
            version, block = key
            first, last = block * BLOCK_PAGES + 1, (block + 1) * BLOCK_PAGES
            return [r for r in rows_of(version, *repairer.version(own, recurring)) if first <= r[1] <= last]

        out: list[tuple] = []
        for batch in batches:
            if repairer is None:
                w, packed = shared.value
                repairer = Repairer(w, *[AveragedPerceptron.unpacked(m) if m else None for m in packed])
            for version, block, number, text, names in zip(*(batch.column(c).to_pylist() for c in ("version_id", "block", "number", "text", "recurring")), strict=True):
                if (version, block) != key:
                    if key:
                        out += done()
                    key, own, recurring = (version, block), [], set()
                if not own or own[-1][0] != number:
                    own.append((number, text))
                    recurring.update(names or ())
            if len(out) > 5000:
                yield _batch(out, arrow)
                out = []
        if key:
            out += done()
        if out:
            yield _batch(out, arrow)

    placed = _in_blocks(_with_recurring(scanned))
    tasks = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks, "version_id", "block").sortWithinPartitions("version_id", "block", "number", "text").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def find_defects(pages: DataFrame, extractions: DataFrame) -> DataFrame:
    """version_id, page_number, line_no, defect."""
    return _over_versions(pages, extractions, "version_id string, page_number long, line_no long, defect string", lambda v, defects, _: [(v, *d) for d in defects]).distinct()


def repaired_pages(pages: DataFrame, extractions: DataFrame) -> DataFrame:
    """version_id, number, text: each scanned page as continuous paragraphs."""
    return _over_versions(pages, extractions, "version_id string, number long, text string", lambda v, _, texts: [(v, n, t) for n, t in texts.items()])
