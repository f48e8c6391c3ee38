"""Held-out passages inside training texts (problem 9).

Method: a broadcast hash set of the normalised n-grams of the test items; token windows of every training text are looked
up in it, each hit is verified against the item, and documents are reported or their spans removed.

A text leaks an item if it holds ``WORDS`` consecutive words of it (for Chinese ``CHARS`` consecutive characters), of which
at most one in twelve differs: is replaced, left out, or has another put in before it. Any such passage has a part shorter than
twice that length that also is one, with a run of at least ``GRAM`` words (``CHAR_GRAM`` characters) without difference; so
n-grams of that length miss nothing, and it suffices to verify the window lengths of ``WINDOWS``. Replaced words are counted along
the diagonal of a hit for all hits at once; where that does not decide, the farthest reach with each number of differences
is taken to both sides of the hit, whatever kind they are and wherever they stand.

Letter case, punctuation, spacing, line breaks and character forms do not matter. Null and blank texts leak nothing; texts
are scanned whole; repeated rows repeat their result. Items shorter than a window can't be leaked by this rule.

Items are broadcast if they have at most ``BROADCAST_CHARS`` characters. Beyond that nothing is broadcast: the n-grams of items and
texts are joined by a salted shuffle, and only the pairs that share one are verified.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from shelfmark.llm.arrow import map_batches, map_batches_from
from shelfmark.llm.forms import one_form

WORDS, CHARS = 24, 40
GRAM, CHAR_GRAM = 8, 9
#: (window, differences allowed) that decide; see the module's text.
WINDOWS = ((24, 2), (36, 3))
CHAR_WINDOWS = ((40, 3), (48, 4), (60, 5), (72, 6))
#: Characters of the items that are broadcast at most.
BROADCAST_CHARS = 8_000_000
#: Parts that a gram or item of many texts is divided into in shuffle joins.
SALTS = 16
#: Token between texts.
BORDER = -3

_WORD = re.compile(r"[^\W_]+")
#: What stands between white space; no word reaches beyond it.
_CHUNK = re.compile(r"\S+")
_HAN = regex.compile(r"\p{Script=Han}")


def words_of(text: str) -> list[str]:
    return _WORD.findall(one_form(text).casefold())


def chars_of(text: str) -> str:
    return "".join(_WORD.findall(one_form(text).casefold()))


class Grams:
    """The n-grams of one set of token sequences, sorted by hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]], n: int, windows: tuple) -> None:
        self.n, self.windows = n, windows
        self.most = windows[-1][1]
        self.ids = [i for i, _ in items]
        starts = np.cumsum([0] + [len(a) + 1 for _, a in items])
        self.starts = starts
        self.tokens = np.full(starts[-1], -2, np.int64)
        self.item = np.full(starts[-1], -1, np.int64)
        for k, (_, a) in enumerate(items):
            self.tokens[starts[k] : starts[k] + len(a)] = a
            self.item[starts[k] : starts[k] + len(a)] = k
        h, ok = self.hashes(self.tokens)
        at = np.flatnonzero(ok)
        order = at[np.argsort(h[at], kind="stable")]
        self.sorted_hash, self.place = h[order], order

    def hashes(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n-gram starting at each place, and whether all of its tokens are known."""
        m = len(tokens) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        known = np.concatenate([[0], np.cumsum(tokens >= 0)])
        ok = known[self.n :] - known[: -self.n] == self.n
        h = np.zeros(m, np.uint64)
        u = tokens.astype(np.uint64)
        for k in range(self.n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + u[k : k + m] + np.uint64(1)
            h ^= h >> np.uint64(29)
        return h, ok

    def runs(self, tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of equal tokens of at least n begin: places in the texts, and in the items."""
        h, ok = self.hashes(tokens)
        at = np.flatnonzero(ok)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(at) or not len(self.sorted_hash):
            return none
        low = np.searchsorted(self.sorted_hash, h[at], "left")
        high = np.searchsorted(self.sorted_hash, h[at], "right")
        some = high > low
        at, low, n = at[some], low[some], (high - low)[some]
        p = np.repeat(at, n)
        k = self.place[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        if not len(p):
            return none
        # One place a run: the first of hits that follow each other on one diagonal.
        order = np.lexsort((p, k - p))
        p, k = p[order], k[order]
        first = np.ones(len(p), bool)
        first[1:] = ~((np.diff(p) == 1) & (np.diff(k) == 1))
        return p[first], k[first]

    def leaks(self, tokens: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """(doc, item) pairs; tokens of all documents one after another with ``BORDER`` between, doc their number."""
        p, k = self.runs(tokens, doc)
        found: set[tuple[int, int]] = set()
        for s in range(0, len(p), 20_000):
            own_p, own_k = p[s : s + 20_000], k[s : s + 20_000]
            good, possible = self._along_diagonals(tokens, doc, own_p, own_k)
            pairs = list(zip(doc[own_p].tolist(), self.item[own_k].tolist(), strict=True))
            found.update(x for x, g in zip(pairs, good, strict=True) if g)
            for i in np.flatnonzero(possible).tolist():
                if (pair := pairs[i]) not in found and self._reaches(tokens, int(own_p[i]), int(own_k[i])):
                    found.add(pair)
        return found

    def _along_diagonals(self, tokens: np.ndarray, doc: np.ndarray, p: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a window around each hit differs in few enough places, and whether one could with tokens left out or put in.

        It could if enough of its tokens have an equal one on the diagonals that so many differences reach.
        """
        reach = self.windows[-1][0]
        span = np.arange(-reach, reach + self.n)
        a = k[:, None] + span
        own = (a >= 0) & (a < len(self.tokens))
        a = np.where(own, a, 0)
        own &= self.item[a] == self.item[k][:, None]
        x = np.where(own, self.tokens[a], -9)

        def equal(rows: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
            b = p[rows, None] + span + shift
            inside = (b >= 0) & (b < len(tokens))
            b = np.where(inside, b, 0)
            inside &= (doc[b] == doc[p[rows]][:, None]) & (tokens[b] != BORDER)
            return inside & own[rows], inside & (x[rows] == tokens[b])

        def windows(e: np.ndarray) -> np.ndarray:
            e = np.concatenate([np.zeros((len(e), 1), np.int32), np.cumsum(e, 1, dtype=np.int32)], 1)
            good = np.zeros(len(e), bool)
            for w, most in self.windows:
                good |= (e[:, w:] - e[:, :-w] <= most).any(1)
            return good

        inside, same = equal(np.arange(len(p)), 0)
        good = windows(np.where(inside, ~same, 1000))
        rest = np.flatnonzero(~good)
        near = same[rest]
        for shift in range(1, self.most + 1):
            near |= equal(rest, shift)[1] | equal(rest, -shift)[1]
        possible = np.zeros(len(p), bool)
        possible[rest] = windows(np.where(own[rest], ~near, 1000)) if len(rest) else False
        return good, possible

    def _sides(self, tokens: np.ndarray, p: int, k: int, length: int) -> tuple[list[int], list[int], list[int], list[int]]:
        """Item and text to the right from a hit, and to the left of it (reversed), each up to length and within its item or text."""
        first, last = self.starts[self.item[k]], self.starts[self.item[k] + 1] - 1
        right, left = tokens[p : p + length].tolist(), tokens[max(0, p - length) : p][::-1].tolist()
        cut = lambda y: y[: y.index(BORDER)] if BORDER in y else y
        return self.tokens[k : min(last, k + length)].tolist(), cut(right), self.tokens[max(first, k - length) : k][::-1].tolist(), cut(left)

    def _reaches(self, tokens: np.ndarray, p: int, k: int) -> bool:
        x, y, u, v = self._sides(tokens, p, k, self.windows[-1][0] + self.most)
        right, left = reach(x, y, self.most), reach(u, v, self.most)
        return any(left[i] + right[most - i] >= w for w, most in self.windows for i in range(most + 1))

    def spans(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """(first, last + 1) token of the widest leaked passage around each run, in one text."""
        out = []
        for p, k in zip(*(x.tolist() for x in self.runs(tokens, np.zeros(len(tokens), np.int64))), strict=True):
            if out and out[-1][0] <= p < out[-1][1]:
                continue  # within a passage already
            n = int(self.starts[self.item[k] + 1] - 1 - self.starts[self.item[k]])
            most = n // 12
            x, y, u, v = self._sides(tokens, p, k, n + most)
            right, left = reach_places(x, y, most, True), reach_places(u, v, most, True)
            best = max(((a[0] + b[0], b[1], a[1]) for i, b in enumerate(left) for j, a in enumerate(right) if 12 * (i + j) <= a[0] + b[0]), default=(0, 0, 0))
            if best[0] >= self.windows[0][0]:
                out.append((p - best[1], p + best[2]))
        return out


def reach_places(x: list[int], y: list[int], most: int, matched: bool = False) -> list[tuple[int, int]]:
    """(tokens of x, tokens of y) that the farthest alignment from their starts covers, with 0 .. most differences.

    A difference is a token replaced, one of x left out, or one of y put in. matched: the alignment must end with equal tokens.
    """
    best: list[tuple[int, int]] = []
    front = {0: 0}  # diagonal (place in y less place in x) to the farthest place in x
    for e in range(most + 1):
        if e:
            new = dict(front)
            for d, i in front.items():
                for dd, ii in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                    if ii <= len(x) and 0 <= ii + dd <= len(y) and new.get(dd, -1) < ii:
                        new[dd] = ii
            front = new
        ends = []
        for d, i in front.items():
            before = i
            while i < len(x) and i + d < len(y) and x[i] == y[i + d]:
                i += 1
            front[d] = i
            if i > before or not matched:
                ends.append((i, -abs(d), d))
        i, _, d = max(ends, default=(0, 0, 0))
        best.append(max((i, i + d), best[-1] if best else (0, 0)) if matched else (i, i + d))
    return best


def reach(x: list[int], y: list[int], most: int) -> list[int]:
    """Tokens of x that are covered from its start with 0 .. most differences."""
    return [i for i, _ in reach_places(x, y, most)]


class Matcher:
    """Finds the items that texts leak; built once a task from the broadcast items."""

    def __init__(self, items: list[tuple[int, str | None, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        words, chars = [], []
        for item, lang, text in items:
            if lang is not None and lang.casefold().startswith("zh") or lang is None and _HAN.search(text):
                chars.append((item, np.frombuffer(chars_of(text).encode("utf-32-le"), np.uint32).astype(np.int64)))
            else:
                words.append((item, np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int64)))
        self.words = Grams(words, GRAM, WINDOWS) if words else None
        self.chars = Grams(chars, CHAR_GRAM, CHAR_WINDOWS) if chars else None

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(place of the text, item) of each leak, sorted."""
        get = self.vocabulary.get
        found: set[tuple[int, int]] = set()
        word_ids, word_doc, char_ids, char_doc = [], [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            form = t.casefold() if t.isascii() else one_form(t).casefold()
            tokens = _WORD.findall(form)
            if self.words:
                word_ids += [get(w, -1) for w in tokens]
                word_ids.append(BORDER)
                word_doc.append((i, len(tokens) + 1))
            if self.chars and not form.isascii() and _HAN.search(form):
                a = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                char_ids += [a, np.array([BORDER])]
                char_doc.append((i, len(a) + 1))
        for grams, ids, docs in ((self.words, np.array(word_ids, np.int64), word_doc), (self.chars, np.concatenate(char_ids) if char_ids else np.zeros(0, np.int64), char_doc)):
            if grams and len(ids):
                doc = np.repeat([i for i, _ in docs], [n for _, n in docs])
                found |= {(d, grams.ids[k]) for d, k in grams.leaks(ids, doc)}
        return sorted(found)


    def spans(self, text: str) -> list[tuple[int, int]]:
        """Places of the text from and to which passages of the items stand, joined where they overlap."""
        chunks = [(m.start(), m.end()) for m in _CHUNK.finditer(text)]
        out: list[tuple[int, int]] = []
        for grams, split in ((self.words, words_of), (self.chars, lambda t: list(chars_of(t)))):
            if not grams:
                continue
            ids, own = [], []
            for n, (s, e) in enumerate(chunks):
                for pieces in ([(s, e)],) if split is words_of else ([(i, i + 1) for i in range(s, e)],):
                    for i, j in pieces:
                        tokens = split(text[i:j])
                        ids += [self.vocabulary.get(t, -1) if split is words_of else ord(t) for t in tokens]
                        own += [(i, j)] * len(tokens)
            out += [(own[a][0], own[b - 1][1]) for a, b in grams.spans(np.array([*ids, BORDER], np.int64))]
        merged: list[tuple[int, int]] = []
        for s, e in sorted(out):
            if merged and s <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(e, merged[-1][1])
            else:
                merged.append((s, e))
        return merged


def _usable(items: DataFrame) -> DataFrame:
    return items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "lang", "text")


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of each document that leaks an item."""
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    key = documents.schema["doc_id"].dataType.simpleString()
    own = _usable(items)
    if (own.agg(F.sum(F.length("text"))).first()[0] or 0) > BROADCAST_CHARS:
        return _leaks_by_shuffle(texts, own, key)
    shared = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])

    def make():
        matcher = Matcher(shared.value)

        def run(c: dict[str, list]) -> dict[str, list]:
            hits = matcher.leaks(c["text"])
            return {"doc_id": [c["doc_id"][i] for i, _ in hits], "item_id": [k for _, k in hits]}

        return run

    return map_batches_from(texts, make, f"doc_id {key}, item_id long").distinct()


def text_grams(text: str) -> set[int]:
    """Hashes of a text's n-grams of words, and of characters where it has ideographs; the same in every process."""
    words, out = words_of(text), set()
    both = [(GRAM, " ", words)]
    if _HAN.search(text):
        both.append((CHAR_GRAM, "", list("".join(words))))
    for n, glue, tokens in both:
        out |= {xxh3_64_intdigest(glue.join(tokens[i : i + n]).encode("utf-8", "surrogatepass")) - (1 << 63) for i in range(len(tokens) - n + 1)}
    return out


def _grams(df: DataFrame, key: str, kind: str) -> DataFrame:
    def run(c: dict[str, list]) -> dict[str, list]:
        found = [(k, g) for k, t in zip(c[key], c["text"], strict=True) for g in text_grams(t)]
        return {key: [k for k, _ in found], "gram": [g for _, g in found]}

    return map_batches(df.select(key, "text"), run, f"{key} {kind}, gram long")


def _salted(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Join on key, each key's rows of left divided by the other column; right is repeated ``SALTS`` times."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return a.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"]).drop("_salt")


def _leaks_by_shuffle(texts: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The same without a broadcast of the items."""
    pairs = _salted(_grams(texts, "doc_id", key), _grams(items, "item_id", "long").distinct(), "gram", "doc_id").select("doc_id", "item_id").distinct()
    named = _salted(pairs, items.select("item_id", "lang", F.col("text").alias("item")), "item_id", "doc_id")

    def run(c: dict[str, list]) -> dict[str, list]:
        matchers: dict[tuple, Matcher] = {}
        keep = []
        for i, item in enumerate(zip(c["item_id"], c["lang"], c["item"], strict=True)):
            if item not in matchers:
                if len(matchers) >= 1000:
                    matchers.clear()
                matchers[item] = Matcher([item])
            if matchers[item].leaks([c["text"][i]]):
                keep.append(i)
        return {n: [c[n][i] for i in keep] for n in ("doc_id", "item_id")}

    return map_batches(named.join(texts, "doc_id"), run, f"doc_id {key}, item_id long").distinct()


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item."""
    return documents.join(find_leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")


def without_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text, n_spans of each document that leaks an item, its text without the leaked passages.

    A passage is the widest one around a run with at most one difference in twelve; it is taken out from the first to the last
    of its words, with what stands between them.
    """
    pairs = find_leaks(documents, items)
    key = documents.schema["doc_id"].dataType.simpleString()
    own = _salted(pairs, _usable(items), "item_id", "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "lang", "text"))).alias("items"))

    def run(c: dict[str, list]) -> dict[str, list]:
        texts, counts = [], []
        for t, some in zip(c["text"], c["items"], strict=True):
            spans = Matcher([(x["item_id"], x["lang"], x["text"]) for x in some]).spans(t)
            at = [0, *[x for s in spans for x in s], len(t)]
            texts.append("".join(t[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
            counts.append(len(spans))
        return {"doc_id": c["doc_id"], "text": texts, "n_spans": counts}

    rows = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).distinct().join(own, "doc_id")
    return map_batches(rows, run, f"doc_id {key}, text string, n_spans int")
