"""Language of documents and of their paragraphs, with a confidence (problem 4).

Method: nearest-centroid classification. A text is a normalised TF-IDF vector of hashed character trigrams; it is compared by
cosine with several centroids per language, found by clustering; too great a distance rejects it.

The model is fitted on a bounded sample: ``SAMPLE_PARAGRAPHS`` paragraphs, up to ``SAMPLE_CHARACTERS`` of each, of about
``SAMPLE_DOCUMENTS`` labelled documents. Wrong labels in it are trimmed: a paragraph that lies nearer to another language's
centroid is left out and the centroids are formed again. A language of ``SEEDS`` with few labelled paragraphs is fitted on its seed
text too, so a corpus without any label has a model as well.

A paragraph is what blank lines divide. The main language of a text is that of most of its paragraphs; equal numbers are
decided by letters, then by the code's order. Rejected paragraphs (too short, names and numbers only, furniture) have no
language and don't count; if all are rejected, the nearest language of the whole text holds.

Defined results: texts without visible characters have no language and are left out. Labels are compared by language:
spelling, code and region don't matter; a label that names no language is missing. Repeated rows count once; whole texts
are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrow import map_batches, map_batches_from
from shelfmark.llm.forms import one_form
from shelfmark.llm.residue import residue_kind
from shelfmark.llm.sample import bounded_sample, share_of
from shelfmark.operators.skew import heavy_keys, lookup
from shelfmark.session import written

DIMENSIONS = 2048
CENTROIDS = 3
SAMPLE_DOCUMENTS = 3000
SAMPLE_PARAGRAPHS = 15_000
SAMPLE_CHARACTERS = 2000
#: A language with fewer labelled paragraphs in the sample is given its seed text.
FEW_PARAGRAPHS = 20
#: Paragraphs with fewer letters are rejected.
LEAST_LETTERS = 36
#: Least cosine, as a share of what that language's own sample paragraphs reach on average.
REJECT_SHARE = 0.38
#: Least lead over the second language, as a share of the cosine.
LEAST_LEAD = 0.12
#: Paragraphs in one matrix.
CHUNK = 512

# Codes and names of languages, each line: code, then other codes and names.
LANGUAGE_NAMES = """
en eng english anglais englisch inglés inglês 英文 英語
de deu ger german deutsch allemand alemán alemão 德文 德語
fr fra fre french français francais französisch francés francês 法文 法語
es spa spanish español espanol castellano spanisch espagnol espanhol 西班牙文
pt por portuguese português portugues portugiesisch portugais portugués 葡萄牙文
zh zho chi cmn chinese 中文 chinesisch chinois chino chinês 漢語 汉语 國語 繁體中文 简体中文 繁中
it ita italian italiano italienisch italien
nl nld dut dutch nederlands
pl pol polish polski
ja jpn japanese 日本語
ko kor korean 한국어
ru rus russian русский
"""
# Seed texts, each line: code, then a text in that language whose sentences serve as paragraphs.
SEEDS = """
en The people who work here have written down what they do each day, so that others can read it and do the same. When something goes wrong, it should be reported at once to the person who is in charge of the work. There is no reason to wait until the end of the week before the results are sent to those who asked for them. We would have been able to finish earlier if the parts that we ordered had come with the first delivery.
de Die Leute, die hier arbeiten, haben aufgeschrieben, was sie jeden Tag tun, damit andere es lesen und ebenso machen können. Wenn etwas nicht stimmt, soll es sofort der Person gemeldet werden, die für die Arbeit verantwortlich ist. Es gibt keinen Grund, bis zum Ende der Woche zu warten, bevor die Ergebnisse an diejenigen geschickt werden, die danach gefragt haben. Wir hätten früher fertig werden können, wenn die bestellten Teile mit der ersten Lieferung gekommen wären.
fr Les personnes qui travaillent ici ont écrit ce qu'elles font chaque jour, afin que les autres puissent le lire et faire de même. Quand quelque chose ne va pas, il faut le signaler aussitôt à la personne qui est chargée du travail. Il n'y a aucune raison d'attendre la fin de la semaine avant d'envoyer les résultats à ceux qui les ont demandés. Nous aurions pu finir plus tôt si les pièces que nous avions commandées étaient arrivées avec la première livraison.
es Las personas que trabajan aquí han escrito lo que hacen cada día, para que los demás puedan leerlo y hacer lo mismo. Cuando algo no está bien, hay que avisar enseguida a la persona que está encargada del trabajo. No hay ninguna razón para esperar hasta el final de la semana antes de enviar los resultados a quienes los han pedido. Habríamos podido terminar antes si las piezas que pedimos hubieran llegado con la primera entrega.
pt As pessoas que trabalham aqui escreveram o que fazem todos os dias, para que os outros possam ler e fazer o mesmo. Quando alguma coisa não está bem, deve ser comunicada logo à pessoa que está encarregada do trabalho. Não há nenhuma razão para esperar até ao fim da semana antes de enviar os resultados a quem os pediu. Teríamos podido acabar mais cedo se as peças que encomendámos tivessem chegado com a primeira entrega.
zh 在這裡工作的人把每天所做的事情都寫了下來,讓其他人可以閱讀並且照著去做。如果發現有什麼不對的地方,應該馬上告訴負責這項工作的人。沒有理由等到這個星期結束以後,才把結果送給提出要求的人。如果我們訂購的零件和第一批貨物一起送到,我們本來可以更早完成。
"""
_NAMES = {n: line.split()[0] for line in LANGUAGE_NAMES.strip().splitlines() for n in line.split()}

_BLANK_LINES = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_FOREIGN = re.compile("[Ͱ-ӿ]")
_ODD = re.compile(r"[̀-ӿ​-‏⁠ﬀ-ﬆ豈-﫿＀-￯﻿]")


@lru_cache(maxsize=10_000)
def label_language(label: str | None) -> str | None:
    """Two-letter code of the language that a label names; null if it names none."""
    if label is None:
        return None
    t = unicodedata.normalize("NFKC", label).casefold().strip()
    return _NAMES.get(t) or _NAMES.get(re.split(r"[-_\s(/,;]", t)[0])


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text, without surrounding line breaks."""
    return _BLANK_LINES.split(text.strip("\n \t\r"))


_LETTER: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space."""
    global _LETTER
    if _LETTER is None:
        table = np.full(0x10000, 32, np.uint32)
        for c in range(0x10000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER = table
    return _LETTER


def _spelt(text: str) -> str:
    """Letters of other scripts inside of a Latin text are spelt as it looks; a text in such a script keeps its letters."""
    foreign, letters = len(_FOREIGN.findall(text)), sum(map(str.isalpha, text))
    return unicodedata.normalize("NFKC", text) if 2 * foreign > letters else one_form(text)


class Vectors:
    """Hashed trigram counts of paragraphs, chunk by chunk."""

    @staticmethod
    def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(paragraphs, DIMENSIONS) counts, and the number of letters of each."""
        table = _letter_table()
        joined = "\x00".join(_spelt(t) if not t.isascii() and _ODD.search(t) else t for t in texts)
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = raw == 0
        letters = table[np.minimum(raw, 0xFFFF)]
        letters[ends] = 0
        owner = np.cumsum(ends, dtype=np.int32)
        keep = np.ones(len(raw), bool)
        keep[1:] = (letters[1:] != 32) | (letters[:-1] > 32)
        letters, owner = letters[keep], owner[keep]
        total = np.bincount(owner[letters > 32], minlength=len(texts))
        if len(letters) < 3:
            return np.zeros((len(texts), DIMENSIONS), np.float32), total
        a, b, c = letters[:-2], letters[1:-1], letters[2:]
        whole = (a != 0) & (b != 0) & (c != 0)
        h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        at = owner[:-2][whole].astype(np.int64) * DIMENSIONS + (1 + h[whole] % np.uint32(DIMENSIONS - 1))
        counts = np.bincount(at, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS).astype(np.float32)
        # Trigrams of ideographs are too many to be known all; the first dimension counts the ideographs themselves.
        counts[:, 0] = np.bincount(owner[(letters >= 0x3400) & (letters <= 0x9FFF)], minlength=len(texts))
        return counts, total


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def _clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; starts from points spread over the set in a fixed order."""
    k = min(k, len(x))
    picks = [0]
    near = x @ x[0]
    while len(picks) < k:
        picks.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picks[-1]])
    centres = x[picks]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = _unit(np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)]))
    return centres


class LanguageModel:
    """Centroids, their languages, and the least cosine of each language."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, owner: list[str], least: dict[str, float]) -> None:
        self.idf, self.centroids, self.owner, self.least = idf, centroids, owner, least
        self.languages = sorted(set(owner))
        self._starts = [[i for i, o in enumerate(owner) if o == lang] for lang in self.languages]

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]]) -> LanguageModel:
        """labelled: (paragraph, language), some wrong."""
        texts, labels = [t for t, _ in labelled], np.array([lang for _, lang in labelled])
        counts = np.concatenate([Vectors.counts(texts[i : i + CHUNK])[0] for i in range(0, len(texts), CHUNK)])
        idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        x = _unit(counts * idf)
        languages = sorted({lang for _, lang in labelled})
        right = np.ones(len(x), bool)
        for _ in range(4):  # trim wrong labels
            mean = _unit(np.array([x[right & (labels == lang)].mean(0) if (right & (labels == lang)).any() else np.zeros(x.shape[1]) for lang in languages]))
            right = np.array(languages)[(x @ mean.T).argmax(1)] == labels
        centres, owner, least = [], [], {}
        for lang in languages:
            own = x[right & (labels == lang)]
            if len(own) < 2:
                continue
            few = len(own) < FEW_PARAGRAPHS
            c = _clusters(own, 1 if few else CENTROIDS)
            centres.append(c)
            owner += [lang] * len(c)
            # Few paragraphs lie near a centroid of their own making; each is compared with that of the others.
            near = np.einsum("ij,ij->i", own, _unit(own.sum(0) - own)) if few else (own @ c.T).max(1)
            least[lang] = REJECT_SHARE * float(near.mean())
        return cls(idf, np.concatenate(centres).astype(np.float32), owner, least)

    def classify(self, texts: list[str]) -> list[tuple[str | None, str | None, float, int]]:
        """(language or null if rejected, nearest language, confidence, letters) of each text."""
        out = []
        for s in range(0, len(texts), CHUNK):
            counts, letters = Vectors.counts(texts[s : s + CHUNK])
            counts *= self.idf
            norm = np.sqrt(np.einsum("ij,ij->i", counts, counts))
            cos = (counts @ self.centroids.T) / np.maximum(norm, 1e-9)[:, None]
            best = np.stack([cos[:, k].max(1) for k in self._starts], 1)
            order = best.argsort(1)
            for i, row in enumerate(best):
                top, second = order[i, -1], order[i, -2] if best.shape[1] > 1 else None
                lead = float(row[top] - (row[second] if second is not None else 0)) / max(float(row[top]), 1e-9)
                lang = self.languages[top]
                if norm[i] == 0:
                    out.append((None, None, 0.0, int(letters[i])))
                    continue
                sure = letters[i] >= (LEAST_LETTERS if lang != "zh" else LEAST_LETTERS // 3) and row[top] >= self.least[lang] and lead >= LEAST_LEAD
                out.append((lang if sure else None, lang, round(min(1.0, max(0.0, float(row[top]) * 0.5 + 0.5 * min(1.0, 2 * lead))), 4), int(letters[i])))
        return out


def fit_on(documents: DataFrame) -> LanguageModel:
    """The model from a bounded sample of documents whose label names a language, and from seed texts where there are few."""
    docs = share_of(documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text"), ["doc_id"], SAMPLE_DOCUMENTS)
    every = docs.select("doc_id", "lang", F.posexplode(F.split("text", _BLANK_LINES.pattern)).alias("place", "p")).filter(F.length("p") >= 40)
    rows = bounded_sample(every.withColumn("p", F.substring("p", 1, SAMPLE_CHARACTERS)), ["doc_id", "place"], SAMPLE_PARAGRAPHS)
    labelled = [(r.p, lang) for r in rows if (lang := label_language(r.lang))]
    return LanguageModel.fit(labelled + seed_paragraphs(labelled))


def seed_paragraphs(labelled: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The sentences of the seed texts of languages with few labelled paragraphs."""
    n = Counter(lang for _, lang in labelled)
    seeds = [line.split(" ", 1) for line in SEEDS.strip().splitlines()]
    return [(p, lang) for lang, text in seeds if n[lang] < FEW_PARAGRAPHS for p in re.split(r"(?<=\.) |(?<=。)", text) if p]


def main_language(found: list[tuple[str | None, str | None, float, int]]) -> tuple[str | None, float]:
    """The language of most paragraphs and its share-weighted confidence."""
    n: dict[str, list[float]] = {}
    for lang, _, conf, letters in found:
        if lang:
            e = n.setdefault(lang, [0, 0, 0.0])
            e[0], e[1], e[2] = e[0] + 1, e[1] + letters, e[2] + conf
    if not n:
        return None, 0.0
    lang = min(n, key=lambda k: (-n[k][0], -n[k][1], k))
    return lang, round(n[lang][2] / sum(e[0] for e in n.values()), 4)


_TEXT_SCHEMA = "page_number long, lang string, n long, letters long, confidence double, segments array<struct<segment:long,confidence:double>>"


def _by_language(model: LanguageModel, texts: list[str | None]) -> list[list[tuple]]:
    """For each text the rows (lang, n, letters, confidence, segments); lang null holds the nearest language of a text without any."""
    split = [paragraphs(t) if t and not t.isspace() else [] for t in texts]
    flat = model.classify([p for ps in split for p in ps])
    out, at = [], 0
    for ps in split:
        found = flat[at : at + len(ps)]
        at += len(ps)
        rows: dict[str, list] = {}
        for k, (lang, _, conf, letters) in enumerate(found, 1):
            if lang:
                e = rows.setdefault(lang, [0, 0, 0.0, []])
                e[0], e[1], e[2] = e[0] + 1, e[1] + letters, e[2] + conf
                e[3].append({"segment": k, "confidence": conf})
        out.append([(lang, e[0], e[1], round(e[2] / e[0], 4), e[3]) for lang, e in rows.items()])
    return out


def page_languages(pages: DataFrame, model) -> DataFrame:
    """version_id, page_number, lang, n, letters, confidence, segments: one row per page and language; lang '?x' is the nearest one of a page without any."""
    rows = pages.filter(F.col("text").isNotNull() & F.col("version_id").isNotNull()).select("version_id", "number", "text")

    def make():
        m = model.value

        def run(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("version_id", "page_number", "lang", "n", "letters", "confidence", "segments")}
            alone = []
            for i, found in enumerate(_by_language(m, c["text"])):
                if not found and any(not ch.isspace() for ch in one_form(c["text"][i])):
                    alone.append(i)
                for row in found:
                    for k, v in zip(out, (c["version_id"][i], c["number"][i], *row), strict=True):
                        out[k].append(v)
            for i, (_, nearest, conf, letters) in zip(alone, m.classify([c["text"][i] for i in alone]), strict=True):
                for k, v in zip(out, (c["version_id"][i], c["number"][i], f"?{nearest or ''}", 0, letters, conf, []), strict=True):
                    out[k].append(v)
            return out

        return run

    return map_batches_from(rows, make, f"version_id string, {_TEXT_SCHEMA}")


def version_languages(per_page: DataFrame) -> DataFrame:
    """version_id, lang, confidence: the main language over all pages. per_page: distinct rows of :func:`page_languages`."""
    sums = per_page.groupBy("version_id", "lang").agg(F.sum("n").alias("n"), F.sum("letters").alias("letters"), F.sum(F.col("n") * F.col("confidence")).alias("c"), F.max("confidence").alias("top"))
    rank = F.struct((~F.col("lang").startswith("?")).alias("sure"), F.col("n"), F.col("letters"), (-F.ascii(F.substring("lang", 1, 1))).alias("o1"), (-F.ascii(F.substring("lang", 2, 1))).alias("o2"), "lang", "c", "top")
    best = sums.groupBy("version_id").agg(F.max(rank).alias("b"), F.sum("n").alias("all"))
    name = F.regexp_replace("b.lang", r"^\?", "")
    conf = F.when(F.col("b.sure"), F.col("b.c") / F.col("all")).otherwise(F.col("b.top") / 2)
    return best.select("version_id", F.when(name != "", name).alias("lang"), F.round(conf, 4).alias("confidence"))


def document_cases(documents: DataFrame, model, with_all: bool = False) -> DataFrame:
    """row_key, segment, lang, confidence of documents: the label cases (segment 0) and the paragraphs in another language.

    with_all: segment 0 for every text instead. Residue (problem 10) has no case.
    """
    rows = documents.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")

    def make():
        m = model.value

        def run(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("row_key", "segment", "lang", "confidence")}

            def add(key, segment, lang, conf):
                for k, v in zip(out, (str(key), segment, lang, conf), strict=True):
                    out[k].append(v)

            found = _by_language(m, c["text"])
            bare = [i for i, f in enumerate(found) if not f and c["text"][i] and not c["text"][i].isspace()]
            nearest = dict(zip(bare, m.classify([c["text"][i] for i in bare]), strict=True))
            for i, own in enumerate(found):
                if own:
                    lang, n, _, conf, _ = min(own, key=lambda r: (-r[1], -r[2], r[0]))
                    conf = round(conf * n / sum(r[1] for r in own), 4)
                elif i in nearest and nearest[i][1]:
                    lang, conf = nearest[i][1], round(nearest[i][2] / 2, 4)
                else:
                    continue
                label = label_language(c["lang"][i]) == lang
                others = [(s["segment"], r[0], s["confidence"]) for r in own if r[0] != lang for s in r[4]]
                if with_all:
                    add(c["doc_id"][i], 0, lang, conf)
                elif label and not others or residue_kind(c["text"][i]):
                    continue
                elif not label:
                    add(c["doc_id"][i], 0, lang, conf)
                for segment, other, sure in others:
                    add(c["doc_id"][i], segment, other, sure)
            return out

        return run

    return map_batches_from(rows, make, "row_key string, segment long, lang string, confidence double")


def _shared_model(documents: DataFrame):
    return documents.sparkSession.sparkContext.broadcast(fit_on(documents))


def language_cases(documents: DataFrame, versions: DataFrame, pages: DataFrame) -> DataFrame:
    """table_name, row_key, page_number, segment, lang, confidence of all label and segment cases."""
    model = _shared_model(documents)
    per_page = written(page_languages(pages, model), "page-languages")
    # A page delivered twice counts once; if the texts differ, the row that sorts last holds.
    rest = ["n", "letters", "confidence", "segments"]
    once = per_page.groupBy("version_id", "page_number", "lang").agg(F.max(F.struct(*rest)).alias("r")).select("version_id", "page_number", "lang", *[f"r.{c}" for c in rest])
    main = written(version_languages(once), "version-languages")
    heavy = heavy_keys(once.groupBy("version_id").count(), "version_id", "count")
    segments = (
        lookup(once.filter("n > 0"), main.select("version_id", F.col("lang").alias("main")), "version_id", heavy, "inner")
        .filter(F.col("lang") != F.col("main"))
        .select("version_id", "page_number", "lang", F.inline("segments"))
        .select(F.lit("versions").alias("table_name"), F.col("version_id").alias("row_key"), "page_number", "segment", "lang", "confidence")
    )
    labels = versions.filter(F.col("version_id").isNotNull()).groupBy("version_id").agg(F.max(F.col("metadata.language")).alias("label"))
    named = map_batches(main.filter(F.col("lang").isNotNull()).join(labels, "version_id"), lambda c: {**c, "label": [label_language(x) for x in c["label"]]}, "version_id string, lang string, confidence double, label string")
    wrong = named.filter(~F.col("label").eqNullSafe(F.col("lang")))
    wrong = wrong.select(F.lit("versions").alias("table_name"), F.col("version_id").alias("row_key"), F.lit(0).cast("long").alias("page_number"), F.lit(0).cast("long").alias("segment"), "lang", "confidence")
    docs = document_cases(documents, model).select(F.lit("documents").alias("table_name"), "row_key", F.lit(0).cast("long").alias("page_number"), "segment", "lang", "confidence")
    return wrong.unionByName(segments).unionByName(docs)


def document_languages(documents: DataFrame) -> DataFrame:
    """row_key, segment, lang, confidence: the main language of every document (segment 0) and its paragraphs in other languages."""
    return document_cases(documents, _shared_model(documents), with_all=True)
