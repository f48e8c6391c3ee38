"""Template residue, filler and error-page text (problem 10).

Method: unfilled placeholders are found by delimiter-specific grammars and regular expressions; code blocks and running
text that speaks about placeholders are discounted through surrounding context and density. Filler is judged by
paragraph, error pages and script notices by the share of the text that such sentences make up.

Every text is judged by the rule itself, in Arrow batches; nothing is filtered before.

Defined results: null and blank texts are no case. A text is judged whole, whatever its length. Rows are independent of
each other, so repeated rows repeat their result.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrow import map_batches

#: Share of a text's letters in error, notice and navigation sentences from which the text is a page of that kind.
PAGE_SHARE = 0.5
#: A line up to so many characters without end of sentence is a heading, not content of an error page.
HEADING = 80
#: Words besides the placeholders, for each placeholder, that a sentence to be filled in has at most.
WORDS_PER_PLACEHOLDER = 10

# Words of instructions to fill something in, by language.
FILL_WORDS = (
    "insert|enter|your|here|tbd|tba|todo|to be completed|to be defined|fill in|add|type|placeholder|"
    "einfügen|eintragen|eingeben|ausfüllen|auszufüllen|ergänzen|hier|"
    "compléter|insérer|saisir|remplir|renseigner|"
    "rellenar|completar|insertar|introducir|aquí|"
    "preencher|inserir|aqui|"
    "待補|待填|請填|填寫|填入|輸入|插入"
)
# Words of sentences that speak about a placeholder instead of having one.
MENTION_WORDS = (
    "example|template|manual|tutorial|tag|marker|syntax|field|prompt|printer|designer|writes|shows|such as|called|placeholder|mock|trainees?|"
    "beispiel|vorlage|handbuch|feld|platzhalter|drucker|übungsbogen|"
    "exemple|modèle|balise|champ|imprimante|"
    "ejemplo|plantilla|marca|campo|impresora|"
    "exemplo|modelo|impressora|"
    "範例|範本|欄位|印表機|標記|例如"
)
# Vocabulary of the common Latin filler text.
LATIN_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)

_NAME = r"\s*[^\W\d][\w.\- ]{0,40}?\s*"
_PLACEHOLDER = re.compile(
    rf"\{{\{{{_NAME}\}}\}}|\$\{{{_NAME}\}}|\{{%={{0,1}}{_NAME}%\}}|<%=?{_NAME}%>|%[A-Z][A-Z0-9_]{{1,40}}%|__[A-Z][A-Z0-9_]{{0,40}}?__|\[\[{_NAME}\]\]|<<{_NAME}>>|@@{_NAME}@@|\#[a-z][a-z0-9_]{{1,40}}\#|«{_NAME}»"
    rf"|[\[<(【（](?=[^\[\]<>()【】（）\n]{{0,60}}(?<![^\W_])(?i:{FILL_WORDS})(?![a-zà-ÿ]))[^\[\]<>()【】（）/=\n]{{2,60}}[\]>)】）]"
)
_MENTION = re.compile(rf"(?i)(?<![^\W_])(?:{MENTION_WORDS})(?![a-zà-ÿ])")
_CODE = re.compile(r"(?s)```.*?```|~~~.*?~~~|<(code|pre|script|style)\b.*?</\1\s*>|`[^`\n]+`")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"<[^<>]{0,300}>")

_STOCK_FILLER = re.compile(
    r"(?i)^\W*(?:"
    r"(?:your|sample|dummy|example|placeholder|body) (?:content|text|copy|headline|title)\b.{0,40}"
    r"|placeholder (?:for|text)\b.{0,60}|(?:replace|delete|overwrite) this (?:paragraph|text|section|sentence)\b.{0,60}|(?:type|write|enter|add|put|insert) (?:something|some text|your text|text|content)\b.{0,60}|(?:content|text|description) goes here"
    r"|(?:beispieltext|blindtext|platzhalter(?:text)?|mustertext)\b.{0,40}|(?:hier|ihren?) (?:text|inhalt) .{0,40}|ersetzen sie diesen (?:absatz|text)\b.{0,60}"
    r"|(?:votre|exemple de|texte d) ?.?(?:contenu|texte|exemple)\b.{0,40}|remplacez ce (?:paragraphe|texte)\b.{0,60}|texte? (?:fictif|provisoire)\b.{0,30}"
    r"|(?:su|texto de) (?:contenido|texto|ejemplo|relleno)\b.{0,40}|(?:sustituya|reemplace) este (?:párrafo|texto)\b.{0,60}"
    r"|(?:seu|texto de) (?:conteúdo|texto|exemplo)\b.{0,40}|substitua este (?:parágrafo|texto)\b.{0,60}"
    r"|(?:此處|這裡|请|請)(?:為|是|輸入|填寫|放置|替換).{0,12}(?:內容|文字|段落|說明).{0,12}|(?:範例|示範|佔位)(?:文字|內容).{0,12}"
    r")\W*$"
)

_ERROR = re.compile(
    r"(?i)\b(?:4\d\d|5\d\d)\b\W{0,3}(?:not found|bad gateway|forbidden|unauthori[sz]ed|gone|internal server error|service unavailable|gateway time-?out|bad request|too many requests)"
    r"|\b(?:error|fehler|erreur|erro)\W{0,3}[45]\d\d\b(?!\W+(?:when|wenn|quand|cuando|quando|erscheint|aparece|appears|s'affiche|apparaît))"
    r"|\bpage (?:not found|does not exist|cannot be displayed|can't be displayed|you requested|you are looking for)|could not be (?:located|found) on this server|has been moved or (?:deleted|removed)|(?:requested|this) (?:url|page|resource)\b.{0,60}\b(?:not found|could not|was not|cannot)"
    r"|^\W*access (?:is )?denied\W*|you (?:do not|don't) have permission|please (?:sign|log) ?(?:in|on)\b|session (?:has )?(?:expired|timed out)|something went wrong|(?:our|the) team has been notified|service (?:is )?(?:temporarily )?unavailable|internal server error|bad gateway|did not answer in time|try again later|an? (?:unexpected )?error (?:has )?occurred"
    r"|seite\b.{0,40}nicht gefunden|interner serverfehler|versuchen sie es (?:bitte )?(?:später|erneut)|^\W*zugriff verweigert|melden sie sich (?:bitte )?(?:erneut )?an\b|sitzung ist abgelaufen|ihre sitzung|dienst (?:ist )?(?:vorübergehend )?nicht verfügbar|(?:es ist )?ein fehler (?:ist )?aufgetreten"
    r"|page\b.{0,40}(?:est )?introuvable|accès refusé|session a expiré|veuillez vous (?:re)?connecter|service (?:temporairement )?indisponible|erreur interne|veuillez réessayer|réessayez plus tard|une erreur (?:s'est produite|est survenue)"
    r"|no se encontró la página|página no encontrada|acceso denegado|inicie sesión|su sesión|servicio (?:no disponible|temporalmente)|inténtelo (?:de nuevo )?más tarde|error interno|algo salió mal|se ha producido un error"
    r"|página\b.{0,40}não (?:foi )?encontrad|acesso negado|faça login|sua sessão|serviço (?:temporariamente )?indisponível|tente (?:novamente )?mais tarde|erro interno|algo deu errado|ocorreu um erro"
    r"|找不到(?:此|該|您)?.{0,12}(?:頁面|網頁|頁)|頁面不存在|存取遭拒|拒絕存取|請重新登入|伺服器(?:發生)?(?:內部)?錯誤|服務(?:暫時)?(?:無法使用|停止)|請稍後再試|(?:工作階段|連線)已(?:逾時|過期)"
)
_SCRIPT_WORD = r"(?:java ?script|\bjs\b|\bscripts?\b|\bscripting\b|\bskripte?n?\b|指令碼|腳本)"
_SCRIPT_NEED = r"(?:enable|activate|turn(?:ed)? (?:on|off)|allow|require[sd]?|needs?|needed|disabled|blocked|blocks|aktivieren|benötigt|blockiert|erforderlich|erfordert|activer|activez|nécessite|exécution|requis|désactivé|active\b|activar|activa|necesita|requiere|bloqueados?|habilite|ative\b|ativar|precisa|exige|requer|bloqueou|需要|啟用|停用|開啟)"
_SCRIPT = re.compile(rf"(?i){_SCRIPT_NEED}.{{0,60}}{_SCRIPT_WORD}|{_SCRIPT_WORD}.{{0,60}}{_SCRIPT_NEED}")
_NAVIGATION = re.compile(
    r"(?i)^\W*(?:[^\W\d_][\w ]{1,20}(?:\s*[|›»·•/–-]\s*[^\W\d_][\w ]{1,20}){1,9}|skip to (?:main )?content|back to (?:start|top|home|overview)|zurück zur? .{1,20}|zum inhalt springen|retour (?:au|à) .{1,20}|aller au contenu|volver al? .{1,20}|ir al contenido|voltar (?:ao|à|para) .{1,20}|pular para o conteúdo|返回.{1,6}|跳至.{1,8}|"
    r"(?:reference|ref|case|code|vorgang|référence|referencia|referência|incident|incidencia|incidência|caso|código|request id|編號|代碼)\W{0,3}[0-9a-f]{2,12}\W*|.{0,20}\bgateway \d[\d.]*\W*|\(ref \w+\)|ihr browser blockiert sie\W*|loading\W*)\W*$"
)

# Parts of words, in lower case, of which every error or notice sentence has one.
STEMS = (
    "erro|erreur|fehler|found|gateway|forbidden|unauthori|gone|bad request|many requests|page|this server|moved or|requested url|this url|requested resource|this resource|denied|permission|"
    "signin|sign in|signon|sign on|login|log in|logon|log on|expired|timed out|went wrong|been notified|unavailable|answer in time|try again|gefunden|versuchen sie es|verweigert|melden sie|sitzung|verfügbar|"
    "introuvable|refusé|expiré|connecter|indispon|réessay|página|denegado|sesión|servicio|inténtelo|salió mal|negado|sessão|mais tarde|deu errado|js|script|skript|"
    "找不到|頁面|存取|登入|伺服器|服務|稍後|逾時|過期|指令碼|腳本"
).split("|")


def _has_stem(text: str) -> bool:
    low = text.lower()
    if not low.isascii():  # the two letters that a regular expression without case takes for an i
        low = low.replace("i\u0307", "i").replace("ı", "i")
    return any(x in low for x in STEMS)


def placeholders_left(text: str) -> bool:
    """A sentence of the text (code left out) is a form with unfilled placeholders."""
    if not _PLACEHOLDER.search(text):
        return False
    for line in _SENTENCE.split(_CODE.sub(" ", text)):
        n = len(found := _PLACEHOLDER.findall(line))
        if not n:
            continue
        rest = _PLACEHOLDER.sub(" ", line)
        words = sum(-(-len(w) // 2) if w[0] > "\u2e80" else 1 for w in _WORD.findall(rest))
        mentions = len(_MENTION.findall(rest))
        if n - mentions >= 2 and words <= WORDS_PER_PLACEHOLDER * n or n == 1 and not mentions and words <= 6 and len(found) == 1:
            return True
    return False


def _may_be_latin(folded: str) -> bool:
    """False only if more than three in ten words are certainly none of the Latin filler's; much faster than to take all words apart."""
    misses = tokens = unclear = 0
    for t in folded.split():
        tokens += 1
        if not t.isalpha():
            t = t.strip(".,;:!?()\"'")
            if not t.isalpha():
                unclear += len(t)  # at most every second character begins a word
                continue
        misses += t not in LATIN_FILLER
    return misses <= 0.3 * (tokens + unclear / 2)


def is_filler(paragraph: str) -> bool:
    """A paragraph of Latin filler, keyboard noise, one word again and again, or stock sentences to be replaced."""
    folded = paragraph.casefold()
    if _may_be_latin(folded):
        words = _WORD.findall(folded)
        if len(words) >= 5 and sum(map(LATIN_FILLER.__contains__, words)) >= 0.7 * len(words):
            return True
    first, *rest = _SENTENCE.split(paragraph.lstrip(), 1)  # most paragraphs are decided by their first line
    if first.strip() and not _filler_line(first):
        return False
    lines = [x for x in (first, *_SENTENCE.split(*rest)) if x.strip()] if rest else [first]
    return bool(first.strip() or rest) and any(x.strip() for x in lines) and all(_filler_line(x) for x in lines)


def _filler_line(line: str) -> bool:
    words = _WORD.findall(line.casefold())
    if len(words) >= 4 and (len(set(words)) <= len(words) // 2 and len(set(words)) <= 3 or all(len(set(w)) == 1 for w in words)) and all(w.isascii() for w in words):
        return True
    if len(words) >= 5 and sum(w in LATIN_FILLER for w in words) >= 0.7 * len(words):
        return True
    return bool(_STOCK_FILLER.match(line))


def _letters(s: str) -> int:
    return sum(map(str.isalnum, s))


def is_error_page(text: str) -> bool:
    """Error or notice sentences make up at least half of the text that is neither navigation nor a heading."""
    if not _has_stem(text):
        return False
    plain = _TAG.sub("\n", re.sub(r"(?is)<title>.*?</title>|<(script|style)\b.*?</\1\s*>", "\n", text)) if "<" in text else text
    kept = total = 0
    left = len(plain)
    for s in _SENTENCE.split(plain):
        left -= len(s)
        if _has_stem(s) and (_ERROR.search(s) or _SCRIPT.search(s)):
            kept += _letters(s)
            total += _letters(s)
        elif not (len(s) <= HEADING and s[-1:] not in ".!?。！？" or _NAVIGATION.match(s)):
            total += _letters(s)
            if kept + left < PAGE_SHARE * (total + left):  # even if all that follows were error sentences
                return False
    return kept > 0 and kept >= PAGE_SHARE * total


def residue_kind(text: str | None) -> str | None:
    """placeholder, filler, error_page or null."""
    if not text or text.isspace():
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if placeholders_left(text):
        return "placeholder"
    if any(is_filler(p) for p in _PARAGRAPH.split(text) if p.strip()):
        return "filler"
    if is_error_page(text):
        return "error_page"
    return None


def find_residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind of each row whose text is residue instead of content."""
    rows = documents.select(key, text).filter(F.col(text).isNotNull())

    def judge(cols: dict[str, list]) -> dict[str, list]:
        kinds = [residue_kind(t) for t in cols[text]]
        keep = [i for i, k in enumerate(kinds) if k]
        return {key: [cols[key][i] for i in keep], "kind": [kinds[i] for i in keep]}

    return map_batches(rows, judge, f"{key} {documents.schema[key].dataType.simpleString()}, kind string")
