"""Template residue and error-page text: unfilled slots, filler, error pages, script notices.

Slots are found by one grammar per delimiter and discounted where the text around them
says that it only writes about slots: inside code, and in sentences that explain them. They
count by density: one in so many words, so that a long report with a slot left over is content.
Filler, error pages and notices count by density: their lines must make up most of what
the document holds, so that a report that quotes an error message is left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from operator import eq

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.session import skip_empty, table

_NAME = r"[^\W\d]\w{0,30}(?:[ _.-]\w{1,30}){0,3}"
_FILL = r"insert\w*|ins[ée]rer|einf[üu]gen|einsetzen|enter|add|your|votre|vos|ihre?n?|su|sus|tu|fill|indiquer|indicar"
_OPEN = r"tbd|tba|todo|tbc|here|hier|ici|aqu[íi]|einf[üu]gen|offen|à compléter|por completar|ausf[üu]llen"
#: One grammar per delimiter, tried in this order.
GRAMMARS: dict[str, str] = {
    "mustache": r"\{\{[{#/^&]?\s*" + _NAME + r"\s*\}?\}\}",
    "percent_brackets": r"\[\[%\s*" + _NAME + r"\s*%\]\]|\{%\s*" + _NAME + r"\s*%\}",
    "double_square": r"\[\[\s*" + _NAME + r"\s*\]\]",
    "server_tag": r"<%[=-]?\s*" + _NAME + r"\s*-?%>|<\?=?\s*\$?" + _NAME + r"\s*\?>",
    "double_angle": r"<<\s*" + _NAME + r"\s*>>",
    "dollar_brace": r"\$\{\s*" + _NAME + r"\s*\}",
    "hash_brace": r"#\{\s*" + _NAME + r"\s*\}",
    "position": r"\{\d{1,2}\}(?:\s\([^()\n]{1,40}\))?",
    "brace": r"(?<![\w$#{%])\{\s*(?=[^\W\d]\w)" + _NAME + r"\s*\}(?!\})",
    "at_signs": r"@@\w{2,40}@@",
    "percents": r"(?<![\w%])%[A-Z][A-Z0-9_]{2,40}%",
    "crosses": r"\bXX[A-Z][A-Z0-9_]{1,40}XX\b",
    "underlines": r"(?<!\w)__[A-Z][A-Z0-9_]{1,40}?__(?!\w)",
    "angle_words": r"<(?:" + _FILL + r")\b[^<>\n]{0,40}>|<[^<>\n]{1,40}\s(?:" + _OPEN + r")>",
    "square_words": r"\[(?:" + _FILL + r")\b[^\[\]\n]{0,40}\]|\[[^\[\]\n]{1,40}\b(?:" + _OPEN + r")\]|\[[^\[\]\n]{1,40}:\s*[_.]{2,}\]",
    "guillemets": r"«[^\W\dA-ZÀ-Þ][\w]{1,30}(?:[ _]\w{1,20}){0,2}»",
}
_CASED = ("percents", "crosses", "underlines", "guillemets")
_SLOT = re.compile("|".join(f"(?P<{k}>(?-i:{v}))" if k in _CASED else f"(?P<{k}>{v})" for k, v in GRAMMARS.items()), re.IGNORECASE)
_HINT = re.compile(r"[{@«]|\[\[|<[<%?\w]|%[A-Z]|XX|__|\[\w[^\]\n]*(?:[ :]|_)[^\]\n]*\]")
_RARE = ("{", "[", "<", "@@", "«", "XX", "__")
_CODE = re.compile(r"```.*?```|~~~.*?~~~|`[^`\n]*`|(?:(?<=\n\n)|^)(?: {4}|\t)[^\n]*", re.DOTALL)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")
#: Words of sentences that write about slots instead of holding one.
_EXPLAINS = re.compile(
    r"\b(?:markers?|placeholders?|variables?|for example|e\.g|in the shell|shell example|syntax|tutorial|template language|merge step|denotes?|"
    r"platzhalter|marke wie|zum beispiel|variablen?|balises?|par exemple|espace réservé|marca como|marcadores?|por ejemplo)\b",
    re.IGNORECASE,
)
_ENVIRONMENT = re.compile(r"[$%]\{?(?:HOME|PATH|USER|USERNAME|PWD|SHELL|TEMP|TMP|LANG|APPDATA|HOSTNAME|JAVA_HOME|PYTHONPATH)\}?%?$")


def slots(text: str) -> list[tuple[str, str]]:
    """(grammar, slot) of the unfilled slots of ``text``, without those that are only written about."""
    if not any(c in text for c in _RARE) and not ("%" in text and _HINT.search(text)):
        return []
    if not _HINT.search(text):
        return []
    bare = _CODE.sub(lambda m: " " * len(m.group()), text)
    found = []
    for m in _SLOT.finditer(bare):
        kind, slot = m.lastgroup, m.group()
        if kind == "dollar_brace" or kind == "percents":
            if _ENVIRONMENT.match(slot):
                continue
        a = max((x.end() for x in _SENTENCE.finditer(bare, max(0, m.start() - 400), m.start())), default=max(0, m.start() - 400))
        b = _SENTENCE.search(bare, m.end())
        around = bare[a : m.start()] + " " + bare[m.end() : b.start() if b else len(bare)]
        if not _EXPLAINS.search(around):
            found.append((kind, slot))
    return found


#: Function words of the four languages of the corpus: text without them is no sentence of any.
_FUNCTION = frozenset(
    "the a an of and in to for on by with at is was were are be as it its this that these those from or not no has have had because since although while so if until than which "
    "der die das den dem des ein eine einen einem einer und im in zu zum zur von vom mit auf aus bei ist sind war wurde nach für nicht weil um als auch laut sich über bis vor es "
    "le la les l un une du de des et à a au aux en dans pour par sur avec est sont était chez selon que qui ne pas ce cette son sa ses plus car "
    "el los las un una del y al en con por para es son fue se su sus lo que no más como pese según tras hasta desde sin ya porque aunque".split()
)
_WORD = re.compile(r"[^\W\d_]+")

_SCRIPT = r"(?:java ?script|\bjs\b|scripts?\b|skript\w*|ejecución de scripts|exécution de scripts|script support)"
#: Lines of a residue kind, in the languages of the corpus; each is searched in one sentence or line.
_LINES: dict[str, re.Pattern[str]] = {
    "notice": re.compile(
        rf"(?:\b(?:please|you|your|this (?:page|viewer|site|application|app|content)|we)\b.*(?:enable|activate|allow|turn on|switch on|requires?|needs?|support|blocked|disabled).*{_SCRIPT})"
        rf"|(?:(?:enable|activate|turn on|allow) {_SCRIPT})|(?:{_SCRIPT}.*(?:is|are|has been|have been|seems? to be) (?:disabled|blocked|turned off|required|needed))"
        rf"|(?:your browser.*{_SCRIPT})|(?:(?:aktivieren|erlauben|bitte|benötigt|braucht|erforderlich|ihre[mn]? browser).*{_SCRIPT})|(?:{_SCRIPT}.*(?:erforderlich|blockiert|deaktiviert|aktivieren))"
        rf"|(?:(?:activez|activer|autorisez|autoriser|veuillez|nécessite|requiert|votre navigateur).*{_SCRIPT})"
        rf"|(?:(?:active|activar|habilite|permita|permitir|requiere|necesita|su navegador).*{_SCRIPT})",
        re.IGNORECASE,
    ),
    "error": re.compile(
        r"(?<![\d.,])(?<!\d[ \u00a0\u202f])\b(?:[45]\d\d)\b\s*[-–:]?\s*(?:forbidden|not found|bad gateway|bad request|unauthori[sz]ed|service|gateway|internal|error|seite|page|página|zugriff|accès|acceso|interner|erreur|too many)"
        r"|(?:error|fehler|erreur|status|http)\s*[:#]?\s*[45]\d\d\b|internal server error|interner serverfehler|erreur interne|error interno"
        r"|access denied|zugriff verweigert|accès refusé|acceso denegado|something went wrong|etwas ist schief|une erreur est survenue|algo (?:salió|ha salido) mal|se ha producido un error|ein fehler ist aufgetreten"
        r"|page not found|seite (?:wurde )?nicht gefunden|page introuvable|página no encontrada|document could not be loaded|dokument konnte nicht geladen|document n'a pas pu être chargé|no se pudo cargar"
        r"|session has expired|sitzung ist abgelaufen|session a expiré|sesión ha (?:caducado|expirado)|request timed out|zeitüberschreitung|délai d'attente|tiempo de espera|too many requests|zu viele anfragen|trop de requêtes|demasiadas solicitudes"
        r"|temporarily unavailable|vorübergehend nicht (?:verfügbar|erreichbar)|temporairement indisponible|no disponible temporalmente|bad gateway|gateway timeout"
        r"|try again later|später erneut|réessayer plus tard|inténtelo (?:de nuevo )?más tarde|start page|startseite|page d'accueil|página de inicio|our team has been notified|unser team wurde|notre équipe a été|nuestro equipo ha sido"
        r"|sign in again|log in again|melden sie sich (?:bitte )?erneut|reconnectez-vous|inicie sesión|permission to (?:view|access|read)|keine berechtigung|pas autorisée?s? à (?:consulter|voir|accéder)|no tiene permiso"
        r"|(?:address|url) you entered|angeforderte (?:adresse|seite)|adresse demandée|dirección solicitada|upstream service|did not respond in time|nicht rechtzeitig|n'a pas répondu|no respondió"
        r"|quote reference \w|fehlerkennung|référence de l'incident|referencia del incidente|document server\s*/\s*[\d.]+|^\W*(?:oops|hoppla|oups|ups)\W*$",
        re.IGNORECASE,
    ),
    "filler": re.compile(
        r"(?:^|(?<=\W))(?:type something here|your text (?:goes )?here|text goes here|add a short (?:summary|description)\b|replace this (?:paragraph|text|sentence) with\b|this is (?:a )?(?:dummy|placeholder|sample|filler) (?:paragraph|text)\b"
        r"|description of the item|content coming soon|coming soon|sample (?:heading|title|text)|placeholder (?:text|heading)|click to (?:add|edit)\b|enter (?:your )?text(?: here)?|lorem ipsum\b"
        r"|(?:dies|das|hier) ist ein? (?:blind|beispiel|platzhalter|muster)text\b|(?:muster|beispiel)(?:überschrift|text|titel)|hier steht ihr text|platz für eine?\b[^.]{0,20}beschreibung|ersetzen sie diesen (?:absatz|text)\b|inhalt folgt|text (?:hier )?eingeben"
        r"|ceci est un texte (?:factice|d'exemple|de remplissage)\b|votre texte ici|ajoutez une brève description\b|remplacez ce (?:paragraphe|texte)\b|contenu à venir|titre d'exemple|saisissez .{0,30}ici|description de l'élément"
        r"|este es un texto de (?:relleno|ejemplo|muestra)\b|su texto aquí|escriba (?:algo|su texto) aquí|añada una breve descripción\b|agregue una breve descripción\b|sustituya este párrafo\b|reemplace este párrafo\b|contenido disponible próximamente|próximamente|título de ejemplo|descripción del (?:artículo|elemento))\b",
        re.IGNORECASE,
    ),
    "chrome": re.compile(
        r"^\W*(?:(?:back to top|help|home|documents?|menu|search|log ?in|loading|skip to content|logo|nach oben|hilfe|start|suche|menü|anmelden|dokumente|laden|haut de page|aide|accueil|rechercher|connexion|chargement|inicio|ayuda|buscar|menú|cargando|volver arriba|documentos|iniciar sesión)\b[\s\W]*)+$",
        re.IGNORECASE,
    ),
}
_ECHO = re.compile(r"\b([^\W\d_]{2,})(?:\W+\1\b){4,}", re.IGNORECASE)
_QUOTED = re.compile(r"[“\"„«‹][^“”\"„«»‹›\n]{3,120}[”\"“»›]")
_LEAD = re.compile(r"^(?:\W*(?:help|home|documents?|menu · search · login|back to top|loading…|\[logo\] skip to content|hilfe|aide|ayuda)\W+)+", re.IGNORECASE)
#: A first line with no end of a sentence, and more lines after it: a heading, that is no content of its own.
_TITLE = re.compile(r"\s*(?:[^\n]*[^\s.!?…:;,”\"»)\]][ \t]*(?=\n\s*\S))?")
MIN_SHARE, WORDS_PER_SLOT = 0.5, 300


def residue(text: str | None, min_share: float = MIN_SHARE) -> str | None:
    """The kind of residue in place of content: slot, filler, error, notice; None if there is none.

    Null, empty and blank texts have none. One slot makes a text of up to WORDS_PER_SLOT words
    residue, a longer one needs more; lines of the other kinds must be ``min_share`` of the characters.
    """
    if not text or not text.strip():
        return None
    words = _WORD.findall(text.lower())
    if len(slots(text)) * WORDS_PER_SLOT >= max(1, len(words)):
        return "slot"
    if not words:
        return None
    if len(words) >= 12 and sum(w in _FUNCTION for w in words) < 0.13 * len(words):
        kind = _by_words(text, min_share)
        if kind:
            return kind
    return _by_lines(text, words, min_share)


def necessary(pattern: re.Pattern[str]) -> set[str]:
    """Literals in lower case of which every match of ``pattern`` holds at least one, read from the pattern itself."""

    def best(sequence) -> set[str] | None:
        found, literal = [], ""
        for op, value in [*sequence, (None, None)]:
            if str(op) == "LITERAL":
                literal += chr(value).lower()
                continue
            if literal:
                found.append({literal})
                literal = ""
            if str(op) == "SUBPATTERN":
                found.append(best(value[3]))
            elif str(op) == "BRANCH":
                each = [best(b) for b in value[1]]
                found.append(set().union(*each) if all(each) else None)
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                found.append(best(value[2]))
        return max((f for f in found if f), key=lambda f: min(map(len, f)), default=None)

    found = best(re._parser.parse(pattern.pattern, pattern.flags))
    if not found:
        raise ValueError("a match need not hold any literal")
    return found


_built: list[ahocorasick.Automaton] = []


def _literals() -> ahocorasick.Automaton:
    """The automaton of the literals of all residue lines, built once in each process."""
    if not _built:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for kind in ("filler", "notice", "error"):
            for literal in necessary(_LINES[kind]):
                automaton.add_word(literal)
        automaton.make_automaton()
        _built.append(automaton)
    return _built[0]


def _by_lines(text: str, words: list[str], min_share: float) -> str | None:
    """The kind of the residue lines that make up most of a text. Lines without any literal that each residue line
    has can't be one, and are told by one pass over the text."""
    lower = text.lower().replace("ſ", "s")
    hits = [end for end, _ in _literals().iter(lower)]
    echoes = any(map(eq, words, words[1:]))
    if not hits and not echoes:
        return None
    every = len(lower) != len(text)
    breaks = [m.span() for m in _SENTENCE.finditer(text)]
    starts, ends = [0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(text)]
    hit = {bisect_right(starts, h) - 1 for h in hits}
    parts, total, most = [], 0, 0
    title = _TITLE.match(text).end()
    for k, (a, b) in enumerate(zip(starts, ends)):
        part = text[a:b].strip()
        if not part or part.startswith("#"):
            continue
        bare = _LEAD.sub("", part) or part
        if _LINES["chrome"].match(bare):
            continue
        total += len(bare)
        near = every or k in hit
        if b <= title and not (near and any(_LINES[kind].search(bare) for kind in ("filler", "notice", "error"))):
            total -= len(bare)
            continue
        if near or echoes:
            parts.append((bare, near))
            most += len(bare)
    if most < min_share * total:
        return None
    chars: dict[str, int] = {}
    for bare, near in parts:
        unquoted = _QUOTED.sub(" ", bare)
        kind = next((k for k in ("filler", "notice", "error") if near and _LINES[k].search(unquoted)), "echo" if echoes and _ECHO.search(unquoted) else "")
        if kind:
            chars[kind] = chars.get(kind, 0) + len(bare)
    if not chars or sum(chars.values()) < min_share * total:
        return None
    top = max(chars, key=lambda k: (chars[k], k))
    return "filler" if top == "echo" else top


def _by_words(text: str, min_share: float) -> str | None:
    """Filler in a made-up language: sentences without any function word or number, over a small vocabulary."""
    made_up, total, seen = 0, 0, set()
    for part in _SENTENCE.split(text):
        if not part or part.lstrip()[:1] in "#|":
            continue
        words = [w.lower() for w in _WORD.findall(part)]
        total += len(words)
        if len(words) >= 5 and not any(c.isdigit() for c in part) and not any(w in _FUNCTION for w in words) and sum(w[0].isupper() for w in part.split() if w) <= 2:
            made_up += len(words)
            seen.update(words)
    return "filler" if made_up >= 12 and made_up >= min_share * total and len(seen) <= max(30, 0.5 * made_up) else None


def detect(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind of the documents with residue in place of content; narrow, one pass, no shuffle.

    Null and blank texts are no cases; a document given twice is reported twice; other
    columns are not read. The whole text is looked at, however long.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [residue(t) for t in pdf.text]
            keep = [k is not None for k in kinds]
            yield pd.DataFrame({"doc_id": pdf.doc_id[keep], "kind": [k for k in kinds if k is not None]})

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").mapInPandas(skip_empty(look), "doc_id bigint, kind string")


def exclude(documents: DataFrame) -> DataFrame:
    """The documents without those that ``detect`` finds."""
    return documents.join(detect(documents).select("doc_id").distinct(), "doc_id", "left_anti")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return detect(table(spark, root, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Documents and characters with residue by source and kind."""
    documents = table(spark, root, "documents")
    return detect(documents).join(documents.select("doc_id", "source", "n_chars"), "doc_id").groupBy("source", "kind").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = {"p10_found": p10_found, "p10_kinds": p10_kinds}
