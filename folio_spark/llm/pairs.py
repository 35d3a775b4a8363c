"""Broken prompt and response pairs: empty, truncated, refused, copied, or in another language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.session import skip_empty, table

#: ISO 639 codes of three letters that stand for a code of two.
THREE = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl"}
GRAM_SLOTS, TAIL_SLOTS, TAIL_MAX = 1 << 14, 3 << 20, 9
#: For each length of a text's end the bits of its slot and the first slot: short ends have slots of their own.
TAIL_AT = [(18, 2 << 20), (18, (2 << 20) + (1 << 18)), (19, (2 << 20) + (1 << 19)), *[(21, 0)] * 6]
#: Slots in a row of counts, and characters counted at a time.
BLOCK, CHUNK = 2048, 2_000_000

_QUOTED = re.compile(r"[“„«][^“”„«»]*[”“»]|\"[^\"\n]*\"")
_ITEM = re.compile(r"^\s*(?:[-*•–·]|\d{1,3}[.)])\s+")
_UNIT = re.compile(r"[^\n]*?[.!?…](?=\s+[A-ZÀ-ÞÄÖÜ¿¡]|\s*$)|[^\n]+$", re.MULTILINE)


def language_code(label: str | None) -> str | None:
    """en for en, EN, en-GB, en_US and eng; None for null or blank."""
    base = re.split(r"[-_]", (label or "").strip().lower())[0]
    return THREE.get(base, base) or None


_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The letters of a text in lower case, with single blanks between and around them."""
    return " " + _NO_LETTERS.sub(" ", text.lower()).strip() + " "


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def gram_slots(texts: list[str]) -> np.ndarray:
    """Hash slots of the character 1-, 2- and 3-grams within each of some texts made of ``letters``."""
    texts = [t for t in texts if len(t) >= 4]
    if not texts:
        return np.zeros(0, np.int64)
    c, ends = codes("".join(texts)), np.cumsum([len(t) for t in texts])
    two, three = c[:-1] * 40503 + c[1:] * 69069 + 7, c[:-2] * 1640531527 + c[1:-1] * 97531 + c[2:] * 3266489917 + 13
    across = ends[:-1, None]
    grams = np.concatenate([c * 2654435761, np.delete(two, across - 1), np.delete(three, across - [1, 2])])
    return ((grams ^ (grams >> 15)) & 0x7FFFFFFF) % GRAM_SLOTS


_ODD = [(0x9E3779B97F4A7C15 * (2 * n + 1) * (2 * n + 3) | 1) % (1 << 64) for n in range(TAIL_MAX)]
_SPREAD = 0xFF51AFD7ED558CCD


def folded(c: str) -> int:
    """The code of a character in lower case; digits are made equal."""
    return ord("0") if c.isdecimal() else ord(c.lower()) if len(c.lower()) == 1 else ord(c)


def tail_slots(text: str) -> list[int]:
    """Hash slots of the last 1..TAIL_MAX characters of ``text``, digits and case made equal."""
    out, h = [], 0
    for c, odd, (bits, base) in zip(reversed(text[-TAIL_MAX:]), _ODD, TAIL_AT):
        h += (folded(c) + 1) * odd
        out.append((((h ^ ((h % (1 << 64)) >> 31)) * _SPREAD) % (1 << 64) >> 64 - bits) + base)
    return out


def endings(text: str) -> Iterator[tuple[str, int, int]]:
    """("prose" or "item", start, end): the sentences, and the list items without a final mark, of ``text``."""
    for m in _UNIT.finditer(text):
        unit = m.group().rstrip()
        if len(unit) < 20 or unit.lstrip()[:1] in "|#":
            continue
        if unit[-1] in ".!?":
            yield "prose", m.start(), m.start() + len(unit)
        elif _ITEM.match(unit) and unit[-1] not in "…:,(–-":
            yield "item", m.start(), m.start() + len(unit)


class TailCounts:
    """How often each ending, and each place inside that a text could break off at, occurs by its last characters.

    The last slot of a kind also counts its texts.
    """

    def __init__(self):
        self.counts = {k: np.zeros(TAIL_SLOTS, np.int64) for k in ("prose", "item", "inside")}
        self.known, self.blank = np.full(0x110000, -1, np.int64), np.zeros(0x110000, bool)

    def add(self, texts: list[str]) -> None:
        units, base = [], 0
        for t in texts:
            units += [(kind, base + a, base + b) for kind, a, b in endings(t)]
            base += len(t)
        if not units:
            return
        raw = codes("".join(texts))
        fold = self.known[raw]
        if (fold < 0).any():
            for c in np.unique(raw[fold < 0]).tolist():
                self.known[c], self.blank[c] = folded(chr(c)), chr(c).isspace()
            fold = self.known[raw]
        kinds, (starts, ends) = np.array([u[0] for u in units]), np.array([u[1:] for u in units], np.int64).T
        # Every place from the 8th character on to the 4th from the end, or the last character before it that is no blank.
        sizes = ends - starts - 11
        at = np.repeat(starts + 7 - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        at = np.maximum.accumulate(np.where(self.blank[raw], -1, np.arange(len(raw))))[at]
        length = at - np.repeat(starts, sizes) + 1
        groups = [("inside", at[length >= TAIL_MAX], TAIL_MAX), *(("inside", at[length == n], n) for n in range(1, TAIL_MAX)), *((k, ends[kinds == k] - 1, TAIL_MAX) for k in ("prose", "item"))]
        h, plain = np.zeros(len(raw), np.uint64), (fold + 1).astype(np.uint64)
        for n, (odd, (bits, base)) in enumerate(zip(_ODD, TAIL_AT)):
            h[n:] += plain[: len(raw) - n] * np.uint64(odd)
            slots = (((h ^ (h >> np.uint64(31))) * np.uint64(_SPREAD)) >> np.uint64(64 - bits)).astype(np.int64) + base
            for kind, places, most in groups:
                if n < most and len(places):
                    if len(places) > TAIL_SLOTS // 16:
                        self.counts[kind] += np.bincount(slots[places], minlength=TAIL_SLOTS)
                    else:
                        np.add.at(self.counts[kind], slots[places], 1)
        self.counts["inside"][-1] += len(at)
        for k in ("prose", "item"):
            self.counts[k][-1] += (kinds == k).sum()


@dataclass
class Model:
    """Character n-gram naive Bayes of languages, and n-gram likelihoods of how texts end."""

    langs: list[str] = field(default_factory=list)
    grams: np.ndarray = field(default_factory=lambda: np.zeros((0, GRAM_SLOTS)))
    tails: dict[str, np.ndarray] = field(default_factory=lambda: {k: np.zeros(TAIL_SLOTS, np.float32) for k in ("prose", "item", "inside")})

    def posteriors(self, text: str) -> dict[str, float]:
        """Log posteriors of the languages, prior equal; empty if the text has too few letters."""
        at = gram_slots([letters(text)])
        if not len(self.langs) or not len(at):
            return {}
        scores = self.grams[:, at].sum(1)
        top = scores.max()
        return dict(zip(self.langs, scores - top - np.log(np.exp(scores - top).sum())))

    def complete(self, text: str, kind: str) -> float:
        """Likelihood share of a text of this kind ending as it does, against breaking off there.

        The longest ending seen in training counts most; it can't have been seen more often than its own end, so
        what shares its slot counts no more than that. Prose ends with a mark: what its last
        character alone says is an upper bound.
        """
        ends, inside = self.tails[kind], self.tails["inside"]
        weight = max(1.0, ends[-1]) / max(1.0, inside[-1])
        p, most, e, i = 0.5, 1.0, float("inf"), float("inf")
        for n, at in enumerate(tail_slots(text.rstrip())):
            e, i = min(e, float(ends[at])), min(i, float(inside[at] * weight))
            if not e + i:
                break
            p = (e + 2 * p) / (e + i + 2)
            if n == 0 and kind == "prose":
                most = p
        return min(p, most)


def fit(documents: DataFrame) -> Model:
    """Train on all documents that carry a language label.

    Counts are made in the executors and added up by slot, in rows of BLOCK slots, so what leaves a task and what the
    driver gets is bounded by slots and languages whatever the texts' number and lengths. Languages with fewer
    than 1 % of the documents are left out: rare labels are typing errors more often than not.
    """
    labelled = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("lang", "text")

    def blocks(kind: str, lang: str, counts: np.ndarray) -> pd.DataFrame:
        rows = counts.reshape(-1, min(BLOCK, len(counts)))
        some = np.flatnonzero(rows.any(1))
        return pd.DataFrame({"kind": kind, "lang": lang, "block": some, "counts": [rows[k].tobytes() for k in some]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: dict[str, int] = {}
        grams: dict[str, np.ndarray] = {}
        tails = TailCounts()
        for pdf in batches:
            code = pdf.lang.map({x: language_code(x) for x in pdf.lang.unique()})
            part = pdf.text.str.len().cumsum() // CHUNK
            for _, own in pdf.text.groupby(part):
                tails.add(own.tolist())
            for (lang, _), own in pdf.text.groupby([code, part]):
                docs[lang] = docs.get(lang, 0) + len(own)
                grams[lang] = grams.get(lang, 0) + np.bincount(gram_slots([letters(t) for t in own]), minlength=GRAM_SLOTS)
        for lang, n in docs.items():
            yield blocks("docs", lang, np.array([n], np.int64))
            yield blocks("gram", lang, grams[lang])
        for kind, counts in tails.counts.items():
            yield blocks(kind, "", counts)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for kind, lang, block, raw in zip(pdf.kind, pdf.lang, pdf.block, pdf.counts):
                n = np.frombuffer(raw, np.int64)
                totals[kind, lang, block] = totals[kind, lang, block] + n if (kind, lang, block) in totals else n
        yield pd.DataFrame([(*k, (n if k[0] in ("docs", "gram") else n.astype(np.float32)).tobytes()) for k, n in totals.items()], columns=["kind", "lang", "block", "counts"])

    schema = "kind string, lang string, block int, counts binary"
    rows = labelled.mapInPandas(skip_empty(count), schema).repartition("kind", "lang", "block").mapInPandas(skip_empty(added), schema).toPandas()
    model = Model()
    docs = {r.lang: int(np.frombuffer(r.counts, np.int64)[0]) for r in rows[rows.kind == "docs"].itertuples()}
    model.langs = sorted(k for k, n in docs.items() if n >= 0.01 * max(1, sum(docs.values())))
    model.grams = np.zeros((len(model.langs), GRAM_SLOTS))
    for r in rows[rows.kind != "docs"].itertuples():
        if r.kind != "gram":
            model.tails[r.kind][r.block * BLOCK :][:BLOCK] = np.frombuffer(r.counts, np.float32)
        elif r.lang in model.langs:
            model.grams[model.langs.index(r.lang), r.block * BLOCK :][:BLOCK] = np.frombuffer(r.counts, np.int64)
    model.grams = np.log((model.grams + 0.5) / (model.grams.sum(1, keepdims=True) + 0.5 * GRAM_SLOTS)) if model.langs else model.grams
    return model


_LABEL = re.compile(r"^[\W_]*(?:a|answer|response|reply|antwort|réponse|reponse|respuesta|assistant|output|r)\s*[:：][\W_]*$", re.IGNORECASE)
_NOTHING = re.compile(
    r"^[\W_]*(?:n ?/ ?a|n\.a|none|null|nil|nan|undefined|empty|blank|tbd|tba|todo|no (?:answer|response|reply|content|data)(?: (?:given|provided|available|found))?|not available|leer|keine (?:antwort|angabe)|ohne antwort|vide|aucune réponse|sans réponse|pas de réponse|vacío|sin respuesta|ninguna respuesta)[\W_]*$",
    re.IGNORECASE,
)


def is_empty(answer: str | None) -> bool:
    """Null, blank, without a letter or digit, only a label, or a word that stands for nothing."""
    return answer is None or not re.search(r"[^\W_]", answer) or bool(_LABEL.match(answer) or _NOTHING.match(answer))


_REFUSALS = re.compile(
    r"\bi(?:['’]m| am) (?:sorry|unable|not (?:able|in a position|allowed|permitted))|\bi (?:cannot|can['’]?t|can not|won['’]t|will not|must decline|have to decline|decline|refuse|do not wish)\b|\bi(?:['’]d| would) (?:rather|prefer) not\b"
    r"|\b(?:my|our) (?:guidelines|policy|policies|instructions) (?:do not|don['’]t|forbid|prevent)|\bnot something i\b|\boutside what i\b|\bnot possible for me\b|\bby me\b.{0,5}$|\bas an? (?:ai|language model|assistant)\b.{0,30}\bi\b"
    r"|\b(?:unfortunately|apologies|sorry),? i\b"
    r"|\b(?:kann|darf|möchte|werde|will) ich\b.{0,80}\b(?:nicht|keine?n?)\b|\bich (?:kann|darf|möchte|werde|bin|muss|lehne)\b.{0,80}\b(?:nicht|keine?n?|ab|ablehnen|außerstande|außer stande)\b|\bals (?:ki|sprachmodell|ki-assistent|assistent)\b.{0,40}\bich\b|\baußerhalb dessen, was ich\b|\btut mir leid\b|\bist (?:es )?mir (?:leider )?nicht\b"
    r"|\bje (?:ne peux|ne suis|ne souhaite|ne veux|préfère ne|dois refuser|refuse|regrette|suis désolée?|suis dans l['’]impossibilité)|\b(?:il )?m['’]est impossible\b|\bce que je suis autorisée?\b|\bme permettent pas\b|\ben tant qu['’](?:assistant|ia)\b.{0,20}\bje\b|\bje .{0,20}pas en mesure"
    r"|\b(?:no puedo|no podré|no me es posible|no estoy (?:en condiciones|autorizad[oa])|debo (?:negarme|rechazar|declinar)|prefiero no|lo siento|me es imposible|me niego|me está permitido)\b|\bcomo (?:asistente|ia|modelo)\b.{0,10}\bno\b",
    re.IGNORECASE,
)


#: "I cannot recommend it enough" declines nothing.
_PRAISE = re.compile(r"\b(?:enough|too (?:much|highly|strongly|often)|genug|genügend|assez|trop|(?:lo )?suficiente(?:mente)?|demasiado)\b", re.IGNORECASE)
_SENTENCES = re.compile(r"(?<=[.!?…])\s+|\n+")
REFUSED_SHARE, SHORT_ANSWER = 0.4, 3


def is_refusal(answer: str) -> bool:
    """The speaker, in the first person and outside quotes, declines to answer; and little else is said.

    Sentences that decline make up REFUSED_SHARE of the answer without closing questions, or an answer of up to
    SHORT_ANSWER sentences, of any length, comes to that at its end.
    """
    said = [s for s in _SENTENCES.split(_QUOTED.sub(" ", answer).strip()) if s.strip()]
    while len(said) > 1 and said[-1].rstrip().endswith("?"):
        said.pop()
    declines = [bool(_REFUSALS.search(s)) and not _PRAISE.search(s) for s in said]
    if not any(declines):
        return False
    share = sum(len(s) for s, d in zip(said, declines) if d) / sum(map(len, said))
    return share >= REFUSED_SHARE or (declines[-1] and len(said) <= SHORT_ANSWER)


_TOKEN = re.compile(r"[^\W_]+")
_COPY_MARK = re.compile(r"^[\W_]*(?:q|question|frage|pregunta|prompt|user|instruction|task|aufgabe)\s*[:：]\s*", re.IGNORECASE)


def is_copied(question: str, answer: str) -> bool:
    """The answer's words are nearly all the question's, in its order, once or several times over."""
    asked, said = [w.lower() for w in _TOKEN.findall(question)], [w.lower() for w in _TOKEN.findall(_COPY_MARK.sub("", answer))]
    if len(asked) < 3 or not said:
        return False
    known = set(asked)
    if sum(w in known for w in said) < 0.8 * len(said):
        return False
    if len(set(said) & known) < 0.7 * len(known):
        return False
    pairs = set(zip(asked, asked[1:]))
    kept = sum(p in pairs for p in zip(said, said[1:]))
    return kept >= 0.6 * max(1, len(said) - 1)


_TRANSLATE = re.compile(
    r"\b(?:translat\w*|übersetz\w*|tradui\w*|traduc\w*|traduz\w*|traducción)\b|\b(?:rewrite|give|say|write|put|answer|respond|reply|repeat|express)\b.{0,60}\b(?:in|into|to) (?:english|german|french|spanish|italian|portuguese|dutch)\b"
    r"|\b(?:auf|ins) (?:deutsche?|englische?|französische?|spanische?)\b|\ben (?:anglais|allemand|français|espagnol|inglés|alemán|francés|español)\b|\bal (?:inglés|alemán|francés|español)\b",
    re.IGNORECASE,
)
MARGIN, MIN_LETTERS = 6.0, 12


def is_other_language(model: Model, question: str, answer: str) -> bool:
    """The posteriors of question and answer, without their quotations, favour different languages clearly."""
    if _TRANSLATE.search(question):
        return False
    asked, said = _QUOTED.sub(" ", question), _QUOTED.sub(" ", answer)
    names = re.compile(r"\b[A-Z][\w'’]*(?: [A-Z][\w'’]*)+")
    asked, said = names.sub(" ", asked), names.sub(" ", said)
    if sum(c.isalpha() for c in said) < MIN_LETTERS or sum(c.isalpha() for c in asked) < MIN_LETTERS:
        return False
    p, r = model.posteriors(asked), model.posteriors(said)
    if len(p) < 2 or len(r) < 2:
        return False
    a, b = max(p, key=p.get), max(r, key=r.get)
    return a != b and r[b] - r[a] >= MARGIN and p[a] - p[b] >= MARGIN / 2


_VALUE = re.compile(r"^[\W_]*(?:[^\W\d_]+[,.]?\s+){0,4}[\d.,\s%]*\d%?(?:\s+[^\W\d_]+){0,2}[\W_]*$")
_STOPS = frozenset("the a an of in to for at by with and der die das den dem ein eine und in im zu von mit auf le la les l de des du à au et en dans el los las un una y del al por con hasta um".split())
THRESHOLD = {"prose": 0.5, "item": 0.06}


def is_truncated(model: Model, answer: str) -> bool:
    """The text ends as texts end that break off inside a sentence, list item or table row."""
    text = answer.rstrip().rstrip("*_ ")
    last = text.rsplit("\n", 1)[-1]
    words = _TOKEN.findall(text)
    if last.lstrip().startswith("|"):
        rows = [x for x in text.split("\n") if x.lstrip().startswith("|")]
        return not last.rstrip().endswith("|") or last.count("|") != rows[0].count("|")
    if text[-1] in "…:,;(–—-[{„“«‘/&" or text.endswith("..."):
        return True
    body = text.rstrip("\"'”’»)]")
    if body[-1:] in (".", "!", "?") and len(words) > 4:
        return model.complete(body, "prose") < 0.1
    if len(words) <= 5 and (_VALUE.match(text) or body[-1:] in (".", "!", "?")) and words[-1].lower() not in _STOPS:
        return False
    if len(words) <= 2 and words[-1].lower() not in _STOPS and len(text) >= 2 and not re.search(r"\n", text):
        return False
    if _ITEM.match(last):
        others = [x.rstrip() for x in text.split("\n")[:-1] if _ITEM.match(x)]
        if any(x[-1:] in ".!?" for x in others):
            return True
        return model.complete(text, "item") < THRESHOLD["item"]
    return model.complete(text, "prose") < THRESHOLD["prose"]


def defect(model: Model, question: str | None, answer: str | None) -> str | None:
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if question and is_copied(question, answer):
        return "copied"
    if question and is_other_language(model, question, answer):
        return "language"
    return "truncated" if is_truncated(model, answer) else None


def record_defect(model: Model, messages: list | None) -> str | None:
    """The first defect of a record's turns; each assistant message answers the user message before it.

    A record without messages, or without an assistant message, has no answer that could be
    broken and no defect; an assistant message without a question before it is still looked
    at for emptiness, refusal and truncation.
    """
    question = None
    for m in messages if messages is not None else []:
        if m is None:
            continue
        if m["role"] == "user":
            question = m["content"]
        elif m["role"] == "assistant" and (found := defect(model, question, m["content"])):
            return found
    return None


def broken_pairs(records: DataFrame, model: Model) -> DataFrame:
    """pair_id, defect of the defective records; narrow, no shuffle. Records given twice come out twice."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [record_defect(model, m) for m in pdf.messages]
            keep = [k is not None for k in found]
            yield pd.DataFrame({"pair_id": pdf.pair_id[keep], "defect": [k for k in found if k is not None]})

    return records.select("pair_id", "messages").where("messages IS NOT NULL").mapInPandas(skip_empty(look), "pair_id bigint, defect string")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return broken_pairs(table(spark, root, "sft"), fit(table(spark, root, "documents")))


def p3_by_generator(spark: SparkSession, root: str) -> DataFrame:
    sft = table(spark, root, "sft")
    found = broken_pairs(sft, fit(table(spark, root, "documents")))
    return sft.select("pair_id", "generator").join(found, "pair_id", "left").groupBy("generator").agg(
        F.count("*").alias("records"), *[F.count_if(F.col("defect") == k).alias(k) for k in ("empty", "truncated", "refusal", "copied", "language")]
    )


QUERIES = {"p3_found": p3_found, "p3_by_generator": p3_by_generator}
