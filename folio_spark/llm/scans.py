"""Noise in text from scanned pages: broken words, misread characters, running headers, page numbers.

Lines are labelled header, number, body or break by a hidden Markov model over layout
features; the labels say which lines go and how the rest is joined into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.session import materialize, most_frequent, skip_empty, table

MAX_WORDS, MIN_WORD_COUNT, MAX_TRAINING_PAGES, MIN_KEY = 200_000, 3, 2000, 4
ROWS_PER_TASK, MAX_TASKS = 2000, 10_000
HEADER, NUMBER, BODY, BREAK = "header", "number", "body", "break"
STATES = (HEADER, NUMBER, BODY, BREAK)
HYPHENS = "-‐­¬‑"

_STRIP = " \t\r.,;:!?…\"'“”„‘’«»‹›()[]{}*_#>–—·•/\\"
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_PAGE_WORD = re.compile(r"[\W_]*(?:page|pages|p|pg|seite|s|página|pagina|pág|pag|folio|blatt|hoja)\b", re.IGNORECASE)
_ROMAN = re.compile(r"[\W_]*(?:[ivxlc]{1,7}|[IVXLC]{1,7})[\W_]*")
#: Characters that recognition confuses, each group made one sign; pairs first.
PAIRS = (("rn", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
ONE = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "r": "i", "j": "i", "5": "s", "$": "s", "8": "b", "6": "b", "9": "g", "q": "g", "@": "a", "4": "a", "c": "e", "3": "e", "é": "e", "è": "e", "ê": "e", "f": "t", "7": "t", "2": "z", "h": "b"})
_SIGNS = "0123456789@|!$ﬁﬂﬀﬃﬄ"
_MAYBE = re.compile(r"[^\W\d_][\w@|!$]*[^\W_]|[\d@|!$][^\W\d_][\w@|!$]*", re.UNICODE)


def skeleton(word: str) -> str:
    """What is left of a word's form once confusable characters are made equal."""
    w = word.lower()
    for a, b in PAIRS:
        w = w.replace(a, b)
    return w.translate(ONE).replace("m", "iii").replace("d", "ei").replace("u", "ii").replace("w", "vv")


def words_of(token: str) -> str | None:
    """The plain lower-case word in a blank-separated token; None if it isn't one of letters."""
    w = token.strip(_STRIP).lower()
    return w if len(w) > 1 and _WORD.fullmatch(w) else None


def lexicon(texts: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_WORD_COUNT) -> dict[str, int]:
    """The ``max_words`` most frequent words of all ``texts`` (column text) with their counts.

    Counted over every row; the bound on its size is what lets the result go to every task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: Counter = Counter()

        def flush() -> pd.DataFrame:
            words: Counter = Counter()
            for token, n in tokens.items():
                if w := words_of(token):
                    words[w] += n
            tokens.clear()
            return pd.DataFrame({"word": list(words), "n": list(words.values())}, columns=["word", "n"])

        for pdf in batches:
            for t in pdf.text:
                tokens.update(t.split())
            if len(tokens) > 500_000:
                yield flush()
        yield flush()

    totals = texts.select("text").where("text IS NOT NULL").mapInPandas(skip_empty(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = most_frequent(totals.where(F.col("n") >= min_count), "n", max_words).toPandas()
    return dict(zip(rows.word, (int(n) for n in rows.n)))


@dataclass
class Words:
    """A lexicon of clean text, and one of the scanned texts for words found only there, each
    with an index of skeletons; remembers what it said of a token."""

    counts: dict[str, int]
    scanned: dict[str, int] = field(default_factory=dict)
    forms: dict[str, str] = field(default_factory=dict)
    others: dict[str, str] = field(default_factory=dict)
    known: dict[str, str | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for w, n in self.counts.items():
            s = skeleton(w)
            if s not in self.forms or n > self.counts[self.forms[s]]:
                self.forms[s] = w
        for w, n in self.scanned.items():
            s = skeleton(w)
            if s not in self.forms and (s not in self.others or n > self.scanned[self.others[s]]):
                self.others[s] = w

    def reading(self, token: str) -> str | None:
        """The word that ``token`` is a misreading of, in lower case; None if it isn't one."""
        if token not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[token] = self._reading(token.lower())
        return self.known[token]

    def _reading(self, w: str) -> str | None:
        if len(w) < 2 or not any(c.isalpha() for c in w):
            return None
        own = self.counts.get(w, 0)
        best = self.forms.get(skeleton(w))
        if best is None and (other := self.others.get(skeleton(w))) and other != w:
            return other if self.scanned[other] >= 10 + 10 * self.scanned.get(w, 0) and (any(c in _SIGNS for c in w) or _plain(w, other)) else None
        if best is None or best == w:
            return None
        if any(c in _SIGNS for c in w):
            return best if sum(c in _SIGNS for c in w) <= max(1, len(w) // 2) and (len(w) > 2 or self.counts[best] >= 1000) else None
        return best if len(w) > 2 and self.counts[best] >= max(10, 300 * own) and _plain(w, best) else None


def _plain(w: str, best: str) -> bool:
    """Whether an all-letter form differs from a word as misreadings do, and not by an accent or its ending alone."""
    if len(w) == len(best):
        diff = [(a, b) for a, b in zip(w, best) if a != b]
        return 0 < len(diff) <= max(2, len(w) // 4) and all({a, b} in ({"c", "e"}, {"r", "i"}, {"t", "f"}, {"l", "i"}, {"h", "b"}, {"q", "g"}, {"i", "j"}) for a, b in diff)
    return True


def header_key(line: str) -> str:
    """Equal for the same heading in other capitals, spacing, misreadings, or with another number on its line."""
    parts = [p for p in re.split(r"[\s|·–—/:.,-]+", line) if any(c.isalpha() for c in p) and not re.fullmatch(r"[ivxlc]{1,6}", p)]
    return skeleton("".join(parts))


def edges(text: str) -> list[int]:
    """Indexes of the lines at the top and bottom where a heading can stand."""
    filled = [k for k, line in enumerate(text.split("\n")) if line.strip()]
    return sorted({*filled[:2], *filled[-2:]})


def features(lines: list[str], k: int, filled: list[int], repeated: bool) -> tuple:
    """Layout features of a line: its place; digits, letters and form; separators and capitals; whether its heading is on another page; how it begins and ends.

    None of them says what the line is: that is the model's to weigh.
    """
    s = lines[k].strip()
    if not s:
        return ("blank", "-", "-", "-", "-")
    place = "first" if k == filled[0] else "last" if k == filled[-1] else "second" if k == filled[1] else "last but one" if k == filled[-2] else "inner"
    solid = [c for c in s if not c.isspace()]
    digits, letters, words = sum(c.isdigit() for c in solid), sum(c.isalpha() for c in solid), len(s.split())
    form = "roman" if _ROMAN.fullmatch(s) else "page" if words < 5 and _PAGE_WORD.match(s) else "other"
    share = digits / len(solid)
    much = "most" if form == "page" and words > 1 else "percent" if "%" in s else "none" if not digits else "some" if share < 0.2 else "many" if share < 0.6 else "most"
    long = next((n for n in (60, 25, 7, 3, 1) if letters >= n), 0)
    mark = "bar" if re.search(r"\s[|·]\s", s) else "dash" if re.search(r"\s[–—/]\s", s) else "colon" if re.search(r":\s", s) else "gap" if re.search(r"\S {2,}\S", s) else "none"
    names = [w for w in re.findall(r"[^\W\d_]+", s) if len(w) > 3]
    upper = sum(w[0].isupper() for w in names)
    capitals = "none" if not names else "all" if all(w.isupper() for w in names) else "title" if len(names) > 1 and 2 * upper >= len(names) else "other"
    begin = "lower" if s[0].islower() else "upper" if s[0].isupper() else "digit" if s[0].isdigit() else "sign"
    end = "stop" if s[-1] in ".!?;" else "comma" if s[-1] in ",:" else "hyphen" if s[-1] in HYPHENS else "digit" if s[-1].isdigit() else "letter" if s[-1].isalpha() else "sign"
    return (place, f"{much} {long} {form}", f"{mark} {capitals}", repeated and place != "inner", f"{begin} {end}")


@dataclass
class Layout:
    """First-order hidden Markov model of line states with independent categorical features."""

    start: dict[str, float] = field(default_factory=dict)
    step: dict[tuple[str, str], float] = field(default_factory=dict)
    emit: dict[tuple[str, int, object], float] = field(default_factory=dict)
    floor: float = log(1e-4)

    @classmethod
    def from_counts(cls, counts: Counter) -> "Layout":
        """Additively smoothed maximum likelihood; counts as ``tally`` makes them."""
        model = cls()
        totals: Counter = Counter()
        for (kind, a, *_), n in counts.items():
            totals[kind, a if kind != "start" else ""] += n
        values: dict[int, set] = {}
        for (kind, a, *rest) in counts:
            if kind == "emit":
                values.setdefault(rest[0], set()).add(rest[1])
        for s in STATES:
            model.start[s] = log((counts["start", s] + 0.5) / (totals["start", ""] + 2))
            for t in STATES:
                model.step[s, t] = log((counts["step", s, t] + 0.5) / (totals["step", s] + 2))
            for at, vs in values.items():
                n = sum(counts["emit", s, at, v] for v in vs)
                for v in vs:
                    model.emit[s, at, v] = log((counts["emit", s, at, v] + 0.02) / (n + 0.02 * len(vs)))
        return model

    def label(self, rows: list[tuple]) -> list[str]:
        """Viterbi's most likely states of the lines with these features."""
        if not rows:
            return []
        score = {s: self.start[s] + self._emission(s, rows[0]) for s in STATES}
        back = []
        for row in rows[1:]:
            came = {t: max(STATES, key=lambda s: score[s] + self.step[s, t]) for t in STATES}
            score = {t: score[came[t]] + self.step[came[t], t] + self._emission(t, row) for t in STATES}
            back.append(came)
        state = max(STATES, key=score.get)
        path = [state]
        for came in reversed(back):
            state = came[state]
            path.append(state)
        return path[::-1]

    def _emission(self, state: str, row: tuple) -> float:
        return sum(self.emit.get((state, k, v), self.floor) for k, v in enumerate(row))


def seed_label(row: tuple) -> str | None:
    """A line's first label for training, where its features leave no doubt; None where they do. Pages with such a line aren't trained on."""
    place, form, marks, repeated, ends = row
    if place == "blank":
        return BREAK
    if place in ("first", "last") and not ends.endswith("stop") and (form.endswith("roman") or form in ("most 0 other", "most 1 page", "most 3 page", "many 0 other")):
        return NUMBER
    if repeated and not ends.endswith("stop") and (not marks.startswith("none") or marks.endswith("all")):
        return HEADER
    return None if repeated else BODY


def tally(rows: list[tuple], labels: list[str]) -> Counter:
    counts: Counter = Counter()
    for k, (row, s) in enumerate(zip(rows, labels)):
        counts["start" if not k else "step", *((s,) if not k else (labels[k - 1], s))] += 1
        counts.update(("emit", s, at, v) for at, v in enumerate(row))
    return counts


def page_rows(text: str, repeated: set[int]) -> tuple[list[str], list[tuple]]:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    filled = [k for k, line in enumerate(lines) if line.strip()]
    return lines, [features(lines, k, filled, k in repeated) for k in range(len(lines))]


def fit_layout(pages: DataFrame, max_pages: int = MAX_TRAINING_PAGES) -> Layout:
    """Train on at most ``max_pages`` pages (those with the smallest hash of the id).

    Seeded labels of the pages without doubtful lines are counted, a model is fitted, and its own labels of
    all these pages are counted twice more; counts are made in the executors, and only sums over states and features return.
    """
    ids = pages.where("text IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    sample = materialize(pages.where("text IS NOT NULL").join(F.broadcast(ids), "page_id", "left_semi").select("text", "repeated"), "p7-layout")

    def counted(model: Layout | None) -> Counter:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: Counter = Counter()
            for pdf in batches:
                for text, repeated in zip(pdf.text, pdf.repeated):
                    _, rows = page_rows(text, set(repeated if repeated is not None else ()))
                    labels = model.label(rows) if model else [seed_label(r) for r in rows]
                    if None not in labels:
                        total += tally(rows, labels)
            yield pd.DataFrame([(repr(k), n) for k, n in total.items()], columns=["key", "n"])

        import ast

        rows = sample.mapInPandas(skip_empty(run), "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()
        return Counter({ast.literal_eval(r.key): r.n for r in rows})

    base = tally(page_rows(_PRIOR, {1})[1], [NUMBER, HEADER, BODY, BODY, BREAK, BODY, BODY, NUMBER])
    model = Layout.from_counts(counted(None) + base)
    for _ in range(2):
        model = Layout.from_counts(counted(model) + base)
    return model


#: One page by which a model has each state and step, even without a page to train on.
_PRIOR = "- 7 -\nAny Works | Annual report\nThe first line of a paragraph, which goes on here\nand ends with a stop.\n\nAnother paragraph is bro-\nken at the end of its line.\n12"


#: Words after a hyphen that stands for the rest of a compound (pre- and post-).
_LINKS = frozenset("and or to und oder bis et ou à y e o u a".split())


def joins(left: str, right: str, words: Words) -> str | None:
    """The whole word if the end of ``left`` and the beginning of ``right`` are one word broken by a hyphen."""
    a, b = re.search(r"([^\W_][\w@|!$'’]*)[%s]$" % HYPHENS, left), re.match(r"\s*([^\W\d_A-ZÀ-Þ][\w@|!$]*|[@|!$01][\w@|!$]*)", right)
    if not a or not b:
        return None
    head, tail = a.group(1), b.group(1)
    whole, parted = (head + tail).lower(), f"{head}-{tail}".lower()
    whole_n, parted_n = words.counts.get(whole, 0), words.counts.get(parted, 0)
    if whole_n or parted_n:
        return head + tail if whole_n > parted_n else None
    if words.forms.get(skeleton(whole)):
        return head + tail
    if left[-1] == "-" and (tail.lower() in _LINKS or all(words.counts.get(w, 0) + words.scanned.get(w, 0) >= 10 for w in (head.lower(), tail.lower()))):
        return None
    return head + tail


def read_page(text: str, repeated: set[int], whole_page: bool, layout: Layout, words: Words) -> tuple[set[str], str]:
    """The kinds of noise in a text and the text repaired into paragraphs.

    Headers and page numbers are only looked for on whole pages; their lines are dropped. What looks like a header
    is one if its heading is on another page of the document too. A
    blank line ends a paragraph if the line before it ends a sentence or the next one begins
    like one. Words broken over a line end are joined and misread words replaced, keeping
    their capitals. The empty text has no noise and stays empty.
    """
    noise: set[str] = set()
    lines, rows = page_rows(text, repeated)
    labels = layout.label(rows) if whole_page else [BREAK if r[0] == "blank" else BODY for r in rows]
    body: list[str] = []
    paragraphs: list[list[str]] = [[]]
    gap = False
    for k, (line, label) in enumerate(zip(lines, labels)):
        if label == HEADER and k in repeated:
            noise.add("running_header")
        elif label == NUMBER:
            noise.add("page_number")
        elif label == BREAK or not line.strip():
            gap = True
        else:
            s = line.strip()
            before = paragraphs[-1][-1] if paragraphs[-1] else ""
            ends = not before or before[-1] in ".!?:;…\"”»)|" or not (s[0].islower() or s[0].isdigit() or before[-1] in HYPHENS + ",")
            if (gap and ends and before) or (before and re.match(r"(?:[-*•–]|\d{1,3}[.)]|#{1,6}|\|)\s", s)):
                paragraphs.append([])
            paragraphs[-1].append(s)
            gap = False
    out = []
    for part in paragraphs:
        text_ = ""
        for s in part:
            if text_ and text_[-1] in HYPHENS and (whole := joins(text_, s, words)):
                noise.add("hyphenation")
                at = re.search(r"[^\W_][\w@|!$'’]*[%s]$" % HYPHENS, text_).start()
                rest = re.match(r"\s*[\w@|!$]*", s).end()
                text_ = text_[:at] + whole + s[rest:]
            else:
                keep = text_ and text_[-1] in HYPHENS and re.search(r"\w[-‐]$", text_) and s[:1].islower() and not re.search(r"\b(?:pre|post|sub|non|vor|nach|haupt|avant|après)-$", text_)
                text_ = text_ + ("" if not text_ or keep else " ") + s
        out.append(text_)

    def fix(m: re.Match) -> str:
        word = m.group()
        right = words.reading(word)
        if right is None:
            return word
        noise.add("misread")
        return right.upper() if word.isupper() and len(word) > 1 else right.capitalize() if word[:1].isupper() else right

    repaired = "\n\n".join(_MAYBE.sub(fix, p) for p in out if p)
    return noise, repaired


def scan_fields(pages: DataFrame, doc_outputs: DataFrame) -> DataFrame:
    """page_id, field_name, text, repeated: the texts to read, with the lines at page edges whose
    heading is on another page (another ``pos``) of the same document too."""
    scanned = doc_outputs.where("get_json_object(metadata, '$.source_type') = 'scan'").select("document_id").distinct()
    text = pages.where("text IS NOT NULL AND page_id IS NOT NULL").select("page_id", "document_id", "pos", "text").join(scanned, "document_id", "left_semi")
    text = materialize(text, "p7-pages")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, doc, pos, t in zip(pdf.page_id, pdf.document_id, pdf.pos, pdf.text):
                lines = t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                for k in edges("\n".join(lines)):
                    key = header_key(lines[k])
                    if len(key) >= MIN_KEY:
                        rows.append((page, doc, pos, k, key))
            yield pd.DataFrame(rows, columns=["page_id", "document_id", "pos", "line", "key"])

    at = text.mapInPandas(skip_empty(keys), "page_id bigint, document_id string, pos double, line int, key string")
    often = at.groupBy("document_id", "key").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).where("a < b").select("document_id", "key")
    repeated = at.join(often, ["document_id", "key"]).groupBy("page_id").agg(F.collect_set("line").alias("repeated"))
    whole = text.join(repeated, "page_id", "left").select("page_id", F.lit("text").alias("field_name"), "text", "repeated")
    image = pages.where("image_text IS NOT NULL AND page_id IS NOT NULL").select("page_id", F.lit("image_text").alias("field_name"), F.col("image_text").alias("text"), F.lit(None).cast("array<int>").alias("repeated"))
    return whole.unionByName(image)


def read_scans(pages: DataFrame, doc_outputs: DataFrame) -> DataFrame:
    """page_id, field_name, noise (sorted array), repaired: every scanned text, noisy or not.

    Null texts and null page ids give no row; a page given twice gives two. Without any
    scanned document only ``image_text`` is read. The lexicon is counted on the texts of all
    pages that are not scanned, or on all pages where every document is a scan.
    """
    kinds = doc_outputs.select("document_id", (F.get_json_object("metadata", "$.source_type") == "scan").alias("scan")).groupBy("document_id").agg(F.max("scan").alias("scan"))
    clean = pages.select("document_id", "text").join(kinds.where("scan"), "document_id", "left_anti")
    counts = lexicon(clean) or lexicon(pages)
    fields = materialize(scan_fields(pages, doc_outputs), "p7-fields")
    layout = fit_layout(fields.where("field_name = 'text'"))
    shared = fields.sparkSession.sparkContext.broadcast((counts, lexicon(fields, min_count=10)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(*shared.value)
        for pdf in batches:
            found = [read_page(t, set(r if r is not None else ()), f == "text", layout, words) for t, r, f in zip(pdf.text, pdf.repeated, pdf.field_name)]
            yield pd.DataFrame({"page_id": pdf.page_id, "field_name": pdf.field_name, "noise": [sorted(n) for n, _ in found], "repaired": [t for _, t in found]})

    # Reading is long for its bytes: tasks of equal numbers of rows, whatever files they lie in.
    parts = min(MAX_TASKS, max(2 * fields.sparkSession.sparkContext.defaultParallelism, fields.count() // ROWS_PER_TASK))
    return fields.repartition(parts, "page_id", "field_name").mapInPandas(skip_empty(read), "page_id bigint, field_name string, noise array<string>, repaired string")


def _read(spark: SparkSession, root: str) -> DataFrame:
    return read_scans(table(spark, root, "pages"), table(spark, root, "doc_outputs"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root).select("page_id", "field_name", F.explode("noise").alias("noise"))


def p7_repaired(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root).select("page_id", "field_name", "repaired")


QUERIES = {"p7_found": p7_found, "p7_repaired": p7_repaired}
