"""Model-dependent stages: summaries and vision through providers, with budgets, retries and fallbacks.

A provider is called once per row inside ``mapInPandas``; rows that need no call never leave
the JVM. A task may be tried again, and its calls with it, so results are written to a table
keyed by page before anything reads them twice, and done keys are skipped by an anti join.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.functions import pages as P
from folio_spark.functions.text import strip
from folio_spark.session import skip_empty


@dataclass(frozen=True)
class Answer:
    text: str
    tokens: int = 0


class Provider(ABC):
    """A model behind one call. Must be picklable, and safe to call again with the same prompt."""

    @abstractmethod
    def ask(self, kind: str, prompt: str, tier: int = 1) -> Answer:
        """kind: notes, score, topics, synthesis, insight, classify or extract."""


class Stub(Provider):
    """Deterministic: notes are the first line of the context, the score is given, topics its long words."""

    def __init__(self, score: str = "92%", tokens: int = 1, classify: str = "YES"):
        self.score, self.tokens, self.verdict = score, tokens, classify

    def ask(self, kind: str, prompt: str, tier: int = 1) -> Answer:
        context = prompt.split("\n\n", 1)[-1]
        if kind == "score":
            return Answer(self.score, self.tokens)
        if kind == "classify":
            return Answer(self.verdict, self.tokens)
        if kind == "topics":
            return Answer("\n".join(sorted({w.strip(".,;:").lower() for w in context.split() if len(w) > 7})[:5]), self.tokens)
        return Answer("- " + (context.splitlines() or [""])[0], self.tokens)


class Retrying(Provider):
    """Another provider with up to ``tries`` tries and a delay that doubles up to a limit."""

    def __init__(self, inner: Provider, tries: int = 3, delay: float = 2.0, longest: float = 8.0, sleep=time.sleep):
        self.inner, self.tries, self.delay, self.longest, self.sleep = inner, tries, delay, longest, sleep

    def ask(self, kind: str, prompt: str, tier: int = 1) -> Answer:
        for k in range(self.tries):
            try:
                return self.inner.ask(kind, prompt, tier)
            except Exception:
                if k + 1 == self.tries:
                    raise
                self.sleep(min(self.longest, self.delay * 2**k))
        raise AssertionError


@dataclass(frozen=True)
class Policy:
    """When a summary is good enough and when to stop trying."""

    attempts: int = 30
    max_tokens: int = 100_000
    max_seconds: int = 300

    def threshold(self, attempt: int) -> int:
        return 90 if attempt <= 5 else 85

    def tier(self, attempt: int) -> int:
        return 1 if attempt <= 10 else 2 if attempt <= 20 else 3

    def band(self, attempt: int) -> tuple[int, int]:
        """Attempts of one band ask the same model for the same quality."""
        return self.threshold(attempt), self.tier(attempt)

    def next_band(self, attempt: int) -> int | None:
        return next((k for k in range(attempt + 1, self.attempts + 1) if self.band(k) != self.band(attempt)), None)


@dataclass(frozen=True)
class Summary:
    notes: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    relevancy: int | None = None
    validated: bool | None = None
    attempts: int = 0
    tokens: int = 0
    exhausted: str | None = None
    passes: tuple[tuple[str, ...], ...] = ()


def note_lines(text: str) -> tuple[str, ...]:
    """Lines of an answer without list marks and numbering; blank ones dropped."""
    out = []
    for line in text.splitlines():
        line = line.strip().lstrip("*-•").lstrip("0123456789.)").strip()
        if line:
            out.append(line)
    return tuple(out)


def percent(text: str) -> int | None:
    digits = "".join(c if c.isdigit() else " " for c in text).split()
    return int(digits[0]) if digits and int(digits[0]) <= 100 else None


def topics_of(provider: Provider, notes: str) -> tuple[tuple[str, ...], int]:
    """Up to five topics of some notes, and the tokens spent: up to three tries, each with a larger model. Blank notes have none."""
    spent = 0
    if notes.strip():
        for tier in (1, 2, 3):
            said = provider.ask("topics", f"Topics\n\n{notes}", tier)
            spent += said.tokens
            if found := note_lines(said.text.replace(",", "\n"))[:5]:
                return found, spent
    return (), spent


def summarize(provider: Provider, context: str, policy: Policy = Policy(), clock=time.monotonic) -> Summary:
    """Notes until a score reaches the attempt's threshold; those of the best score are kept, or the first ones.

    Tokens and time are checked after notes and after the score; what is over stops the page with
    the reason, without topics. An answer without notes costs an attempt and isn't scored; a score
    that can't be read is zero. The same score twice in one band goes on with the next band, or ends the
    attempts. Scores are asked of the largest model, topics of the notes kept. A blank context is shown to no
    model: no notes, score zero, not validated either way.
    """
    if not context.strip():
        return Summary(relevancy=0)
    began, best, score, last, attempt, tokens, used = clock(), (), 0, None, 1, 0, 0
    accepted = False

    def over() -> str | None:
        return "tokens" if tokens > policy.max_tokens else "seconds" if clock() - began > policy.max_seconds else None

    while attempt <= policy.attempts and not accepted:
        used = attempt
        said = provider.ask("notes", f"Attempt {attempt}\n\n{context}", policy.tier(attempt))
        tokens += said.tokens
        notes = note_lines(said.text)
        best = best or notes
        if reason := over():
            return Summary(best, (), score, False, used, tokens, reason)
        if not notes:
            attempt += 1
            continue
        rated = provider.ask("score", f"{said.text}\n\n{context}", 3)
        tokens += rated.tokens
        now = percent(rated.text) or 0
        if now > score:
            score, best = now, notes
        if reason := over():
            return Summary(best, (), score, False, used, tokens, reason)
        if now >= policy.threshold(attempt):
            best, score, accepted = notes, now, True
        elif last == (policy.band(attempt), now):
            last, attempt = None, policy.next_band(attempt) or policy.attempts + 1
        else:
            last, attempt = (policy.band(attempt), now), attempt + 1
    topics, spent = topics_of(provider, "\n".join(best))
    tokens += spent
    return Summary(best, topics, score, accepted, used, tokens, over() if accepted else None)


def summarize_detailed(provider: Provider, context: str, policy: Policy = Policy(), clock=time.monotonic) -> Summary:
    """Three summaries and one of their notes; the union of the notes, in order, if that is empty. The score is the whole mean."""
    each = [summarize(provider, context, policy, clock) for _ in range(3)]
    shown = "\n\n".join(f"Extraction {k}:\n" + "\n".join(s.notes) for k, s in enumerate(each, 1))
    said = provider.ask("synthesis", shown, 1)
    notes = note_lines(said.text) or tuple(dict.fromkeys(n for s in each for n in s.notes))
    topics, spent = topics_of(provider, "\n".join(notes))
    scores = [s.relevancy for s in each if s.relevancy is not None]
    return Summary(
        notes, topics, min(100, sum(scores) // len(scores)) if scores else 0, all(s.validated for s in each), sum(s.attempts for s in each) + 1,
        sum(s.tokens for s in each) + said.tokens + spent, next((s.exhausted for s in each if s.exhausted), None), tuple(s.notes for s in each),
    )


def summarize_insight(provider: Provider, context: str, policy: Policy = Policy(), clock=time.monotonic) -> Summary:
    """A summary, with the insights that one more call draws from context and notes added to the notes."""
    s = summarize(provider, context, policy, clock)
    notes = "\n".join(s.notes)
    said = provider.ask("insight", f"{context}\n\n{notes}", 1)
    return replace(s, notes=s.notes + note_lines(said.text), tokens=s.tokens + said.tokens, attempts=s.attempts + 1)


def summarize_topics(provider: Provider, context: str, policy: Policy = Policy(), clock=time.monotonic) -> Summary:
    """Topics of the first 2,000 characters of the context, and nothing else."""
    topics, spent = topics_of(provider, context[:2000])
    return Summary(topics=topics, relevancy=0, attempts=1, tokens=spent)


def summarize_skip(provider: Provider, context: str, policy: Policy = Policy(), clock=time.monotonic) -> Summary:
    return Summary(relevancy=0)


def summarize_once(provider: Provider, context: str, policy: Policy = Policy(), clock=time.monotonic) -> Summary:
    """For command-line models: one pass for notes and one for topics, without a score and without known tokens; a blank context is shown too."""
    notes = note_lines(provider.ask("notes", f"Attempt 1\n\n{context}", 1).text)
    topics = note_lines(provider.ask("topics", "Topics\n\n" + "\n".join(notes), 1).text.replace(",", "\n"))[:5] if notes else ()
    return Summary(notes, topics, None, None, 1, 0)


def summarize_topics_once(provider: Provider, context: str, policy: Policy = Policy(), clock=time.monotonic) -> Summary:
    """For command-line models: topics of the whole context."""
    return Summary(topics=note_lines(provider.ask("topics", f"Topics\n\n{context}", 1).text.replace(",", "\n"))[:5], attempts=1)


#: Summaries by name; the last two don't leave blank pages out.
MODES = {"full": summarize, "detailed": summarize_detailed, "insight": summarize_insight, "topics_only": summarize_topics, "skip": summarize_skip, "once": summarize_once, "topics_once": summarize_topics_once}
BLANKS_TOO = ("once", "topics_once")
SUMMARY = "page_id bigint, notes array<string>, topics array<string>, relevancy int, validated boolean, attempts int, tokens bigint, exhausted string, passes array<array<string>>, error string"


def summaries(pages: DataFrame, provider: Provider, policy: Policy = Policy(), done: DataFrame | None = None, mode: str = "full") -> DataFrame:
    """A summary per page (page_id given once); an error stays with its page and stops no other. Pages in ``done`` are skipped. ``mode``: of MODES."""
    one = MODES[mode]
    rows = pages.select("page_id", P.page_context().alias("context"))
    if done is not None:
        rows = rows.join(done.select("page_id").distinct(), "page_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, context in zip(pdf.page_id, pdf.context):
                try:
                    s, error = one(provider, context, policy), None
                except Exception as e:
                    s, error = Summary(), f"{type(e).__name__}: {e}"
                out.append((page, list(s.notes), list(s.topics), s.relevancy, s.validated, s.attempts, s.tokens, s.exhausted, [list(p) for p in s.passes], error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SUMMARY.split(", ")]).astype({"relevancy": "Int32"})

    blank = strip("context") == ""
    values = {"notes": "array()", "topics": "array()", "relevancy": "0", "validated": "NULL", "attempts": "0", "tokens": "0", "exhausted": "NULL", "passes": "array()", "error": "NULL"}
    kinds = dict(c.split(" ", 1) for c in SUMMARY.split(", "))
    nothing = rows.where(blank).selectExpr("page_id", *[f"CAST({v} AS {kinds[c]}) AS {c}" for c, v in values.items()])
    if mode in BLANKS_TOO:
        return rows.mapInPandas(skip_empty(run), SUMMARY)
    return rows.where(~blank).mapInPandas(skip_empty(run), SUMMARY).unionByName(nothing)


def passthrough(pages: DataFrame) -> DataFrame:
    """The summary without a model: the first filled line as note, no topics, full score, not validated."""
    first = F.get(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1), strip), lambda x: x != ""), F.lit(0))
    return pages.select("page_id", F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>")).alias("notes"), F.array().cast("array<string>").alias("topics"), F.lit(100).alias("relevancy"), F.lit(False).alias("validated"))


VISION = "page_id bigint, image_classifier boolean, image_text string, tokens bigint, error string"


def vision(pages: DataFrame, provider: Provider) -> DataFrame:
    """Classify and read page images. A failed classification reads the image all the same; a failed reading leaves null."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, image in zip(pdf.page_id, pdf.image_base64):
                verdict, text, tokens, error = None, None, 0, None
                try:
                    said = provider.ask("classify", image)
                    tokens += said.tokens
                    verdict = "YES" in said.text.upper()
                except Exception as e:
                    error = f"classify: {e}"
                if verdict is not False:
                    try:
                        said = provider.ask("extract", image)
                        tokens += said.tokens
                        text = said.text.strip() or None
                    except Exception as e:
                        error = f"extract: {e}"
                out.append((page, verdict, text, tokens, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in VISION.split(", ")])

    return pages.where("coalesce(image_base64, '') <> ''").select("page_id", "image_base64").mapInPandas(skip_empty(run), VISION)


def spent_tokens(pages: DataFrame, done: DataFrame) -> DataFrame:
    """page_id, tokens of each summary: those reported, or where a model reports none, an estimate of the page's text, tables and image texts, and of notes and topics."""
    shown = pages.select("page_id", (P.page_tokens() + P.vision_tokens()).alias("shown"))
    both = done.select("page_id", "tokens", P.token_sum(F.concat("notes", "topics")).alias("said")).join(shown, "page_id")
    return both.select("page_id", F.when(F.col("tokens") == 0, F.col("shown") + F.col("said")).otherwise(F.col("tokens")).alias("tokens"))


def stage_metrics(done: DataFrame) -> DataFrame:
    """pages, tokens, attempts, average relevancy (whole, rounded down, at most 100; null without scores)."""
    mean = F.floor(F.sum("relevancy") / F.count("relevancy"))
    return done.agg(F.count("*").alias("pages_processed"), F.sum("tokens").alias("tokens"), F.sum("attempts").alias("total_attempts"), F.least(mean, F.lit(100)).cast("int").alias("avg_relevancy"))


def progress(stage: int, stages: int, done: int, total: int) -> int:
    """Percent of a run, 1 to 99 while it goes on."""
    part = min(1.0, max(0.0, done / total)) if total else 0.0
    return max(1, min(99, round((stage + part) / stages * 100)))
