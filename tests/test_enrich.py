import sys

from pyspark import cloudpickle

from folio_spark.operators import enrich as E

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Scripted(E.Provider):
    def __init__(self, score, tokens):
        self.score, self.tokens = score, tokens

    def ask(self, kind, prompt, tier=1):
        if "boom" in prompt:
            raise RuntimeError("no model")
        return E.Answer({"score": self.score, "topics": "a, b\nc", "classify": "no"}.get(kind, "- note\n- other"), self.tokens)


def test_good_score_stops_at_once():
    s = E.summarize(Scripted("95", 1), "text")
    assert (s.relevancy, s.validated, s.attempts, s.tokens, s.topics, s.notes) == (95, True, 1, 3, ("a", "b", "c"), ("note", "other"))


def test_a_score_below_the_first_threshold_passes_the_second():
    s = E.summarize(Scripted("86", 1), "text")
    assert s.attempts == 6 and s.validated


def test_the_same_score_twice_skips_the_band():
    """Two attempts in each of four bands, each scored, and one call for topics."""
    s = E.summarize(Scripted("80", 1), "text")
    assert (s.attempts, s.tokens, s.relevancy, s.validated) == (22, 17, 80, False) and s.topics == ("a", "b", "c")


class Rising(Scripted):
    """Other notes and a score one higher every time."""

    def ask(self, kind, prompt, tier=1):
        if kind in ("notes", "score"):
            self.calls = [*getattr(self, "calls", []), (kind, tier)]
        n = sum(k == "notes" for k, _ in getattr(self, "calls", []))
        return E.Answer({"notes": f"* n{n}", "score": f"{n}%", "topics": "" if tier < 3 else f"t of {prompt[-2:]}"}.get(kind, ""), 1)


def test_scores_that_change_use_all_attempts_and_keep_the_best():
    model = Rising("", 1)
    s = E.summarize(model, "text")
    assert s.attempts == 30 and s.relevancy == 30 and s.notes == ("n30",) and s.topics == ("t of 30",) and s.tokens == 63
    assert [t for k, t in model.calls if k == "score"] == [3] * 30 and [t for k, t in model.calls if k == "notes"] == [1] * 10 + [2] * 10 + [3] * 10


class Silent(E.Provider):
    def ask(self, kind, prompt, tier=1):
        return E.Answer("* \n" if kind == "notes" else "50", 1)


def test_answers_without_notes_are_not_scored():
    s = E.summarize(Silent(), "text")
    assert (s.notes, s.topics, s.relevancy, s.attempts, s.tokens, s.validated) == ((), (), 0, 30, 30, False)


def test_modes():
    s = E.summarize_detailed(Scripted("95", 1), "text")
    assert (s.attempts, s.tokens, s.relevancy, s.validated, s.notes) == (4, 11, 95, True, ("note", "other")) and s.passes == (("note", "other"),) * 3
    s = E.summarize_insight(Scripted("95", 1), "text")
    assert s.notes == ("note", "other") * 2 and s.attempts == 2 and s.tokens == 4
    s = E.summarize_topics(Scripted("95", 1), "x" * 3000)
    assert (s.topics, s.relevancy, s.attempts, s.validated) == (("a", "b", "c"), 0, 1, None)
    s = E.summarize_once(Scripted("95", 1), "")
    assert (s.notes, s.topics, s.relevancy, s.validated, s.attempts, s.tokens) == (("note", "other"), ("a", "b", "c"), None, None, 1, 0)
    assert E.summarize_topics_once(Scripted("95", 1), "x").topics == ("a", "b", "c")
    assert E.summarize_skip(Scripted("95", 1), "text") == E.Summary(relevancy=0) == E.summarize(Scripted("95", 1), " \n")


def test_token_budget_stops_with_the_notes():
    s = E.summarize(Scripted("80", 1500), "text", E.Policy(max_tokens=1000))
    assert s.attempts == 1 and s.exhausted == "tokens" and s.notes == ("note", "other") and s.topics == ()


def test_time_budget():
    ticks = iter(range(0, 10_000, 200))
    assert E.summarize(Scripted("80", 1), "text", E.Policy(max_seconds=300), clock=lambda: next(ticks)).exhausted == "seconds"


def test_policy_and_parsers():
    p = E.Policy()
    assert [p.threshold(k) for k in (1, 5, 6)] == [90, 90, 85] and [p.tier(k) for k in (6, 11, 21, 30)] == [1, 2, 3, 3]
    assert [E.percent(x) for x in ("92%", "8/10", "0.85", "score: 110", "none")] == [92, 8, 0, None, None]
    assert E.progress(0, 2, 0, 10) == 1 and E.progress(1, 2, 10, 10) == 99 and E.progress(1, 2, 5, 10) == 75


def test_retries_back_off():
    waits, calls = [], []

    class Flaky(E.Provider):
        def ask(self, kind, prompt, tier=1):
            calls.append(1)
            if len(calls) < 3:
                raise OSError
            return E.Answer("ok")

    assert E.Retrying(Flaky(), sleep=waits.append).ask("notes", "x").text == "ok" and waits == [2.0, 4.0]


def test_summaries_degrade_per_page_and_resume(spark):
    cols = "page_id bigint, text string, tables array<array<array<string>>>, image_text string, image_text_1 string, image_text_2 string, image_text_3 string, image_classifier boolean"
    pages = spark.createDataFrame([(1, "fine", [[["ab"]]], "seen it", *(None,) * 3, True), (2, "boom", [], *(None,) * 5), (3, None, None, *(None,) * 5), (4, "done", [], *(None,) * 5)], cols)
    done = spark.createDataFrame([(4,)], "page_id bigint")
    got = {r.page_id: r for r in E.summaries(pages, Scripted("95", 1), done=done).collect()}
    assert set(got) == {1, 2, 3} and got[1].relevancy == 95 and got[2].error == "RuntimeError: no model" and got[2].relevancy is None and got[3].attempts == 0 and got[3].validated is None
    once = E.summaries(pages.where("page_id IN (1, 3)"), Scripted("95", 1), mode="once")
    assert {r.page_id: r.tokens for r in E.spent_tokens(pages, once).collect()} == {1: 1 + 1 + 3 + 6, 3: 6}
    metrics = E.stage_metrics(E.summaries(pages.where("page_id = 1"), Scripted("95", 1))).first()
    assert (metrics.pages_processed, metrics.tokens, metrics.avg_relevancy) == (1, 3, 95)


def test_vision_reads_unless_told_not_to(spark):
    pages = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "page_id bigint, image_base64 string")
    assert [(r.page_id, r.image_classifier, r.image_text) for r in E.vision(pages, Scripted("1", 1)).collect()] == [(1, False, None)]
    assert E.vision(pages, E.Stub()).first().image_classifier is True
