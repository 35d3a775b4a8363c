import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folio_spark.operators import generate as G
from folio_spark.operators.enrich import Answer, Provider

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_answers_are_parsed():
    assert G.json_array('Sure: [1, [2]] done') == [1, [2]]
    for bad in ("none", "[1", '{"a": 1}', "[1] and [2]"):
        with pytest.raises(ValueError):
            G.json_array(bad)
    assert G.pairs_of('[{"question": " q ", "answer": 5}, 3, {}]') == [{"question": "q", "answer": "5"}, None, {"question": "", "answer": ""}]
    assert G.passages_of('[{"index": "1", "passages": "a"}, {"index": 0, "passages": ["b", " "]}, {"index": 1, "passages": []}, {"index": null}, 7, {"index": 2, "passages": ["x"]}, {"index": 2, "passages": ["y"]}]') == [{"index": 0, "passages": ["b"]}, {"index": 1, "passages": ["a"]}, {"index": 2, "passages": ["y"]}]
    assert G.scores_of('[{"i": 2, "groundedness": true, "clarity": "9"}, {"i": 1, "usefulness": 3.9}, {"i": 2, "clarity": 4}]') == [{"i": 1, "groundedness": None, "clarity": None, "usefulness": "3.9"}, {"i": 2, "groundedness": None, "clarity": "4", "usefulness": None}]
    assert G.estimated_tokens("a b c") == 4


class Moody(Provider):
    """Fails for one prompt, never gives an array for another, and needs a second call for a third."""

    def ask(self, kind, prompt, tier=1):
        if "boom" in prompt:
            raise OSError("down")
        if "never" in prompt or ("later" in prompt and G.AGAIN not in prompt):
            return Answer("no array", 2)
        return Answer('[{"question": "What is it?", "answer": "one two three four five six seven eight nine ten"}]', 3)


def test_calls_are_repeated_once_and_failures_kept(spark):
    work = spark.createDataFrame([(k, k) for k in ("boom", "never", "later", "good", "done")], "key string, prompt string")
    done = spark.createDataFrame([("done",)], "key string")
    answers = G.ask(work, Moody(), "qa", G.pairs_of, done)
    got = {r.key: r for r in answers.collect()}
    assert set(got) == {"boom", "never", "later", "good"} and got["later"].tokens == 5 and got["good"].tokens == 3 and json.loads(got["later"].answer)
    assert got["boom"].error == "OSError: down" and got["never"].error.startswith("json parse failed") and got["never"].tokens == 4
    assert {(r.key, r.kind, r.endpoint) for r in G.failures(work, answers, "qa", "e").collect()} == {("boom", "qa", "e"), ("never", "qa", "e")}
    items = work.select("key", "prompt", F.lit("d").alias("document_id"), F.lit(1).alias("page_number"))
    records = G.qa_records(items, answers, "sys", "g")
    assert [(r.key, [m.role for m in r.messages], r._source.document_id) for r in records.collect()] == [("good", ["system", "user", "assistant"], "d")]
    assert G.qa_records(items, answers, "sys", "g", known=records.select("qhash")).count() == 0


SEEDS = "page_id bigint, document_id string, filename string, page_number int, text string, tables_md string, visual_text string, summary_notes array<string>, summary_topics array<string>"


def test_vision_passages_meet_their_page(spark):
    seeds = spark.createDataFrame([(i, f"d{i}", "f", i, "", "", "" if i == 3 else f"seen {i} " * 4, [], ["t"]) for i in range(1, 7)], SEEDS)
    items = G.vision_prompts(seeds, batch_pages=2).persist()
    assert [(r.key, [m.document_id for m in r.members]) for r in items.orderBy("key").collect()] == [("vision_batch:0000", ["d1", "d2"]), ("vision_batch:0001", ["d4", "d5"]), ("vision_batch:0002", ["d6"])]
    got = G.vision_records(items, G.ask(items, G.Echo(), "vision", G.passages_of), min_words=3).collect()
    assert {(r.key, r.batch_key, r.text.split()[1], r.style) for r in got} == {(f"vision:d{i}:{i}:0", f"vision_batch:{b:04}", str(i), G.STYLES[b]) for i, b in ((1, 0), (2, 0), (4, 1), (5, 1), (6, 2))}


def test_scores_meet_their_record(spark):
    records = spark.createDataFrame([(i, ("d", 1), [("user", "q"), ("assistant", "a")]) for i in (5, 7, 9)], "pair_id bigint, _source struct<document_id: string, page_number: int>, messages array<struct<role: string, content: string>>")
    seeds = spark.createDataFrame([(1, "d", "f", 1, "page text", "", "", [], []), (2, "d", "f", 1, "delivered last", "", "", [], [])], SEEDS)
    items = G.judge_items(records, seeds, batch_size=2).persist()
    assert {r.key for r in items.collect()} == {"judge:d:1:0", "judge:d:1:1"} and all("delivered last" in r.prompt for r in items.collect())
    got = {r.pair_id: (r.key, r.judge.groundedness, r.judge.clarity, r.judge.usefulness) for r in G.judged(items, G.ask(items, G.Echo(), "judge", G.scores_of), "m").collect()}
    assert got == {5: ("judge:d:1:0", 8, 7, 7), 7: ("judge:d:1:0", 8, 7, 8), 9: ("judge:d:1:1", 8, 7, 7)}
