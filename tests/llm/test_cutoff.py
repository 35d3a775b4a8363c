import random

from folio_spark.llm import cutoff as C


def brute(rows, targets):
    out = {}
    for source in {s for s, _ in rows}:
        scores = sorted((v for s, v in rows if s == source and v is not None), reverse=True)
        if not scores:
            continue
        pct = min(100, max(0, targets.get(source) if targets.get(source) is not None else 100))
        for c in sorted(set(scores), reverse=True):
            kept = sum(v >= c for v in scores)
            if kept * 100 >= pct * len(scores):
                out[source] = (c, kept)
                break
    return out


def test_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(6)}", rng.choice([None, *range(0, 101, rng.choice([1, 7, 50]))])) for _ in range(4000)]
    rows += [("same", 50)] * 500 + [("one", 3)] + [(None, v) for v in range(40)] + [("none", None)]
    rows += [("hot", rng.randrange(100000)) for _ in range(5000)]
    targets = {"s0": 10, "s1": 0, "s2": 100, "s3": 37, "same": 5, "one": 50, "hot": 33, "s4": 250}
    got = C.cutoffs(spark.createDataFrame(rows, "source string, score int"), spark.createDataFrame(list(targets.items()), "source string, keep_pct int"))
    assert {r.source: (r.cutoff, r.kept) for r in got.collect()} == brute(rows, targets)


def test_a_broken_bracket_falls_back_to_all_scores(spark):
    rows = [("a", v) for v in range(1000)]
    got = C.cutoffs(spark.createDataFrame(rows, "source string, score int"), spark.createDataFrame([("a", 25)], "source string, keep_pct int"), accuracy=2).collect()
    assert [(r.cutoff, r.kept) for r in got] == [(750, 250)]


def test_empty(spark):
    assert C.cutoffs(spark.createDataFrame([], "source string, score int"), spark.createDataFrame([], "source string, keep_pct int")).count() == 0


def test_titles_in_capitals_and_scores_out_of_range(spark):
    pages = spark.createDataFrame([("A.PDF", s) for s in (10, 20, 30, 40, 50, 101, -1, None)] + [("b", 7)], "doc_title string, summary_relevancy int")
    got = C.title_cutoffs(pages, spark.createDataFrame([("pdf", 60)], "file_type string, keep_pct int"))
    assert {r.source: (r.cutoff, r.kept) for r in got.collect()} == {"A.PDF": (30, 3), "b": (7, 1)}
