import random
from collections import Counter, deque

from folio_spark.llm import packing as K


def test_every_item_lies_whole_unless_longer_than_the_capacity(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 9 + ["b", "c", None]), rng.choice([None, 0, 1, 5, 40, 99, 100, 101, 350])) for i in range(3000)] + [(7, "a", 40)] * 20
    items = spark.createDataFrame(rows, "item_id bigint, source string, n_tokens bigint")
    specs = spark.createDataFrame([("s", 100), ("s", 100), ("l", 1000), ("bad", 0), ("null", None)], "spec_name string, capacity_tokens int")
    got = K.pack(items, specs, part_tokens=20_000, window=8).collect()
    for name, capacity in (("s", 100), ("l", 1000)):
        mine = [r for r in got if r.spec_name == name]
        filled = {}
        for r in mine:
            filled[r.container] = filled.get(r.container, 0) + r.n_tokens
        total = sum(n or 0 for *_, n in rows)
        assert sum(filled.values()) == total and max(filled.values()) <= capacity
        assert total / (len(filled) * capacity) > 0.95
        sizes = {}
        for i, _, n in rows:
            sizes.setdefault(i, []).append(n)
        assert all(r.piece_no == 0 or max(n or 0 for n in sizes[r.item_id]) > capacity for r in mine)
    assert {r.spec_name for r in got} == {"s", "l"}


def test_windows_follow_the_shares():
    from collections import deque

    queues = {"a": deque([(10, f"a{i}") for i in range(900)]), "b": deque([(10, f"b{i}") for i in range(100)])}
    windows = list(K.windows(queues, {"a": 0.9, "b": 0.1}, {"a": 0.0, "b": 0.0}, 500.0))
    assert sum(map(len, windows)) == 1000
    assert all(abs(sum(x[1][0] == "b" for x in w) / len(w) - 0.1) < 0.03 for w in windows[:-1])


def test_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, source string, n_tokens bigint")
    assert K.pack(none, spark.createDataFrame([("s", 10)], "spec_name string, capacity_tokens int")).count() == 0
    assert K.pack(spark.createDataFrame([(1, "a", 5)], "item_id bigint, source string, n_tokens bigint"), spark.createDataFrame([], "spec_name string, capacity_tokens int")).count() == 0


def test_a_deficit_of_many_windows_is_given_in_full():
    """Source a is due ten budgets from before: it gives ahead of b until these are made up."""
    queues = {s: deque((1, s) for _ in range(2000)) for s in "ab"}
    given = Counter()
    for k, batch in enumerate(K.windows(queues, {"a": 0.5, "b": 0.5}, {"a": 1000.0, "b": -1000.0}, 100.0)):
        given.update(x[1] for x in batch)
        assert max(Counter(x[1] for x in batch).values()) <= 150 or k > 9
        if k == 9:
            assert given["a"] == 1500 and given["b"] == 0
            break
