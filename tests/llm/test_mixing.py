import random

import pytest

from folio_spark.llm import mixing as M

ITEM, TARGET = "item_id bigint, source string, n_tokens bigint", "source string, target_weight int, max_repeats int"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    rows = [(i, "big", rng.randint(1, 200)) for i in range(6000)] + [(10_000 + i, "mid", rng.randint(1, 200)) for i in range(1500)] + [(20_000 + i, "tiny", rng.randint(50, 100)) for i in range(60)]
    rows += [(30_000, "untargeted", 10), (30_001, None, 10), (30_002, "big", 0), (30_003, "big", None)]
    return spark.createDataFrame(rows, ITEM), spark.createDataFrame([("big", 6, 1), ("mid", 3, 2), ("tiny", 1, 8), ("tiny", 1, 8), ("absent", 5, 3), ("zero", 0, 1)], TARGET), rows


def test_shares_and_caps(spark, world):
    items, targets, rows = world
    mixed = M.mix(items, targets)
    got = mixed.collect()
    used = {}
    for r in got:
        used[r.source] = used.get(r.source, 0) + r.n_tokens * r.copies
    total = sum(used.values())
    assert set(used) == {"big", "mid", "tiny"}
    for source, share, cap in (("big", 0.6, 1), ("mid", 0.3, 2), ("tiny", 0.1, 8)):
        assert abs(used[source] / total - share) < 0.01
        assert max(r.copies for r in got if r.source == source) <= cap
    assert len({r.item_id for r in got}) == len(got)
    report = {r.source: r for r in M.shares(mixed, items, targets).collect()}
    assert report["absent"].available_tokens == 0 and report["untargeted"].actual_share == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-4
    assert sorted(map(tuple, M.mix(items, targets).collect())) == sorted(map(tuple, got))


def test_sample_equals_sorting_by_rank(spark):
    """The bucketed cut takes exactly the lowest ranks, as sorting the whole source would."""
    rows = [(i, "a", 1 + i % 7) for i in range(9000)] + [(90_000 + i, "b", 10) for i in range(100)]
    items = spark.createDataFrame(rows, ITEM)
    targets = spark.createDataFrame([("a", 1, 1), ("b", 1, 4)], TARGET)
    got = {r.item_id for r in M.mix(items, targets).where("source = 'a'").collect()}
    plan = {r.source: r for r in M.quotas(items, targets).collect()}
    from pyspark.sql import functions as F

    u = {r.item_id: (r.u + 0.5) / 2**30 for r in items.where("source = 'a'").select("item_id", F.expr(f"pmod(xxhash64(item_id, {M.SEED}), 1073741824) AS u")).collect()}
    taken, ahead = set(), 0
    for i in sorted(u, key=lambda i: (u[i] / (1 - u[i]), i)):
        size = 1 + i % 7
        if ahead + size / 2 <= plan["a"].rest:
            taken.add(i)
        ahead += size
    assert len(got ^ taken) <= 2


def test_weights_make_inclusion_unequal(spark):
    rows = [(i, "a", 10, 9.0 if i % 2 else 1.0) for i in range(4000)] + [(9000 + i, "b", 10, None) for i in range(100)]
    items = spark.createDataFrame(rows, ITEM + ", w double")
    got = M.mix(items, spark.createDataFrame([("a", 1, 1), ("b", 1, 8)], TARGET), weight_col="w").where("source = 'a'").collect()
    odd = sum(r.item_id % 2 for r in got)
    assert odd > 3 * (len(got) - odd) and abs(sum(r.n_tokens for r in got) - 8000) <= 10


def test_inclusion_is_proportional_to_size(spark):
    """Over many seeds an item of twice the tokens is drawn twice as often, and the quota is met each time."""
    rows = [(i, "a", 10 * (1 + i % 4)) for i in range(400)] + [(9000 + i, "b", 10) for i in range(100)]
    items = spark.createDataFrame(rows, ITEM).cache()
    targets = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], TARGET)
    drawn = dict.fromkeys((10, 20, 30, 40), 0)
    for seed in range(12):
        got = M.mix(items, targets, seed=seed, weight_col="n_tokens").where("source = 'a'").collect()
        assert abs(sum(r.n_tokens for r in got) - 1000) <= 20 and all(r.copies == 1 for r in got)
        for r in got:
            drawn[r.n_tokens] += 1
    rates = {k: n / 1200 for k, n in drawn.items()}
    assert all(abs(rates[k] / (k * 1000 / sum(t * t for _, s, t in rows if s == "a")) - 1) < 0.3 for k in rates), rates


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], ITEM), spark.createDataFrame([], TARGET)).count() == 0
