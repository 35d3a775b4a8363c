"""Filling containers of fixed capacity with items, in the sources' token proportions."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.llm.tokens import sized
from folio_spark.session import materialize, table

PART_TOKENS, WINDOW, MAX_TASKS = 2_000_000, 64, 10_000


def windows(queues: dict[str, deque], share: dict[str, float], deficit: dict[str, float], budget: float) -> Iterator[list[tuple]]:
    """Items (size, ...) in windows of about ``budget`` tokens, by deficit round-robin.

    In every window each source is credited its share of the budget and gives items while its
    deficit covers the next one; what is left over, or overdrawn, is carried to the next
    window. A source that has run out leaves its credit to those that have not. A deficit to begin
    with that is larger than the budget is spread over windows, a budget in each, until all is given.
    """
    owed = dict(deficit)
    deficit = dict.fromkeys(deficit, 0.0)
    while any(queues.values()):
        live = [s for s in queues if queues[s]]
        total = sum(share[s] for s in live) or 1.0
        window: list[tuple] = []
        for s in live:
            step = max(-budget, min(budget, owed[s]))
            owed[s] -= step
            deficit[s] += step + budget * (share[s] / total if sum(share[x] for x in live) else 1 / len(live))
            while queues[s] and deficit[s] >= queues[s][0][0]:
                item = queues[s].popleft()
                deficit[s] -= item[0]
                window.append(item)
            if not queues[s]:
                deficit[s] = 0.0
        if window:
            yield window


def pack_part(items: list[tuple], share: dict[str, float], deficit: dict[str, float], capacity: int, window: int = WINDOW) -> Iterator[tuple]:
    """(container_no, key, piece_no, start, tokens) for items (key, source, size).

    An item above the capacity fills containers of its own; only its rest is packed. Within a
    window the longest goes first, into the fullest container that still takes it; containers
    stay open for later windows while they have room.
    """
    queues: dict[str, deque] = {}
    made = 0
    for key, source, size in items:
        at = 0
        while size - at > capacity:
            yield made, key, at // capacity, at, capacity
            made, at = made + 1, at + capacity
        queues.setdefault(source, deque()).append((size - at, key, at // capacity, at))
    room: list[tuple[int, int]] = []
    for batch in windows(queues, share, {s: deficit.get(s, 0.0) for s in queues}, window * capacity):
        for size, key, piece, start in sorted(batch, key=lambda x: -x[0]):
            k = bisect_left(room, (size, -1))
            if k < len(room):
                free, to = room.pop(k)
            else:
                free, to, made = capacity, made, made + 1
            yield to, key, piece, start, size
            if free > size:
                insort(room, (free - size, to))


def pack(items: DataFrame, specs: DataFrame, part_tokens: int = PART_TOKENS, window: int = WINDOW) -> DataFrame:
    """spec_name, container, item_id, piece_no, start, n_tokens: where every item of every spec lies.

    ``items``: item_id, source, n_tokens. ``specs``: spec_name, capacity_tokens; a spec given
    twice counts once, one without a positive capacity is left out. Every item lies in one
    container as a whole, one longer than the capacity in consecutive pieces. Items of no
    tokens, or null, lie nowhere. A null source is a source. An item given twice is packed
    twice.

    Items are spread by hash over parts of about ``part_tokens`` tokens, each packed by one
    task; no source, however large, meets in one place. The target share of a source is its
    share of all tokens. A part begins with the deficits that the parts before it leave: what
    each source was due there less what it had. A part ends with a few half-filled containers,
    against thousands of full ones.
    """
    items = items.where("n_tokens > 0").selectExpr("item_id", "coalesce(source, '') AS source", "n_tokens")
    n = items.agg(F.sum("n_tokens").alias("n")).first().n or 0
    parts = max(1, -(-n // part_tokens))
    spread = materialize(items.withColumn("part", F.expr(f"cast(pmod(xxhash64(item_id, source, n_tokens), {parts}) AS int)")), "p8-items")
    held = spread.groupBy("part", "source").agg(F.sum("n_tokens").alias("held"))
    share = held.groupBy("source").agg((F.sum("held") / F.lit(max(n, 1))).alias("share"))
    sums = held.groupBy("part").agg(F.sum("held").alias("part_sum"))
    due = held.join(sums, "part").join(share, "source")
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    due = due.withColumn("deficit", F.coalesce(F.sum(F.col("share") * F.col("part_sum") - F.col("held")).over(order), F.lit(0.0)))
    sizes = [(r.spec_name, int(r.capacity_tokens)) for r in specs.where("capacity_tokens > 0").groupBy("spec_name").agg(F.max("capacity_tokens").alias("capacity_tokens")).orderBy("spec_name").collect()]

    schema = "spec_name string, container string, item_id bigint, piece_no int, start bigint, n_tokens bigint"
    if not sizes:
        return items.sparkSession.createDataFrame([], schema)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["n_tokens", "item_id"], ascending=[False, True], na_position="last")
        heads = own.drop_duplicates("source")
        share = dict(zip(heads.source, heads.share))
        deficit = dict(zip(heads.source, heads.deficit))
        part = int(own.part.iloc[0])
        rows = list(zip(own.item_id, own.source, own.n_tokens))
        frames = []
        for name, capacity in sizes:
            out = pd.DataFrame(list(pack_part(rows, share, deficit, capacity, window)), columns=["container", "item_id", "piece_no", "start", "n_tokens"])
            out["container"] = f"{part}-" + out.container.astype(str)
            out.insert(0, "spec_name", name)
            frames.append(out)
        return pd.concat(frames)

    # Parts are small in bytes and long in work: a fixed number of tasks, which adaptive execution doesn't merge.
    ready = spread.join(due.select("part", "source", "share", "deficit"), ["part", "source"]).repartition(min(parts, MAX_TASKS), "part")
    return ready.groupBy("part").applyInPandas(run, schema)


def _packed(spark: SparkSession, root: str) -> DataFrame:
    items = sized(table(spark, root, "documents"), ["doc_id", "source"]).withColumnRenamed("doc_id", "item_id")
    return pack(items, table(spark, root, "pack_specs"))


def p8_assignment(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root).withColumnRenamed("item_id", "doc_id")


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers and filled share per spec, against the fewest that could hold the tokens."""
    specs = table(spark, root, "pack_specs").groupBy("spec_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    filled = _packed(spark, root).groupBy("spec_name", "container").agg(F.sum("n_tokens").alias("n")).groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    return filled.join(specs, "spec_name").selectExpr("spec_name", "capacity_tokens", "containers", "ceil(tokens / capacity_tokens) AS fewest", "tokens", "round(tokens / (containers * capacity_tokens), 5) AS filled")


QUERIES = {"p8_assignment": p8_assignment, "p8_fill": p8_fill}
