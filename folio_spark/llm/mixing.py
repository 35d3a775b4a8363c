"""Mixing sources to target weights: whole copies, and Pareto order samples for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.llm.tokens import sized
from folio_spark.session import materialize, table

SEED, BUCKET_ROWS = 20_31, 2000


def quotas(items: DataFrame, targets: DataFrame) -> DataFrame:
    """source, n, tokens, weight, share, max_repeats, quota, whole, rest per source.

    The mix is the largest whose shares are met while no source needs more than
    ``max_repeats`` copies of its items. Sources without a target, without a positive weight
    or cap, or without tokens have no share; the others' shares add up to 1.
    """
    have = items.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    want = targets.where("target_weight > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    both = have.join(want, "source")
    total = both.agg(F.sum("weight").alias("w")).first().w or 1
    most = both.agg(F.min(F.expr(f"max_repeats * tokens * ({total} / weight)")).alias("m")).first().m or 0
    return (
        both.withColumn("share", F.col("weight") / F.lit(total))
        .withColumn("quota", F.floor(F.round(F.lit(float(most)) * F.col("share"), 6)))
        .withColumn("whole", F.expr("cast(least(max_repeats, quota div tokens) AS int)"))
        .withColumn("rest", F.expr("IF(whole >= max_repeats, 0L, quota - whole * tokens)"))
    )


def mix(items: DataFrame, targets: DataFrame, seed: int = SEED, weight_col: str | None = None) -> DataFrame:
    """item_id, source, n_tokens, copies: the items of the mix and how often each is used.

    ``items``: item_id, source, n_tokens and, if named, a column of relative inclusion weights.
    Every item is used ``whole`` times for certain. The rest of a source's quota is a Pareto
    order sample without replacement: an item with uniform number u and inclusion probability
    p ranks by (u / (1 - u)) / (p / (1 - p)), the lowest ranks are taken until the quota is
    reached, the last one if that brings the total closer. p is the share of the source still
    wanted, times the item's weight if there is one (null or negative counts as 0; weight 0 is
    drawn only if all else is exhausted). u is a hash of id and seed, so a run can be repeated.

    Ranks are cut into buckets of some ``BUCKET_ROWS`` items, whose token sums say in which
    bucket the quota is reached; only that bucket is sorted. Null sources and items without
    tokens are not used; rows given twice are two items.
    """
    plan = quotas(items, targets)
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    rows = items.where("n_tokens > 0 AND source IS NOT NULL").select("item_id", "source", "n_tokens", weight.alias("w"))
    mean = rows.groupBy("source").agg((F.sum(F.col("w") * F.col("n_tokens")) / F.sum("n_tokens")).alias("mean_w"))
    rows = rows.join(plan.join(mean, "source").select("source", "n", "tokens", "whole", "rest", "mean_w"), "source")
    u = (F.expr(f"pmod(xxhash64(item_id, {seed}), 1073741824)") + 0.5) / F.lit(1073741824.0)
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("rest") / F.col("tokens") * F.when(F.col("mean_w") > 0, F.col("w") / F.col("mean_w")).otherwise(1.0)))
    rank = (u / (1 - u)) / (p / (1 - p))
    ranked = rows.withColumn("rank", rank).withColumn("bucket", F.expr(f"cast(floor(rank / (1 + rank) * greatest(1, n div {BUCKET_ROWS})) AS bigint)")).drop("w", "mean_w", "n", "tokens")
    ranked = materialize(ranked, "p9-ranked")
    sums = ranked.where("rest > 0").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("here"), F.max("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("here").over(order), F.lit(0))).where("before < rest")
    whole_bucket = sums.where("before + here <= rest").select("source", "bucket")
    cut = sums.where("before + here > rest").select("source", "bucket", "before")
    inner = Window.partitionBy("source").orderBy("rank", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        ranked.join(cut, ["source", "bucket"]).withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
        .where("ahead + n_tokens / 2 <= rest").select("item_id", "source", "n_tokens", F.lit(1).alias("copies"))
    )
    drawn = ranked.join(whole_bucket, ["source", "bucket"], "left_semi").select("item_id", "source", "n_tokens", F.lit(1).alias("copies")).unionByName(last)
    certain = ranked.where("whole > 0").select("item_id", "source", "n_tokens", F.col("whole").alias("copies"))
    return certain.unionByName(drawn).groupBy("item_id", "source", "n_tokens").agg(F.sum("copies").cast("int").alias("copies"))


def shares(mixed: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of either side: available and used tokens, target and actual share of the mix, most copies of an item."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_items"), F.max("copies").alias("most_copies"))
    have = items.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    target = quotas(items, targets).select("source", F.col("share").alias("target_share"))
    everyone = have.join(targets.select("source").distinct(), "source", "full").join(target, "source", "left").join(used, "source", "left")
    total = used.agg(F.sum("used_tokens").alias("n")).first().n or 1
    return everyone.select(
        "source", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("used_items", F.lit(0)).alias("used_items"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce("target_share", F.lit(0.0)), 6).alias("target_share"), F.round(F.coalesce(F.col("used_tokens") / F.lit(total), F.lit(0.0)), 6).alias("actual_share"),
    )


def _items(spark: SparkSession, root: str) -> DataFrame:
    return materialize(sized(table(spark, root, "documents"), ["doc_id", "source"]).withColumnRenamed("doc_id", "item_id"), "p9-items")


def p9_selection(spark: SparkSession, root: str) -> DataFrame:
    """The mix of the documents; the inclusion size of a document is its tokens, so every token of a source is as likely to be used."""
    return mix(_items(spark, root), table(spark, root, "mix_targets"), weight_col="n_tokens").withColumnRenamed("item_id", "doc_id")


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    items, targets = _items(spark, root), table(spark, root, "mix_targets")
    return shares(materialize(mix(items, targets, weight_col="n_tokens"), "p9-mixed"), items, targets)


QUERIES = {"p9_selection": p9_selection, "p9_shares": p9_shares}
