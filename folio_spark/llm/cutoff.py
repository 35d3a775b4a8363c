"""A score cutoff per source that keeps a target share: sketch-bracketed exact selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.session import table

ACCURACY = 1000


def cutoffs(scores: DataFrame, targets: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """source, cutoff, kept, scored: the highest score c such that the rows scoring c or more
    are at least ``keep_pct`` percent of the source's scored rows, and the number of those rows.

    ``scores``: source, score (nulls are not scored). ``targets``: source, keep_pct; a source
    without one, or with a null, keeps all of its rows. A share of 0 or less still keeps the
    highest score, one of 100 or more keeps all. The null source is a source of its own.
    Sources without a scored row are left out; all scores being equal, all rows are kept.

    1. A Greenwald-Khanna sketch per source (rank error at most n / accuracy) gives two
       scores that bracket the target rank for certain.
    2. One pass counts the rows above the bracket; only rows inside are sorted. Rows are
       counted by (source, score) before anything is shuffled, so a source with a third of
       all rows, or with one score for all of them, is no hot spot.
    3. The bracket is checked against the exact counts; should it miss (the bound would have
       to be broken), that source's whole score list is used instead.
    """
    eps = 2.0 / accuracy
    scored = scores.where(F.col("score").isNotNull()).select("source", "score")
    pct = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("keep_pct").cast("double"), F.lit(100.0)) / 100))
    grid = 1.0 / accuracy
    probes = [round(k * grid, 9) for k in range(accuracy + 1)] if accuracy <= 200 else [round(k / 200, 9) for k in range(201)]
    sketch = scored.groupBy("source").agg(F.count("*").alias("n"), F.percentile_approx("score", probes, accuracy).alias("q"))
    wanted = targets.groupBy("source").agg(F.max("keep_pct").alias("keep_pct"))
    same = sketch["source"].eqNullSafe(wanted["source"])
    # The target's ascending quantile is 1 - pct; the probes just outside it, plus the rank error on both sides, bracket it.
    step = 1.0 / (len(probes) - 1)
    bounds = (
        sketch.join(wanted, same, "left").select(sketch["source"], "n", "q", pct.alias("pct"))
        .withColumn("k", F.expr("greatest(1, ceil(round(n * pct, 6)))").cast("bigint"))
        .withColumn("lo", F.expr(f"q[cast(greatest(0, floor((1 - pct - {eps} - 1.0 / n) / {step})) as int)]"))
        .withColumn("hi", F.expr(f"q[cast(least({len(probes) - 1}, ceil((1 - pct + {eps} + 1.0 / n) / {step})) as int)]"))
        .withColumn("lo", F.expr(f"IF(1 - pct - {eps} - 1.0 / n <= 0, NULL, lo)"))
        .withColumn("hi", F.expr(f"IF(1 - pct + {eps} + 1.0 / n >= 1, NULL, hi)"))
        .select(F.col("source").alias("src"), "n", "k", "lo", "hi")
    )
    counted = scored.groupBy("source", "score").agg(F.count("*").alias("c"))
    placed = counted.join(bounds, counted["source"].eqNullSafe(bounds["src"]))
    totals = placed.groupBy("src").agg(
        F.max("n").alias("n"), F.max("k").alias("k"),
        F.sum(F.when(F.col("score") > F.col("hi"), F.col("c")).otherwise(0)).alias("above"),
        F.sum(F.when((F.col("score") <= F.coalesce("hi", "score")) & (F.col("score") >= F.coalesce("lo", "score")), F.col("c")).otherwise(0)).alias("inside"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi"),
    )
    held = "above < k AND k <= above + inside"
    totals = totals.selectExpr("src", "n", "k", f"IF({held}, above, 0L) AS above", f"IF({held}, lo, NULL) AS lo", f"IF({held}, hi, NULL) AS hi")
    within = counted.join(totals, counted["source"].eqNullSafe(totals["src"])).where("score >= coalesce(lo, score) AND score <= coalesce(hi, score)")
    order = Window.partitionBy("src").orderBy(F.col("score").desc())
    return (
        within.withColumn("kept", F.col("above") + F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where("kept >= k").groupBy("src").agg(F.max("score").alias("cutoff"), F.min("kept").alias("kept"), F.max("n").alias("scored"))
        .select(F.col("src").alias("source"), "cutoff", "kept", "scored")
    )


def title_targets(titles: DataFrame, keep_targets: DataFrame) -> DataFrame:
    """source, keep_pct by the title's extension in lower case."""
    kind = F.lower(F.regexp_extract("source", r"\.([^./\\]+)$", 1))
    by_type = keep_targets.groupBy(F.lower("file_type").alias("kind")).agg(F.max("keep_pct").alias("keep_pct"))
    return titles.withColumn("kind", kind).join(by_type, "kind", "left").select("source", "keep_pct")


def title_cutoffs(pages: DataFrame, keep_targets: DataFrame) -> DataFrame:
    """``cutoffs`` of ``summary_relevancy`` per ``doc_title``; scores outside 0..100 don't count."""
    scores = pages.select(F.col("doc_title").alias("source"), F.col("summary_relevancy").alias("score")).where("score BETWEEN 0 AND 100")
    return cutoffs(scores, title_targets(scores.select("source").distinct(), keep_targets))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    found = title_cutoffs(table(spark, root, "pages"), table(spark, root, "keep_targets"))
    return found.selectExpr("source AS doc_title", "cast(cutoff AS int) AS cutoff", "kept")


def p2_kept(spark: SparkSession, root: str) -> DataFrame:
    """The kept size of each title against its scored and target sizes."""
    pages, targets = table(spark, root, "pages"), table(spark, root, "keep_targets")
    found = title_cutoffs(pages, targets)
    wanted = title_targets(found.select("source"), targets)
    return found.join(wanted, "source").selectExpr("source AS doc_title", "keep_pct", "scored", "kept", "round(100.0D * kept / scored, 4) AS kept_pct")


QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept}
_SQL = """
WITH s AS (SELECT doc_title, summary_relevancy AS score, lower(regexp_extract(doc_title, '\\.([^./\\\\]+)$', 1)) AS kind
           FROM pages WHERE summary_relevancy BETWEEN 0 AND 100),
h AS (SELECT doc_title, any_value(kind) AS kind, score, count(*) AS c FROM s GROUP BY doc_title, score),
r AS (SELECT doc_title, kind, score, sum(c) OVER (PARTITION BY doc_title ORDER BY score DESC) AS kept, sum(c) OVER (PARTITION BY doc_title) AS n FROM h),
t AS (SELECT r.*, coalesce(keep_pct, 100) AS p, keep_pct FROM r LEFT JOIN keep_targets k ON k.file_type = r.kind)
"""
SQL = {
    "p2_found": _SQL + "SELECT doc_title, max(score) AS cutoff, CAST(min(kept) AS BIGINT) AS kept FROM t WHERE kept * 100 >= p * n GROUP BY doc_title",
    "p2_kept": _SQL + "SELECT doc_title, any_value(keep_pct) AS keep_pct, CAST(any_value(n) AS BIGINT) AS scored, CAST(min(kept) AS BIGINT) AS kept, round(100.0 * min(kept)::DOUBLE / any_value(n)::DOUBLE, 4) AS kept_pct FROM t WHERE kept * 100 >= p * n GROUP BY doc_title",
}
