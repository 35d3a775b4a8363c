"""Work lists for generators, resumption, judging, probing and mixing of training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import pages as P
from folio_spark.functions.text import question_hash
from folio_spark.session import numbered

#: Passage styles, in the order in which they rotate.
STYLES = (
    "internal memo", "analyst brief", "FAQ answer", "onboarding explainer", "meeting-notes recap", "Q&A dialogue between two colleagues",
    "training quiz with answers", "executive summary", "troubleshooting guide entry", "customer-facing email",
)
MIN_WORDS = {"structure": 60, "rephrase": 50, "entigraph": 80, "vision": 55, "answer": 10}


def structure_items(seeds: DataFrame, per_page: int = 24) -> DataFrame:
    """key, page_id, style: ``per_page`` passages for every seed page, whose styles rotate from the first."""
    each = seeds.select("page_id", "document_id", P.effective_page_number().cast("string").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(per_page - 1))).alias("k"))
    style = F.get(F.array(*[F.lit(s) for s in STYLES]), F.col("k") % len(STYLES))
    return each.select(F.concat_ws(":", F.lit("struct"), "document_id", "n", F.col("k").cast("string")).alias("key"), "page_id", style.alias("style"))


def remaining(items: DataFrame, done: DataFrame) -> DataFrame:
    """Work items whose key is not among the done ones."""
    return items.join(done.select("key").distinct(), "key", "left_anti")


def batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """Rows with batch and place: groups cut into batches of ``size`` in order."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("_at", at).withColumn("batch", F.floor(F.col("_at") / size).cast("int")).withColumn("place", (F.col("_at") % size).cast("int")).drop("_at")


def vision_items(seeds: DataFrame, batch_pages: int = 4) -> DataFrame:
    """page_id, key, place: the seed pages with visual text in one sequence by page_id, cut into batches whatever their document."""
    chosen = numbered(seeds.where(P.visual_text_corpus() != "").select("page_id"), ["page_id"], "_at")
    batch = F.floor(F.col("_at") / batch_pages).cast("string")
    key = F.concat(F.lit("vision_batch:"), F.when(F.length(batch) < 4, F.lpad(batch, 4, "0")).otherwise(batch))
    return chosen.select("page_id", key.alias("key"), (F.col("_at") % batch_pages).cast("int").alias("place"))


def message(role: str, messages: str = "messages") -> Column:
    """Content of the first message of a role."""
    return F.get(F.filter(messages, lambda m: m.role == role), F.lit(0)).content


def first_questions(records: DataFrame) -> DataFrame:
    """The first record (by pair_id) of every question, whatever its case, spacing and punctuation."""
    asked = records.withColumn("qhash", question_hash(message("user"))).where("qhash IS NOT NULL")
    first = asked.groupBy("qhash").agg(F.min("pair_id").alias("pair_id"))
    return first.select("pair_id", "qhash")


def rejudge(records: DataFrame, least: int = 7) -> DataFrame:
    """pair_id, verdict, reason: groundedness and usefulness of at least ``least``, clarity of one less.

    Any missing score is ``judge_no_score``; reasons stand in the order groundedness, usefulness, clarity.
    """
    g, u, c = (F.col(f"judge.{k}") for k in ("groundedness", "usefulness", "clarity"))
    low = F.concat_ws(",", F.when(g < least, "low_groundedness"), F.when(u < least, "low_usefulness"), F.when(c < least - 1, "low_clarity"))
    reason = F.when(g.isNull() | u.isNull() | c.isNull(), "judge_no_score").otherwise(low)
    return records.select("pair_id", reason.alias("reason")).select("pair_id", F.when(F.col("reason") == "", "accepted").otherwise("rejected").alias("verdict"), "reason")


def rekey(records: DataFrame) -> DataFrame:
    """Records under a new key, the old one kept in ``_source.sft_key`` unless one is there."""
    source = F.col("_source").withField("sft_key", F.coalesce("_source.sft_key", "sft_key"))
    return records.withColumn("_source", source).withColumn("key", F.concat(F.lit("judged:"), F.coalesce("sft_key", F.col("pair_id").cast("string"))))


def scrub(records: DataFrame) -> DataFrame:
    """Records without what only the pipeline needs."""
    return records.drop("_source", "sft_key", "key")


def grounded(records: DataFrame, pages: DataFrame) -> DataFrame:
    """pair_id, page_text: the text of the page a record was made from; the last row of a page given twice, empty if there is none."""
    number = P.effective_page_number().alias("n")
    last = pages.select("document_id", number, "page_id", "text").groupBy("document_id", "n").agg(F.max_by("text", "page_id").alias("text"))
    at = records.select("pair_id", F.col("_source.document_id").alias("document_id"), F.col("_source.page_number").alias("n"))
    return at.join(last, ["document_id", "n"], "left").select("pair_id", F.coalesce("text", F.lit("")).alias("page_text"))


def general_budget(n: int, ratio: float, available: int) -> int:
    """How many general records make up ``ratio`` of a mix with ``n`` others."""
    return min(available, int(n * ratio / (1 - ratio)))
