"""Functions over the columns of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio_spark.functions.text import strip

VISUAL = ("image_text", "image_text_1", "image_text_2", "image_text_3")


def some(c: str) -> Column:
    """Whether an array is neither null nor empty."""
    return F.coalesce(F.size(c) > 0, F.lit(False)) & F.col(c).isNotNull()


def has_text(c: str) -> Column:
    return F.coalesce(strip(c), F.lit("")) != ""


def effective_page_number() -> Column:
    """The stored number if it is positive, else the position from 1."""
    return F.coalesce(F.when(F.col("page_number") > 0, F.col("page_number")), F.col("pos") + 1)


def visual_text_corpus() -> Column:
    """Image texts as they are, joined by line ends; the whole is trimmed."""
    parts = F.filter(F.array(*VISUAL), lambda x: x.isNotNull() & (strip(x) != ""))
    return strip(F.array_join(parts, "\n"))


def visual_text_query() -> Column:
    """Trimmed image texts, joined by blank lines."""
    parts = F.filter(F.transform(F.array(*VISUAL), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.array_join(parts, "\n\n")


def page_identity() -> Column:
    return F.concat_ws(":", "document_id", effective_page_number().cast("string"))


def has_summary() -> Column:
    """Notes or topics; a score alone is no summary."""
    return some("summary_notes") | some("summary_topics")


def unvalidated_summary() -> Column:
    """Notes and a score that the quality check did not accept."""
    return F.coalesce(~F.col("summary_quality_validated") & F.col("summary_relevancy").isNotNull() & some("summary_notes"), F.lit(False))


def first_description() -> Column:
    """The first note if there are notes, else the text in one line (cut to 117 and ``...`` beyond 120), else 120 of the visual text."""
    note = F.when(some("summary_notes"), F.coalesce(F.get("summary_notes", F.lit(0)), F.lit("None")))
    flat = strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    cut = F.when(F.length(flat) > 120, F.concat(F.left(flat, F.lit(117)), F.lit("..."))).otherwise(flat)
    return F.coalesce(strip(note), F.nullif(cut, F.lit("")), strip(F.left(visual_text_query(), F.lit(120))))


def drop_reason(min_relevancy: int, keep_warnings: bool = False) -> Column:
    """Why a page is left out of a corpus, or ``keep``; the first that holds. A null score passes."""
    warned = some("extraction_warnings") if not keep_warnings else F.lit(False)
    empty = ~has_text("text") & (visual_text_corpus() == "") & ~some("tables")
    return F.when(warned, "extraction_warnings").when(F.col("summary_relevancy") < min_relevancy, "low_relevancy").when(empty, "empty").otherwise("keep")


def page_context() -> Column:
    """What a summarizer is shown of a page: text, numbered tables with cells between bars, image text."""
    def table(t: Column, i: Column) -> Column:
        return F.concat(F.lit("Table "), (i + 1).cast("string"), F.lit(":\n"), F.array_join(F.transform(t, lambda r: F.array_join(r, " | ")), "\n"))

    image = F.coalesce(strip("image_text"), F.lit(""))
    parts = F.concat(
        F.array(F.coalesce(strip("text"), F.lit(""))),
        F.coalesce(F.transform("tables", table), F.array().cast("array<string>")),
        F.array(F.when(image != "", F.concat(F.lit("Image extraction:\n"), image)).otherwise("")),
    )
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def token_sum(texts: Column) -> Column:
    """Estimated tokens of all the texts of an array."""
    from folio_spark.functions.text import estimate_tokens

    return F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda n, x: n + estimate_tokens(x))


def page_tokens() -> Column:
    """Estimated tokens of text and every table cell."""
    return token_sum(F.array("text")) + token_sum(F.flatten(F.flatten("tables")))


def vision_tokens() -> Column:
    """Estimated tokens of the image texts, and one for a classification."""
    return F.col("image_classifier").isNotNull().cast("bigint") + token_sum(F.array(*VISUAL))
