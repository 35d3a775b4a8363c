"""Query verbs over pages; everything is a lazy DataFrame, so unused columns are never read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.functions import pages as P
from folio_spark.functions.tables import csv_line
from folio_spark.functions.text import strip
from folio_spark.session import skip_empty

#: The fields of a page that can be asked for.
FIELDS = (
    "chunk_id", "doc_title", "document_id", "page_number", "text", "tables", "extraction_warnings", "embedded_images", "image_base64", "image_text", "image_classifier",
    "summary_notes", "summary_topics", "summary_relevancy", "summary_quality_validated", "summary_notes_1", "summary_notes_2", "summary_notes_3", "summary_budget_exhausted", "visual_text",
)


def parse_range(spec: str) -> list[int]:
    """Sorted page numbers of ``"1-3,8"``; a ValueError for empty parts, zero, or a falling range."""
    out: set[int] = set()
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if not m or not int(m[1]) or int(m[2] or m[1]) < int(m[1]):
            raise ValueError(f"no page range: {spec!r}")
        out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(out)


def sample_range(total: int, n: int) -> list[int]:
    """``n`` page numbers of ``total``, at least one: the front third, the middle around the centre, the rest at the end, topped up from 1."""
    n = max(1, min(n, total))
    front, middle = -(-n // 3), (n + 1) // 3
    centre = max(1, total // 2 - middle // 2 + 1)
    wanted = [*range(1, front + 1), *range(centre, centre + middle), *range(total - n + front + middle + 1, total + 1)]
    out = {p for p in wanted if 1 <= p <= total}
    for p in range(1, total + 1):
        if len(out) >= n:
            break
        out.add(p)
    return sorted(out)


class PagesFrame:
    """Pages with the query verbs; ``select_range`` narrows, the others answer."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def select_range(self, spec: str) -> "PagesFrame":
        return PagesFrame(self.pages.where(P.effective_page_number().isin(parse_range(spec))))

    def fields(self, names: list[str]) -> DataFrame:
        """page_id, page_number and the named fields; a ValueError names the valid ones."""
        if wrong := [n for n in names if n not in FIELDS]:
            raise ValueError(f"no such field: {', '.join(wrong)}; valid are {', '.join(FIELDS)}")
        picked = [P.visual_text_query().alias(n) if n == "visual_text" else F.col(n) for n in names if n != "page_number"]
        return self.pages.select("page_id", P.effective_page_number().alias("page_number"), *picked)

    def summary(self) -> DataFrame:
        return self.pages.select("page_id", "document_id", P.effective_page_number().alias("page_number"), P.first_description().alias("description"))

    def documents(self, doc_outputs: DataFrame) -> DataFrame:
        """document_id, filename, total_pages, metadata, metrics of the documents of these pages; what a summary says of them before its pages."""
        wanted = self.pages.select("document_id").distinct()
        return doc_outputs.join(wanted, "document_id", "left_semi").select("document_id", "filename", "total_pages", F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.to_json("metrics").alias("metrics"))

    def topics(self) -> DataFrame:
        """topic, mentions: as written, trimmed, without blank ones; by number, then name."""
        named = self.pages.select(F.explode("summary_topics").alias("t")).select(strip("t").alias("topic")).where("topic != ''")
        return named.groupBy("topic").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), F.lower("topic"), "topic")

    def stats(self, *by: str) -> DataFrame:
        return self.pages.groupBy(*by).agg(
            F.count("*").alias("pages"), F.count_if(P.visual_text_query() != "").alias("with_vision"),
            F.count_if(P.has_summary()).alias("with_summaries"), F.count_if(P.some("tables")).alias("with_tables"),
        )

    def tables(self) -> DataFrame:
        """page_id, table_no, csv: every table of every page."""
        at = self.pages.select("page_id", F.posexplode("tables").alias("at", "t"))
        return at.select("page_id", (F.col("at") + 1).alias("table_no"), F.array_join(F.transform("t", csv_line), "\n").alias("csv"))

    def grep_text(self) -> DataFrame:
        """page_id, flat: text, notes and visual text with white space made single blanks."""
        notes = F.array_join(F.coalesce("summary_notes", F.array().cast("array<string>")), "\n")
        every = F.concat_ws("\n", F.coalesce("text", F.lit("")), notes, P.visual_text_query())
        return self.pages.select("page_id", strip(F.regexp_replace(every, r"(?U)\s+", " ")).alias("flat"))

    def grep_counts(self, pattern: str) -> DataFrame:
        """page_id, hits: pages with a match, in any case."""
        return self.grep_text().select("page_id", F.regexp_count("flat", F.lit(f"(?i){pattern}")).alias("hits")).where("hits > 0")

    def grep(self, pattern: str, around: int = 80) -> DataFrame:
        """page_id, match_no, snippet: every match with ``around`` characters on either side."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = re.compile(pattern, re.IGNORECASE)
            for pdf in batches:
                rows = [(p, k, t[max(0, m.start() - around) : m.end() + around]) for p, t in zip(pdf.page_id, pdf.flat) for k, m in enumerate(found.finditer(t))]
                yield pd.DataFrame(rows, columns=["page_id", "match_no", "snippet"])

        return self.grep_text().where(F.col("flat").rlike(f"(?i){pattern}")).mapInPandas(skip_empty(run), "page_id bigint, match_no int, snippet string")

    def without_images(self) -> DataFrame:
        """Pages without image payloads; what describes an image stays."""
        return self.pages.drop("image_base64").withColumn("embedded_images", F.transform("embedded_images", lambda x: x.dropFields("base64")))
