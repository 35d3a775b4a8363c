"""Splitting oversized texts at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.session import skip_empty, table

DEFAULT_SIZE, DEFAULT_OVERLAP = 3000, 80

_ATOM = re.compile(r"\S+\s*|\s+")
_TAIL = re.compile(r"[\"'”’»)\]]*$")
WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(5)
INSIDE = -1


def boundary(atom: str) -> int:
    """How strong the boundary after ``atom`` (a word with the blanks that follow it) is."""
    word = atom.rstrip()
    blanks = atom[len(word) :]
    if any(c in blanks for c in "\n\r\f\u2028\u2029"):
        lines = blanks.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n")
        return PARAGRAPH if lines.count("\n") > 1 or "\f" in lines or "\u2029" in lines else LINE
    last = _TAIL.sub("", word)[-1:]
    if last and last in ".!?…。！？":
        return SENTENCE
    return CLAUSE if last and last in ",;:" else WORD


def spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) in code points of the pieces of ``text``, in order, each at most ``size``.

    Every piece but the first begins ``overlap`` code points before the end of the one
    before it. Atoms are words with their trailing blanks; one longer than a piece may be
    is cut inside. Adjacent pieces wait in a heap, the weakest boundary first and the
    shortest pair first among equals, and merge while pair plus overlap fits. A pair that
    doesn't fit never will, since pieces only grow, so each pair is looked at once.
    """
    if len(text) <= size:
        return [(0, len(text))]
    core = size - overlap
    ends: list[int] = []
    strength: list[int] = []
    for m in _ATOM.finditer(text):
        a, b = m.span()
        kind = boundary(m.group())
        while b - a > core:
            a += core
            ends.append(a)
            strength.append(INSIDE)
        ends.append(b)
        strength.append(kind)
    n = len(ends)
    start = [0, *ends[:-1]]
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n

    def fits(i: int, j: int) -> bool:
        return ends[j] - start[i] + (overlap if start[i] else 0) <= size

    heap = [(strength[i], ends[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        kind, length, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or ends[j] - start[i] != length or not fits(i, j):
            continue
        ends[i], strength[i], right[i], alive[j] = ends[j], strength[j], right[j], False
        if right[i] >= 0:
            left[right[i]] = i
            heapq.heappush(heap, (strength[i], ends[right[i]] - start[i], i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (strength[left[i]], ends[i] - start[left[i]], left[i], i))
    return [(max(0, start[i] - overlap), ends[i]) for i in range(n) if alive[i]]


def settings(doc_outputs: DataFrame, configs: DataFrame) -> DataFrame:
    """document_id, chunk_size, chunk_overlap; nulls where defaults apply. One row per document."""
    cfg = configs.groupBy("config_hash").agg(F.max("chunk_size").alias("chunk_size"), F.max("chunk_overlap").alias("chunk_overlap"))
    return (
        doc_outputs.select("document_id", "config_hash").join(cfg, "config_hash", "left")
        .groupBy("document_id").agg(F.max("chunk_size").alias("chunk_size"), F.max("chunk_overlap").alias("chunk_overlap"))
    )


def split_oversized(pages: DataFrame, per_document: DataFrame) -> DataFrame:
    """page_id, piece_no, start, n_chars, text: the pieces of every page's text, in order.

    The size is the one of the page's document in ``per_document`` (see ``settings``).
    A null size, or one under 1, means 3000 and a null or negative overlap 80. An overlap
    that is not below the size can't be repeated whole; half of the size is repeated then.
    A text within its size is one piece, unchanged, also the empty text; a null text has
    no piece. Pages given twice are split twice. Other columns of ``pages`` are ignored,
    whatever their names. Texts within the least size of all meet no settings, only oversized texts leave the JVM.
    """
    least = min(DEFAULT_SIZE, per_document.where("chunk_size >= 1").agg(F.min("chunk_size")).first()[0] or DEFAULT_SIZE)
    size = F.when(F.col("chunk_size") >= 1, F.col("chunk_size")).otherwise(F.lit(DEFAULT_SIZE))
    overlap = F.when(F.col("chunk_overlap") >= 0, F.col("chunk_overlap")).otherwise(F.lit(DEFAULT_OVERLAP))
    sized = (
        pages.select("page_id", "document_id", "text").where(f"text IS NOT NULL AND length(text) > {least}")
        .join(per_document, "document_id", "left")
        .select("page_id", "text", size.alias("size"), overlap.alias("overlap"))
        .withColumn("overlap", F.expr("IF(overlap >= size, size div 2, overlap)").cast("int"))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (page, k, a, b - a, text[a:b])
                for page, text, n, o in zip(pdf.page_id, pdf.text, pdf["size"], pdf.overlap)
                for k, (a, b) in enumerate(spans(text, int(n), int(o)))
            ]
            for at in range(0, len(rows), 5000):
                yield pd.DataFrame(rows[at : at + 5000], columns=["page_id", "piece_no", "start", "n_chars", "text"])

    schema = "page_id bigint, piece_no int, start int, n_chars int, text string"
    whole = sized.where("length(text) <= size").select("page_id", "text").unionByName(pages.where(f"length(text) <= {least}").select("page_id", "text"))
    whole = whole.selectExpr("page_id", "0 AS piece_no", "0 AS start", "length(text) AS n_chars", "text")
    return sized.where("length(text) > size").mapInPandas(skip_empty(cut), schema).unionByName(whole)


def pieces(spark: SparkSession, root: str) -> DataFrame:
    return split_oversized(table(spark, root, "pages"), settings(table(spark, root, "doc_outputs"), table(spark, root, "pipeline_configs")))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages that the splitter had to cut: those with a second piece."""
    return pieces(spark, root).where("piece_no = 1").select("page_id")


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    return pieces(spark, root)


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL = {
    "p1_found": """
SELECT p.page_id FROM pages p LEFT JOIN doc_outputs d USING (document_id)
LEFT JOIN (SELECT config_hash, max(chunk_size) AS chunk_size FROM pipeline_configs GROUP BY config_hash) c USING (config_hash)
WHERE length(p.text) > coalesce(c.chunk_size, 3000)"""
}
