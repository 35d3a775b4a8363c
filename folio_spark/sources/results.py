"""Result files: JSON documents and JSON lines, tolerant of broken ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "array<struct<id:string,relationship_id:string,content_type:string,filename:string,alt_text:string,base64:string>>"
PAGE = (
    "chunk_id:string,doc_title:string,page_number:int,text:string,tables:array<array<array<string>>>,extraction_warnings:array<string>,html:string,"
    f"embedded_images:{IMAGES},image_base64:string,image_text:string,image_classifier:boolean,image_text_1:string,image_text_2:string,image_text_3:string,"
    "summary_notes:array<string>,summary_topics:array<string>,summary_relevancy:double,summary_quality_validated:boolean,"
    "summary_notes_1:array<string>,summary_notes_2:array<string>,summary_notes_3:array<string>,summary_budget_exhausted:string"
)
RESULT = f"document struct<document_id:string,filename:string,total_pages:int,metadata:string>, pages array<struct<{PAGE}>>, metrics string, _corrupt_record string"


def read_results(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row per result file with its path; files that are no object with ``document`` are left out."""
    rows = spark.read.schema(RESULT).option("multiLine", True).option("mode", "PERMISSIVE").json(paths).withColumn("path", F.col("_metadata.file_path"))
    return rows.where("document IS NOT NULL AND document.document_id IS NOT NULL").drop("_corrupt_record")


def result_pages(results: DataFrame) -> DataFrame:
    """Pages of results with document_id and pos. Scores are whole percents; others, and those outside 0..100, are null."""
    at = results.select(F.col("document.document_id").alias("document_id"), "path", F.posexplode("pages").alias("pos", "p")).select("document_id", "path", "pos", "p.*")
    score = F.round("summary_relevancy").cast("int")
    return at.withColumn("summary_relevancy", F.when(score.between(0, 100), score))


def read_lines(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """JSON lines; lines that can't be parsed are dropped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = spark.read.text(paths).select(F.from_json("value", f"{schema}, _corrupt_record string", options).alias("r"), "value")
    return parsed.where("r._corrupt_record IS NULL AND trim(value) <> ''").select("r.*").drop("_corrupt_record")


def write_lines(rows: DataFrame, path: str, mode: str = "append", nulls: bool = False) -> None:
    """Append rows as JSON lines; null members are written only if asked for."""
    rows.write.mode(mode).option("ignoreNullFields", not nulls).json(path)
