"""Corpus compilation: seeds, manifests, the run catalog, and training splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import pages as P
from folio_spark.functions.tables import corpus_markdown
from folio_spark.functions.text import strip
from folio_spark.session import materialize, numbered

MIN_RELEVANCY, TOKENS_PER_PAGE = 70, 500


def newest(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in ``order``."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def catalog_latest(runs: DataFrame) -> DataFrame:
    """The newest completed run per output path."""
    done = runs.where("status = 'completed' AND output_json_path IS NOT NULL")
    return newest(done, ["output_json_path"], [F.desc("run_ts"), F.desc("run_id")])


def cache_lookup(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """``wanted`` (input_sha256, config_hash) with the newest completed run that has an output; a null run is a miss."""
    done = runs.where("status = 'completed' AND output_json_path IS NOT NULL").select("input_sha256", "config_hash", "run_ts", "run_id", "output_json_path")
    hit = newest(done, ["input_sha256", "config_hash"], [F.desc("run_ts"), F.desc("run_id")]).drop("run_ts")
    return wanted.join(hit, ["input_sha256", "config_hash"], "left")


def kept(pages: DataFrame, min_relevancy: int = MIN_RELEVANCY) -> DataFrame:
    return pages.where(P.drop_reason(min_relevancy) == "keep")


def seeds(pages: DataFrame, doc_outputs: DataFrame, runs: DataFrame, min_relevancy: int = MIN_RELEVANCY) -> DataFrame:
    """Kept pages as seeds, with the hashes of the newest run of their document's output.

    Without such a run the source hash is one of the document id.
    """
    latest = catalog_latest(runs).select(F.regexp_extract("output_json_path", r"([^/]+)\.json$", 1).alias("document_id"), "input_sha256", F.col("config_hash").alias("run_config"))
    latest = newest(latest, ["document_id"], [F.desc("input_sha256")])
    files = doc_outputs.select("document_id", "filename").dropDuplicates(["document_id"])
    rows = kept(pages, min_relevancy).join(files, "document_id", "left").join(latest, "document_id", "left")
    return rows.select(
        "page_id", "document_id", "filename", F.coalesce("input_sha256", F.sha2("document_id", 256)).alias("source_sha256"), F.col("run_config").alias("config_hash"),
        P.effective_page_number().alias("page_number"), "text", P.visual_text_corpus().alias("visual_text"), corpus_markdown(F.coalesce("tables", F.array().cast("array<array<array<string>>>"))).alias("tables_md"),
        "summary_notes", F.filter(F.array("summary_notes_1", "summary_notes_2", "summary_notes_3"), lambda x: F.size(x) > 0).alias("summary_notes_passes"),
        "summary_topics", "summary_relevancy", "summary_quality_validated",
    )


def seeds_manifest(pages: DataFrame, min_relevancy: int = MIN_RELEVANCY) -> DataFrame:
    """Per document: pages, kept, dropped by reason, kept with tables and with visual text, planned tokens."""
    r = P.drop_reason(min_relevancy)
    rows = pages.select("document_id", r.alias("reason"), P.some("tables").alias("t"), (P.visual_text_corpus() != "").alias("v"))
    return rows.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("reason") == "keep").alias("kept"),
        *[F.count_if(F.col("reason") == k).alias(f"dropped_{k}") for k in ("extraction_warnings", "low_relevancy", "empty")],
        F.count_if((F.col("reason") == "keep") & F.col("t")).alias("with_tables"), F.count_if((F.col("reason") == "keep") & F.col("v")).alias("with_visual"),
        (F.count_if(F.col("reason") == "keep") * TOKENS_PER_PAGE).alias("planned_tokens"),
    )


def brief_topics(pages: DataFrame) -> DataFrame:
    """topic, mentions, label: topics whatever their case; the label is the first spelling in page order."""
    named = pages.select("page_id", F.posexplode("summary_topics").alias("at", "t")).select(strip("t").alias("label"), F.struct("page_id", "at").alias("o")).where("label != ''")
    return named.groupBy(F.lower("label").alias("topic")).agg(F.count("*").alias("mentions"), F.min_by("label", "o").alias("label"))


def validation_documents(documents: DataFrame, share_pct: int, seed: str) -> DataFrame:
    """document_id of about ``share_pct`` percent of all documents, by a hash of seed and id; whole documents, so no leak."""
    at = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col("document_id")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return documents.select("document_id").distinct().where(at < share_pct)


def hash_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows in the order of a hash of seed and key: a repeatable sample."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def sampled(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``hash_sample`` for samples of any size: the first ``n`` of a distributed order."""
    order = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    return numbered(rows.withColumn("_o", order), ["_o", key], "_n").where(F.col("_n") < n).drop("_o", "_n")


def mix_outputs(sft: DataFrame, general: DataFrame, cpt: DataFrame, general_ratio: float = 0.25, replay_ratio: float = 0.05, split: float = 0.9, seed: str = "mix") -> DataFrame:
    """output, messages, text, place: the records of the training files train_sft, val, valid (val again) and train_cpt, without what only the pipeline needs.

    ``sft``: pair_id, messages, _source; ``general``: pair_id, messages; ``cpt``: key, text. General records make up ``general_ratio`` of the
    training mix, as far as there are enough. Documents beyond ``split`` in the order of a hash go to validation whole. The last
    messages of a sample of the general records, ``replay_ratio`` of the texts, are replayed among the texts. ``place`` is a shuffled order.
    """
    if not 0 <= general_ratio < 1:
        raise ValueError("general_ratio must be at least 0 and below 1")
    wanted = min(general.count(), int(sft.count() * general_ratio / (1 - general_ratio)))
    drawn = materialize(sampled(general.select("pair_id", "messages"), "pair_id", wanted, seed), "mix-general")
    documents = sft.select(F.col("_source.document_id").alias("document_id")).where("document_id IS NOT NULL").distinct().withColumn("_o", F.sha2(F.concat(F.lit(seed), "document_id"), 256))
    placed = numbered(documents, ["_o", "document_id"], "_n")
    val = placed.where(F.col("_n") >= int(documents.count() * split)).select("document_id", F.lit(True).alias("_val"))
    rows = sft.select("pair_id", "messages", F.col("_source.document_id").alias("document_id")).join(val, "document_id", "left")
    own = rows.select(F.when(F.col("_val"), "val").otherwise("train_sft").alias("output"), "pair_id", "messages")
    replay = sampled(drawn, "pair_id", min(int(cpt.count() * replay_ratio), wanted), f"{seed}-replay")
    last = F.coalesce(F.get(F.col("messages"), F.size("messages") - 1).content, F.lit(""))
    texts = cpt.select(F.col("key").cast("string").alias("k"), "text").unionByName(replay.select(F.concat(F.lit("replay:"), F.col("pair_id").cast("string")).alias("k"), last.alias("text")).where("text != ''"))
    talks = own.unionByName(drawn.select(F.lit("train_sft").alias("output"), "pair_id", "messages"))
    talks = talks.unionByName(talks.where("output = 'val'").withColumn("output", F.lit("valid")))
    talks = talks.select("output", F.col("pair_id").cast("string").alias("k"), "messages", F.lit(None).cast("string").alias("text"))
    every = talks.unionByName(texts.select(F.lit("train_cpt").alias("output"), "k", F.lit(None).cast(talks.schema["messages"].dataType).alias("messages"), "text"))
    return every.select("output", "k", "messages", "text", F.xxhash64("output", "k", F.lit(seed)).alias("place"))


def corpus_totals(pages: DataFrame, min_relevancy: int = MIN_RELEVANCY) -> DataFrame:
    """One row: documents, pages kept and dropped, distinct topics of the kept pages, and the token budget that they are good for."""
    rows = seeds_manifest(pages, min_relevancy)
    topics = kept(pages, min_relevancy).select(F.explode("summary_topics").alias("t")).select(F.lower(strip("t")).alias("topic"))
    counted = rows.select(F.lit(1).alias("documents"), "kept", (F.col("pages") - F.col("kept")).alias("dropped"), F.lit(0).alias("topics"))
    counted = counted.unionByName(topics.distinct().select(F.lit(0).alias("documents"), F.lit(0).alias("kept"), F.lit(0).alias("dropped"), F.lit(1).alias("topics")))
    total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("documents", "documents"), ("kept", "pages_kept"), ("dropped", "pages_dropped"), ("topics", "distinct_topics"))])
    real = F.col("pages_kept") * TOKENS_PER_PAGE
    return total.select("*", real.alias("real_tokens"), (real * 50).alias("target_50x"), (real * 100).alias("target_100x"))


def brief_lines(pages: DataFrame, doc_outputs: DataFrame, notes: int = 5) -> DataFrame:
    """section, document_id, place, line of a corpus brief: the inventory, topics by mentions, and the first ``notes`` descriptions of each document."""
    docs = doc_outputs.select("document_id", "filename", "total_pages").dropDuplicates(["document_id"])
    nothing = F.lit(None).cast("string")
    inventory = docs.select(F.lit("inventory").alias("section"), "document_id", F.lit(0).cast("bigint").alias("place"), F.concat(F.lit("| "), F.coalesce("filename", F.lit("document")), F.lit(" | "), F.coalesce(F.col("total_pages").cast("string"), F.lit("0")), F.lit(" |")).alias("line"))
    topics = brief_topics(pages).select(F.lit("topics").alias("section"), nothing.alias("document_id"), (-F.col("mentions")).alias("place"), F.concat(F.lit("| "), "label", F.lit(" | "), F.col("mentions").cast("string"), F.lit(" |")).alias("line"))
    said = pages.select("document_id", "pos", "page_id", P.first_description().alias("note")).where("coalesce(note, '') != ''")
    first = said.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("pos", "page_id")).cast("bigint")).where(F.col("place") <= notes)
    return inventory.unionByName(topics).unionByName(first.select(F.lit("digests").alias("section"), "document_id", "place", F.concat(F.lit("- "), "note").alias("line")))
