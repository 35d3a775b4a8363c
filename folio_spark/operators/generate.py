"""Generator lanes: training passages, question-answer pairs and their scores, from seed pages through a provider.

A lane is three plans: work items with their prompts, made in the JVM; one provider call for each
item inside ``mapInPandas`` (``ask``); and records made of the answers. Answers are written to a table
before records and failures are read off them, so no call is made twice; items whose key is done are left out by an anti join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions.text import question_hash, score_value, strip, word_count
from folio_spark.operators import graph
from folio_spark.operators.enrich import Answer, Provider
from folio_spark.operators.synth import MIN_WORDS, STYLES, message
from folio_spark.session import materialize, numbered, skip_empty

#: How much of a page a prompt shows, and the size that budgets are measured by.
MATERIAL_CHARS, REPHRASE_CHARS, VISION_CHARS, JUDGE_CHARS, TOKEN_BASE = 1500, 4000, 5000, 6000, 142_500
AGAIN = "\n\nReturn ONLY the JSON array."


def content(*columns: str) -> Column:
    """The filled ones of some columns, with blank lines between."""
    return F.array_join(F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in columns]), lambda x: x != ""), "\n\n")


def once(seeds: DataFrame) -> DataFrame:
    """Seeds with one row for each page number of a document: that of the page delivered last."""
    last = F.max_by(F.struct(*[c for c in seeds.columns if c not in ("document_id", "page_number")]), "page_id")
    return seeds.groupBy("document_id", "page_number").agg(last.alias("_s")).select("document_id", "page_number", "_s.*")


def json_array(raw: str) -> list:
    """The JSON array from the first ``[`` to the last ``]`` of an answer; a ValueError if there is none."""
    found = re.search(r"\[.*\]", raw, re.DOTALL)
    if not found:
        raise ValueError("no JSON array found")
    value = json.loads(found.group())
    if not isinstance(value, list):
        raise ValueError("JSON payload is not an array")
    return value


def _index(item: object, name: str) -> int | None:
    try:
        return int(item[name]) if isinstance(item, dict) else None
    except (KeyError, TypeError, ValueError):
        return None


def pairs_of(raw: str) -> list:
    """Question and answer of each item, trimmed; anything else than an object is null, and counted as rejected later."""
    def text(x: object) -> str:
        return str(x or "").strip()

    return [{"question": text(p.get("question")), "answer": text(p.get("answer"))} if isinstance(p, dict) else None for p in json_array(raw)]


def passages_of(raw: str) -> list:
    """index (from 0) and its filled passages; a string is one passage, the last item of an index holds."""
    out: dict[int, list[str]] = {}
    for item in json_array(raw):
        at = _index(item, "index")
        said = item.get("passages") if at is not None else None
        said = [said] if isinstance(said, str) else said
        if isinstance(said, list) and (clean := [t for p in said if (t := str(p).strip())]):
            out[at] = clean
    return [{"index": k, "passages": v} for k, v in sorted(out.items())]


def scores_of(raw: str) -> list:
    """i (from 1) and its scores as text; the last item of an index holds."""
    out = {at: item for item in json_array(raw) if (at := _index(item, "i")) is not None}
    plain = lambda x: None if x is None or isinstance(x, (bool, list, dict)) else str(x)
    return [{"i": k, **{f: plain(v.get(f)) for f in ("groundedness", "clarity", "usefulness")}} for k, v in sorted(out.items())]


ANSWER = "key string, answer string, tokens bigint, error string"


def ask(work: DataFrame, provider: Provider, kind: str, parse: Callable[[str], list] | None = None, done: DataFrame | None = None) -> DataFrame:
    """key, answer, tokens, error for every item of ``work`` (key, prompt) that isn't ``done`` (key).

    With ``parse`` the answer is its result as JSON; an answer that can't be parsed is asked for once more, and its tokens are
    added. An error stays with its item and stops no other.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf.key, pdf.prompt):
                said, tokens, error = None, 0, None
                try:
                    for suffix in ("", AGAIN):
                        answer = provider.ask(kind, prompt + suffix)
                        tokens += answer.tokens
                        try:
                            said, error = answer.text.strip() if parse is None else json.dumps(parse(answer.text)), None
                            break
                        except ValueError as e:
                            error = f"json parse failed: {e}"
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((key, said, tokens, error))
            yield pd.DataFrame(rows, columns=["key", "answer", "tokens", "error"])

    if done is not None:
        work = work.join(done.select("key").distinct(), "key", "left_anti")
    return work.select("key", "prompt").mapInPandas(skip_empty(run), ANSWER)


def _style(at: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STYLES]), (at % len(STYLES)).cast("int"))


def _page_key(kind: str) -> Column:
    return F.concat_ws(":", F.lit(kind), "document_id", F.col("page_number").cast("string"))


def tuple_items(pages: DataFrame, seeds: DataFrame, pairs: int = 4000, triples: int = 1000) -> DataFrame:
    """key, kind, style, entities, prompt: drawn pairs and triples of entities with the source material of up to four pages.

    Pairs come from one page or document; only if there are too few, others are drawn across
    documents. Styles rotate over all items.
    """
    near = graph.page_pairs(pages).select("a", "b").unionByName(graph.document_pairs(pages))
    drawn = materialize(graph.draw(near, pairs), "drawn")
    missing = pairs - drawn.count()
    if missing > 0:
        drawn = drawn.unionByName(graph.cross_pairs(pages, missing).select("a", "b"))
    both = drawn.withColumn("c", F.lit(None).cast("string")).unionByName(graph.draw(graph.document_triples(pages), triples))
    both = materialize(both, "tuples")
    material = graph.tuple_material(pages, both).join(seeds.select("page_id", "filename", "page_number", "text", "tables_md", "visual_text"), "page_id")
    shown = F.concat(F.lit("["), F.coalesce("filename", F.lit("None")), F.lit(" p"), F.col("page_number").cast("string"), F.lit("]\n"), F.left(F.coalesce("text", F.lit("")), F.lit(MATERIAL_CHARS)), F.lit("\n"), F.coalesce("tables_md", F.lit("")), F.lit("\n"), F.coalesce("visual_text", F.lit("")))
    listed = material.groupBy("a", "b", "c").agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("x")))).alias("all"))
    entities = F.array_compact(F.array("a", "b", "c"))
    named = numbered(listed.select(entities.alias("entities"), F.array_join(F.transform("all", lambda x: x.x), "\n---\n").alias("material")), [F.size("entities"), "entities"], "at")
    kind = F.when(F.size("entities") == 2, "entigraph").otherwise("entigraph3")
    style = _style(F.col("at"))
    prompt = F.concat(F.lit("Write one passage of 200 to 400 words, as "), style, F.lit(", that connects the entities from this material alone.\nENTITIES: "), F.array_join("entities", ", "), F.lit("\nMATERIAL:\n"), F.col("material"))
    return named.select(F.concat(F.when(F.size("entities") == 2, "pair:").otherwise("triple:"), F.array_join("entities", "|")).alias("key"), kind.alias("kind"), style.alias("style"), "entities", prompt.alias("prompt"))


def rephrase_items(seeds: DataFrame, rephrasings: int = 8) -> DataFrame:
    """key, kind, style, document_id, page_number, prompt: each seed page in ``rephrasings`` styles, drawn by a hash of page and style."""
    styles = F.array_sort(F.transform(F.array(*[F.lit(s) for s in STYLES]), lambda s: F.struct(F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), s), 256).alias("o"), s.alias("s"))))
    each = seeds.select("*", F.explode(F.slice(styles, 1, min(rephrasings, len(STYLES)))).alias("_d")).withColumn("style", F.col("_d.s"))
    shown = F.left(content("text", "tables_md", "visual_text"), F.lit(REPHRASE_CHARS))
    prompt = F.concat(F.lit("Rewrite the page as "), F.col("style"), F.lit("; keep every fact, number and name.\nCONTENT:\n"), shown)
    return each.select(F.concat_ws(":", _page_key("rephrase"), "style").alias("key"), F.lit("rephrase").alias("kind"), "style", "document_id", "page_number", prompt.alias("prompt"))


def structure_prompts(seeds: DataFrame, per_page: int = 24) -> DataFrame:
    """key, kind, style, document_id, page_number, prompt: ``per_page`` passages on the layout of each seed page."""
    each = seeds.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_page - 1))).alias("k")).withColumn("style", _style(F.col("k")))
    prompt = F.concat(F.lit("State the layout of this page as "), F.col("style"), F.lit(": document, page, lists and tables with their sizes, which entry belongs where.\nDOCUMENT: "), F.coalesce("filename", F.lit("")), F.lit("\nPAGE: "), F.col("page_number").cast("string"), F.lit("\nCONTENT:\n"), content("text", "tables_md", "visual_text"))
    return each.select(F.concat_ws(":", _page_key("struct"), F.col("k").cast("string")).alias("key"), F.lit("structure").alias("kind"), "style", "document_id", "page_number", prompt.alias("prompt"))


def passages(items: DataFrame, answers: DataFrame) -> DataFrame:
    """The items with text, gen_tokens and reject_reason (null: a record): answers with fewer words than their kind needs are rejected."""
    least = F.create_map(*[F.lit(x) for k, v in (("entigraph", MIN_WORDS["entigraph"]), ("entigraph3", MIN_WORDS["entigraph"]), ("rephrase", MIN_WORDS["rephrase"]), ("structure", MIN_WORDS["structure"])) for x in (k, v)])[F.col("kind")]
    short = F.when(word_count("answer") < least, F.concat(F.lit("rejected: output under "), least.cast("string"), F.lit(" words")))
    return items.drop("prompt").join(answers, "key").select(*[c for c in items.columns if c != "prompt"], F.col("answer").alias("text"), F.col("tokens").alias("gen_tokens"), F.coalesce("error", short).alias("reject_reason"))


def vision_prompts(seeds: DataFrame, batch_pages: int = 4, per_page: int = 4) -> DataFrame:
    """key, prompt, members (place, document_id, filename, page_number): seed pages with visual text, ``batch_pages`` to a prompt."""
    chosen = numbered(seeds.where(strip("visual_text") != ""), ["page_id"], "at").withColumn("batch", F.floor(F.col("at") / batch_pages)).withColumn("place", (F.col("at") % batch_pages).cast("int"))
    topics = F.array_join(F.coalesce("summary_topics", F.array().cast("array<string>")), ", ")
    shown = F.concat(
        F.lit("INDEX: "), F.col("place").cast("string"), F.lit("\nDOCUMENT: "), F.coalesce("filename", F.lit("(unknown)")), F.lit("\nDOCUMENT_ID: "), F.col("document_id"), F.lit("\nPAGE: "), F.col("page_number").cast("string"),
        F.lit("\nTOPICS: "), F.coalesce(F.nullif(topics, F.lit("")), F.lit("(none)")), F.lit("\nVISION/OCR CONTENT:\n"), F.left(content("visual_text", "tables_md", "text"), F.lit(VISION_CHARS)),
    )
    member = F.struct("place", "document_id", "filename", "page_number", shown.alias("shown"))
    merged = chosen.groupBy("batch").agg(F.array_sort(F.collect_list(member)).alias("members"))
    text = F.array_join(F.transform("members", lambda m: m.shown), "\n\n")
    name = F.lpad(F.col("batch").cast("string"), 4, "0")
    return merged.select(
        F.concat(F.lit("vision_batch:"), F.when(F.col("batch") < 10_000, name).otherwise(F.col("batch").cast("string"))).alias("key"), "batch",
        F.concat(F.lit(f"Write {per_page} passages on what the visual text of each page says. Return ONLY a JSON array of objects with index and passages.\n\n"), text).alias("prompt"),
        F.transform("members", lambda m: F.struct(m.place.alias("place"), m.document_id.alias("document_id"), m.filename.alias("filename"), m.page_number.alias("page_number"))).alias("members"),
    )


def vision_records(items: DataFrame, answers: DataFrame, per_page: int = 4, min_words: int = MIN_WORDS["vision"]) -> DataFrame:
    """key, batch_key, text, style, gen_tokens, document_id, filename, page_number of the passages long enough, joined with their page by its place in the batch."""
    said = F.from_json("answer", "array<struct<index int, passages array<string>>>")
    rows = items.join(answers.where("error IS NULL"), "key").select(F.col("key").alias("batch_key"), "batch", F.size("members").alias("n"), "tokens", F.explode("members").alias("m"), said.alias("said"))
    own = F.get(F.filter("said", lambda x: x.index == F.col("m.place")), F.lit(0)).passages
    each = rows.select("*", F.posexplode(F.slice(own, 1, per_page)).alias("k", "text")).where(word_count("text") >= min_words)
    return each.select(
        F.concat_ws(":", F.lit("vision"), "m.document_id", F.col("m.page_number").cast("string"), F.col("k").cast("string")).alias("key"), "batch_key", "text", _style(F.col("batch") + F.col("k")).alias("style"),
        F.floor(F.col("tokens") / F.greatest(F.lit(1), F.col("n") * per_page)).alias("gen_tokens"), "m.document_id", "m.filename", "m.page_number",
    )


def qa_items(seeds: DataFrame, per_fact: int = 10) -> DataFrame:
    """key, document_id, page_number, prompt: one for every seed page."""
    def shown(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit("(none)"))

    facts = F.array_join(F.transform(F.coalesce("summary_notes", F.array().cast("array<string>")), lambda n: F.concat(F.lit("- "), n)), "\n")
    topics = F.array_join(F.coalesce("summary_topics", F.array().cast("array<string>")), ", ")
    prompt = F.concat(
        F.lit(f"For each key fact write {per_fact} question-answer pairs that this page supports. Return ONLY a JSON array of objects with question and answer.\nPAGE ("), shown(F.col("filename")), F.lit(", page "), F.col("page_number").cast("string"), F.lit("):\n"), shown(F.col("text")),
        F.lit("\nTABLES:\n"), shown(F.col("tables_md")), F.lit("\nVISUAL TEXT:\n"), shown(F.col("visual_text")), F.lit("\nTOPICS: "), shown(topics), F.lit("\nKEY FACTS:\n"), shown(facts),
    )
    return seeds.select(_page_key("qa").alias("key"), "document_id", "page_number", prompt.alias("prompt"))


def qa_records(items: DataFrame, answers: DataFrame, system: str, generator: str, known: DataFrame | None = None) -> DataFrame:
    """key, messages, _source, generator, qhash: pairs with a question and an answer of ten words, the first of each question
    by key and place, and none of the ``known`` ones (qhash)."""
    said = F.from_json("answer", "array<struct<question string, answer string>>")
    each = items.drop("prompt").join(answers.where("error IS NULL"), "key").select("key", "document_id", "page_number", F.posexplode(said).alias("at", "p"))
    good = each.where((F.coalesce("p.question", F.lit("")) != "") & (word_count("p.answer") >= MIN_WORDS["answer"])).withColumn("qhash", question_hash("p.question"))
    first = good.groupBy("qhash").agg(F.min(F.struct("key", "at", "document_id", "page_number", "p")).alias("f"))
    if known is not None:
        first = first.join(known.select("qhash").distinct(), "qhash", "left_anti")
    turns = F.array(*[F.struct(F.lit(r).alias("role"), t.alias("content")) for r, t in (("system", F.lit(system)), ("user", F.col("f.p.question")), ("assistant", F.col("f.p.answer")))])
    return first.select("f.key", turns.alias("messages"), F.struct("f.document_id", "f.page_number").alias("_source"), F.lit(generator).alias("generator"), "qhash")


def judge_items(records: DataFrame, seeds: DataFrame, batch_size: int = 15) -> DataFrame:
    """key, prompt, members (place from 1, pair_id): the records of one page, ``batch_size`` to a prompt, with what that page holds."""
    at = records.select("pair_id", F.col("_source.document_id").alias("document_id"), F.col("_source.page_number").alias("page_number"), message("user").alias("q"), message("assistant").alias("a"))
    place = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("pair_id")) - 1
    at = at.withColumn("_at", place).withColumn("batch", F.floor(F.col("_at") / batch_size).cast("int")).withColumn("place", (F.col("_at") % batch_size + 1).cast("int"))
    shown = F.concat(F.col("place").cast("string"), F.lit(". Q: "), F.coalesce("q", F.lit("")), F.lit("\n   A: "), F.coalesce("a", F.lit("")))
    merged = at.groupBy("document_id", "page_number", "batch").agg(F.array_sort(F.collect_list(F.struct("place", "pair_id", shown.alias("shown")))).alias("members"))
    source = once(seeds).select("document_id", "page_number", content("text", "tables_md", "visual_text").alias("text"))
    both = merged.join(source, ["document_id", "page_number"], "left")
    prompt = F.concat(F.lit("Score each pair from 1 to 10 for groundedness, clarity and usefulness by this page alone. Return ONLY a JSON array of objects with i, groundedness, clarity and usefulness.\nSOURCE PAGE:\n"), F.left(F.coalesce(F.nullif("text", F.lit("")), F.lit("(missing source page content)")), F.lit(JUDGE_CHARS)), F.lit("\nPAIRS:\n"), F.array_join(F.transform("members", lambda m: m.shown), "\n"))
    return both.select(F.concat_ws(":", F.lit("judge"), F.coalesce("document_id", F.lit("")), F.coalesce(F.col("page_number").cast("string"), F.lit("")), F.col("batch").cast("string")).alias("key"), prompt.alias("prompt"), F.transform("members", lambda m: F.struct(m.place.alias("place"), m.pair_id.alias("pair_id"))).alias("members"))


def judged(items: DataFrame, answers: DataFrame, judge_model: str) -> DataFrame:
    """pair_id, key, judge: each record with the scores of its place in the batch; null scores where there is none."""
    said = F.from_json("answer", "array<struct<i int, groundedness string, clarity string, usefulness string>>")
    rows = items.join(answers.where("error IS NULL"), "key").select("key", F.explode("members").alias("m"), said.alias("said"))
    own = F.get(F.filter("said", lambda x: x.i == F.col("m.place")), F.lit(0))
    scores = [score_value(own[f]).alias(f) for f in ("groundedness", "clarity", "usefulness")]
    return rows.select("m.pair_id", "key", F.struct(*scores, F.lit(judge_model).alias("judge_model")).alias("judge"))


def failures(items: DataFrame, answers: DataFrame, kind: str, endpoint: str, at: Column | None = None) -> DataFrame:
    """key, kind, reason, endpoint, ts: the sink of items without an answer."""
    return items.select("key").join(answers.where("error IS NOT NULL"), "key").select("key", F.lit(kind).alias("kind"), F.col("error").alias("reason"), F.lit(endpoint).alias("endpoint"), (at if at is not None else F.current_timestamp()).alias("ts"))


def manifest(records: DataFrame, failed: DataFrame, total: int, skipped: int = 0) -> DataFrame:
    """One row: records by kind, tokens, their share of the token base, failed items, and the work done and left.

    ``records``: kind, gen_tokens and, if rejected, reject_reason.
    """
    reason = F.col("reject_reason") if "reject_reason" in records.columns else F.lit(None).cast("string")
    rows = records.select("kind", reason.isNull().alias("kept"), "gen_tokens", F.lit(0).alias("failed"))
    rows = rows.unionByName(failed.select("kind", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast("bigint").alias("gen_tokens"), F.lit(1).alias("failed")))
    by = rows.groupBy("kind").agg(F.count_if("kept").alias("n"), F.count_if(~F.col("kept")).alias("rejected"), F.sum("gen_tokens").alias("tokens"), F.sum("failed").alias("failed"))
    return by.agg(
        F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: x.n > 0)).alias("counts_by_kind"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected_count"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_count"), (F.coalesce(F.sum("tokens"), F.lit(0)) / TOKEN_BASE).alias("budget_fraction"),
        F.lit(total).alias("total"), F.lit(skipped).alias("skipped_existing"), F.lit(total - skipped).alias("queued"),
    )


class Echo(Provider):
    """A deterministic stand-in for a generator: passages are the material shown, pairs the key facts, scores all eight."""

    def ask(self, kind: str, prompt: str, tier: int = 1) -> Answer:
        if kind == "passage":
            return self._said(re.split(r"\n(?:CONTENT|MATERIAL):\n", prompt, maxsplit=1)[-1])
        if kind == "qa":
            facts = [line[2:] for line in prompt.split("\nKEY FACTS:\n", 1)[1].split("\n") if line.startswith("- ")]
            return self._said("Here: " + json.dumps([{"question": f"What follows from this: {f}", "answer": f} for f in facts]))
        if kind == "judge":
            return self._said(json.dumps([{"i": int(i), "groundedness": 8, "clarity": "7.5", "usefulness": 8 - int(i) % 2} for i in re.findall(r"^(\d+)\. Q: ", prompt.split("\nPAIRS:\n", 1)[1], re.MULTILINE)]))
        if kind == "vision":
            parts = re.split(r"^INDEX: (\d+)$", prompt, flags=re.MULTILINE)[1:]
            return self._said(json.dumps([{"index": int(k), "passages": [t.split("VISION/OCR CONTENT:\n", 1)[1].strip()]} for k, t in zip(parts[::2], parts[1::2])]))
        return self._said("")

    @staticmethod
    def _said(text: str) -> Answer:
        return Answer(text, estimated_tokens(text))


def estimated_tokens(text: str) -> int:
    """For models that report no usage: words times 1.35."""
    return round(len(text.split()) * 1.35)
