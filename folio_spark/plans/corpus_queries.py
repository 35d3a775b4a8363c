"""Queries over corpora, entities and training records."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio_spark.functions import pages as P
from folio_spark.functions import text as X
from folio_spark.operators import corpus, exports, graph, synth
from folio_spark.operators.pages import PagesFrame
from folio_spark.plans import sql as S
from folio_spark.session import table


def _t(name):
    return lambda s, r: table(s, r, name)


_pages, _outputs, _runs, _sft = (_t(n) for n in ("pages", "doc_outputs", "runs", "sft"))


def _seeds(s, r):
    rows = corpus.seeds(_pages(s, r), _outputs(s, r), _runs(s, r))
    return rows.select("page_id", "document_id", "filename", "source_sha256", "config_hash", "page_number", "visual_text", "tables_md", "summary_relevancy")


def _work_left(s, r):
    items = synth.structure_items(corpus.kept(_pages(s, r)))
    done = items.where(F.col("key").endswith(":0")).select("key")
    return synth.remaining(items, done)


def _probe(s, r):
    """Closed-book answers stand in: up to three assistant messages of a record against its first one."""
    answers = F.slice(F.filter("messages", lambda m: (m.role == "assistant") & m.content.isNotNull()), 1, 3)
    hits = F.size(F.filter(answers, lambda m: X.token_overlap(F.col("gold"), m.content) >= 0.5))
    rows = _sft(s, r).withColumn("gold", synth.message("assistant")).where("gold IS NOT NULL").withColumn("hits", hits)
    return rows.select("pair_id", "hits", (F.col("hits") >= 2).alias("known"))


def _overlap(s, r):
    rows = _sft(s, r)
    return rows.select("pair_id", F.round(X.token_overlap(synth.message("user"), synth.message("assistant")), 6).alias("overlap"))


def _split(s, r):
    val = corpus.validation_documents(_sft(s, r).select(F.col("_source.document_id").alias("document_id")).where("document_id IS NOT NULL"), 10, "v1")
    rows = _sft(s, r).select("pair_id", F.col("_source.document_id").alias("document_id"))
    held = rows.join(val, "document_id", "left_semi").select("pair_id", F.lit("validation").alias("split"))
    return held.unionByName(rows.join(val, "document_id", "left_anti").select("pair_id", F.lit("train").alias("split")))


def _wanted(s, r):
    return _runs(s, r).where("input_sha256 IS NOT NULL").select("input_sha256", F.col("config_hash")).distinct()


def _tuples(pages):
    """a, b, c: 200 drawn pairs of one document and 200 drawn triples."""
    pairs = graph.draw(graph.document_pairs(pages), 200).withColumn("c", F.lit(None).cast("string"))
    return pairs.unionByName(graph.draw(graph.document_triples(pages), 200))


QUERIES = {
    "drop_reasons": lambda s, r: _pages(s, r).groupBy(P.drop_reason(corpus.MIN_RELEVANCY).alias("reason")).agg(F.count("*").alias("pages")),
    "seeds": _seeds,
    "seeds_manifest": lambda s, r: corpus.seeds_manifest(_pages(s, r)),
    "amplification_budget": lambda s, r: corpus.kept(_pages(s, r)).agg(F.count("*").alias("kept"), (F.count("*") * 500).alias("planned_tokens"), (F.count("*") * 500 * 50).alias("low_target"), (F.count("*") * 500 * 100).alias("high_target")),
    "catalog_latest": lambda s, r: corpus.catalog_latest(_runs(s, r)).select("output_json_path", "run_id", "input_sha256", "config_hash"),
    "cache_lookup": lambda s, r: corpus.cache_lookup(_wanted(s, r), _runs(s, r)),
    "cache_miss": lambda s, r: corpus.cache_lookup(_wanted(s, r), _runs(s, r)).where("run_id IS NULL").select("input_sha256", "config_hash"),
    "entity_postings": lambda s, r: graph.postings(_pages(s, r)),
    "entity_pairs_same_page": lambda s, r: graph.page_pairs(_pages(s, r)),
    "entity_pairs_same_document": lambda s, r: graph.document_pairs(_pages(s, r)),
    "entity_triples_document": lambda s, r: graph.document_triples(_pages(s, r)),
    "entity_pairs_cross": lambda s, r: graph.cross_pairs(_pages(s, r), 500),
    "entity_tuple_material": lambda s, r: graph.tuple_material(_pages(s, r), _tuples(_pages(s, r))),
    "structure_items": lambda s, r: synth.structure_items(corpus.kept(_pages(s, r))),
    "work_items_remaining": _work_left,
    "vision_batches": lambda s, r: synth.vision_items(corpus.kept(_pages(s, r))),
    "judge_batches": lambda s, r: synth.batches(_sft(s, r).select("pair_id", F.col("_source.document_id").alias("document_id")), ["document_id"], ["pair_id"], 5),
    "judge_accept": lambda s, r: synth.rejudge(_sft(s, r)),
    "judge_rekey": lambda s, r: synth.rekey(_sft(s, r)).select("pair_id", "key", F.col("_source.sft_key").alias("kept_key")),
    "question_dedupe": lambda s, r: synth.first_questions(_sft(s, r)),
    "token_overlap": _overlap,
    "probe_split": _probe,
    "grounding_pages": lambda s, r: synth.grounded(_sft(s, r), _pages(s, r)),
    "mix_split": _split,
    "mix_general_sample": lambda s, r: corpus.hash_sample(_sft(s, r).select("pair_id", "generator"), "pair_id", 200, "mix"),
    "training_scrub": lambda s, r: synth.scrub(_sft(s, r)).select("pair_id", "generator", F.size("messages").alias("turns")),
    "output_counts": lambda s, r: _sft(s, r).groupBy("generator").agg(F.count("*").alias("records"), F.sum(X.estimate_tokens(synth.message("assistant"))).alias("tokens"), F.count_if(F.col("judge").isNotNull()).alias("judged")),
    "slugs": lambda s, r: _outputs(s, r).select("document_id", X.slugify("filename").alias("slug")),
    "document_tags": lambda s, r: exports.document_tags(_pages(s, r)).select("document_id", F.array_join("tags", "; ").alias("tags")),
    "markdown_reports": lambda s, r: exports.markdown_reports(_pages(s, r), _outputs(s, r)),
    "report_parts": lambda s, r: exports.report_parts(_pages(s, r)),
    "bundle_files": lambda s, r: exports.bundle_files(_pages(s, r), _outputs(s, r), "2030-01-01T00:00:00Z"),
    "single_files": lambda s, r: exports.single_files(_pages(s, r), _outputs(s, r), "2030-01-01T00:00:00Z"),
    "page_records": lambda s, r: exports.page_records(_pages(s, r)).select("page_id", F.get_json_object("line", "$.page_number").cast("int").alias("number"), F.get_json_object("line", "$.text").alias("text")),
    "table_records": lambda s, r: exports.table_records(_pages(s, r), _outputs(s, r)).select("page_id", "document_id", "filename", "page_number", "table_index", F.size("rows").alias("n_rows"), "path"),
    "brief_inventory": lambda s, r: _pages(s, r).join(_outputs(s, r).select("document_id", "filename"), "document_id").groupBy("filename").agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("pages"), F.count_if(P.has_summary()).alias("summarised")),
}
_REASON_N = "count(*) FILTER (reason = '{0}')"
_MANIFEST = f"SELECT document_id, {S.REASON} AS reason, {S.some('tables')} AS t, ({S.VISUAL_CORPUS} <> '') AS v FROM pages"
_LATEST = "SELECT * FROM runs WHERE status = 'completed' AND output_json_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY output_json_path ORDER BY run_ts DESC, run_id DESC) = 1"
_HIT = "SELECT input_sha256, config_hash, run_id, output_json_path FROM runs WHERE status = 'completed' AND output_json_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY input_sha256, config_hash ORDER BY run_ts DESC, run_id DESC) = 1"
_WANTED = "SELECT DISTINCT input_sha256, config_hash FROM runs WHERE input_sha256 IS NOT NULL"
_CACHE = f"SELECT w.input_sha256, w.config_hash, h.run_id, h.output_json_path FROM ({_WANTED}) w LEFT JOIN ({_HIT}) h ON w.input_sha256 = h.input_sha256 AND w.config_hash = h.config_hash"
_MENTIONS = f"SELECT DISTINCT entity, page_id, document_id FROM (SELECT lower({S.strip('x')}) AS entity, page_id, document_id FROM (SELECT unnest(summary_topics) AS x, page_id, document_id FROM pages)) WHERE entity <> ''"
_PAIRS = f"SELECT x.entity AS a, y.entity AS b, x.page_id FROM m x JOIN m y ON x.page_id = y.page_id AND x.entity < y.entity"
_STYLES = ", ".join(f"'{x}'" for x in synth.STYLES)
_ITEMS = f"SELECT 'struct:' || document_id || ':' || {S.PAGE_NO} || ':' || k AS key, page_id, [{_STYLES}][CAST(k % 10 AS INTEGER) + 1] AS style FROM pages, range(0, 24) v(k) WHERE {S.REASON} = 'keep'"
_FIRST = "list_filter(messages, lambda m: m.role = '{0}')[1].content"
_TOK = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9%$.]{{3,}}'))"
_BATCH = "SELECT {0}, document_id, CAST(floor((row_number() OVER (PARTITION BY document_id ORDER BY {0}) - 1) / {1}) AS INTEGER) AS batch, CAST((row_number() OVER (PARTITION BY document_id ORDER BY {0}) - 1) % {1} AS INTEGER) AS place FROM {2}"
_QHASH = "sha256(regexp_replace(lower(" + _FIRST.format("user") + r"), '[^\p{L}\p{N}\p{M}_]', '', 'g'))"
_REASONS = "CASE WHEN judge.groundedness IS NULL OR judge.usefulness IS NULL OR judge.clarity IS NULL THEN 'judge_no_score' ELSE concat_ws(',', CASE WHEN judge.groundedness < 7 THEN 'low_groundedness' END, CASE WHEN judge.usefulness < 7 THEN 'low_usefulness' END, CASE WHEN judge.clarity < 6 THEN 'low_clarity' END) END"
_TAG = f"SELECT document_id, tag, min((pos, page_id, k)) AS o FROM (SELECT document_id, pos, page_id, k, {S.strip('x')} AS tag FROM (SELECT document_id, pos, page_id, unnest(summary_topics) AS x, generate_subscripts(summary_topics, 1) AS k FROM pages)) WHERE tag <> '' GROUP BY document_id, tag"
_OVERLAP_OF = "(len(list_intersect({0}, {1})) / greatest(1, len({0})))"
_TABLE_PART = f"list_concat(CASE WHEN len(tables) > 1 THEN ['#### Table ' || i] ELSE [] END, list_filter([CASE WHEN coalesce(list_max(list_transform(t, lambda r: len(r))), 0) = 0 THEN '' ELSE {S.md_table('t')} END], lambda x: x <> ''), [''])"
_PARTS = f"""SELECT document_id, pos, page_id, array_to_string(list_concat(['## Page ' || coalesce(page_number, pos + 1), ''],
 CASE WHEN {S.some('summary_topics')} THEN list_concat(['### Topics'], list_transform(summary_topics, lambda x: '- ' || x), ['']) ELSE [] END, CASE WHEN {S.some('summary_notes')} THEN list_concat(['### Summary Notes'], list_transform(summary_notes, lambda x: '- ' || x), ['']) ELSE [] END,
 CASE WHEN NOT noted AND {S.filled('text')} THEN ['### Extracted Text', {S.strip('text')}, ''] ELSE [] END, CASE WHEN NOT noted AND {S.some('tables')} THEN list_concat(['### Tables'], flatten(list_transform(tables, lambda t, i: {_TABLE_PART}))) ELSE [] END), chr(10)) AS part
 FROM (SELECT *, bool_or({S.HAS_SUMMARY}) OVER (PARTITION BY document_id) AS noted FROM pages) WHERE {S.HAS_SUMMARY} OR NOT noted"""
_ALL_PAIRS = f"SELECT DISTINCT x.entity AS a, y.entity AS b FROM m x JOIN m y ON x.document_id = y.document_id AND x.entity < y.entity EXCEPT SELECT a, b FROM ({_PAIRS})"
_ALL_TRIPLES = "SELECT DISTINCT x.entity AS a, y.entity AS b, z.entity AS c FROM o x JOIN o y ON x.document_id = y.document_id AND x.entity < y.entity JOIN o z ON z.document_id = x.document_id AND y.entity < z.entity"
_OWN = f"m AS ({_MENTIONS}), o AS (SELECT DISTINCT document_id, entity FROM m)"
SQL = {
    "drop_reasons": f"SELECT {S.REASON} AS reason, count(*) AS pages FROM pages GROUP BY 1",
    "seeds": f"""SELECT p.page_id, p.document_id, d.filename, coalesce(l.input_sha256, sha256(p.document_id)) AS source_sha256, l.config_hash, {S.PAGE_NO} AS page_number, {S.VISUAL_CORPUS} AS visual_text,
 coalesce((SELECT string_agg({S.md_table('t', padded=False)}, chr(10) || chr(10) ORDER BY k) FROM (SELECT q.page_id AS id, unnest(q.tables) AS t, generate_subscripts(q.tables, 1) AS k FROM pages q) u WHERE u.id = p.page_id AND len(t) > 0), '') AS tables_md, summary_relevancy
 FROM pages p LEFT JOIN doc_outputs d ON d.document_id = p.document_id LEFT JOIN (SELECT regexp_extract(output_json_path, '([^/]+)\\.json$', 1) AS document_id, input_sha256, config_hash FROM ({_LATEST}) x QUALIFY row_number() OVER (PARTITION BY regexp_extract(x.output_json_path, '([^/]+)\\.json$', 1) ORDER BY x.input_sha256 DESC) = 1) l ON l.document_id = p.document_id
 WHERE {S.REASON} = 'keep'""",
    "seeds_manifest": "SELECT document_id, count(*) AS pages, " + _REASON_N.format("keep") + " AS kept, " + ", ".join(_REASON_N.format(k) + f" AS dropped_{k}" for k in ("extraction_warnings", "low_relevancy", "empty")) + f", count(*) FILTER (reason = 'keep' AND t) AS with_tables, count(*) FILTER (reason = 'keep' AND v) AS with_visual, 500 * count(*) FILTER (reason = 'keep') AS planned_tokens FROM ({_MANIFEST}) GROUP BY document_id",
    "amplification_budget": f"SELECT count(*) AS kept, count(*) * 500 AS planned_tokens, count(*) * 25000 AS low_target, count(*) * 50000 AS high_target FROM pages WHERE {S.REASON} = 'keep'",
    "catalog_latest": f"SELECT output_json_path, run_id, input_sha256, config_hash FROM ({_LATEST})",
    "cache_lookup": _CACHE,
    "cache_miss": f"SELECT input_sha256, config_hash FROM ({_CACHE}) WHERE run_id IS NULL",
    "entity_postings": f"SELECT entity, count(*) AS pages, count(DISTINCT document_id) AS documents FROM ({_MENTIONS}) GROUP BY entity",
    "entity_pairs_same_page": f"WITH m AS ({_MENTIONS}) SELECT a, b, count(*) AS pages FROM ({_PAIRS}) GROUP BY a, b",
    "entity_pairs_same_document": f"WITH m AS ({_MENTIONS}) {_ALL_PAIRS}",
    "entity_triples_document": f"WITH {_OWN} {_ALL_TRIPLES}",
    "entity_pairs_cross": f"""WITH {_OWN}, e AS (SELECT entity, row_number() OVER (ORDER BY sha256('cross' || entity), entity) - 1 AS spot FROM (SELECT entity FROM m GROUP BY entity HAVING count(*) >= 2)), z AS (SELECT count(*) AS n FROM e),
 p AS (SELECT x.entity AS x, y.entity AS y, x.spot AS spot, (y.spot - x.spot + n) % n AS apart FROM e x, e y, z WHERE x.spot <> y.spot AND (2 * ((y.spot - x.spot + n) % n) < n OR (2 * ((y.spot - x.spot + n) % n) = n AND x.spot < y.spot)))
 SELECT least(x, y) AS a, greatest(x, y) AS b, CAST(apart AS INTEGER) AS apart FROM (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM o q JOIN o r ON q.document_id = r.document_id WHERE q.entity = p.x AND r.entity = p.y) ORDER BY apart, spot LIMIT 500)""",
    "entity_tuple_material": f"""WITH {_OWN}, t AS (SELECT * FROM (SELECT a, b, NULL::VARCHAR AS c FROM ({_ALL_PAIRS}) ORDER BY sha256(concat_ws('|', 'draw', a, b)), a, b LIMIT 200) UNION ALL SELECT * FROM (SELECT * FROM ({_ALL_TRIPLES}) ORDER BY sha256(concat_ws('|', 'draw', a, b, c)), a, b, c LIMIT 200)),
 h AS (SELECT t.*, CASE WHEN t.c IS NULL THEN 2 ELSE 3 END AS k, m.* FROM t JOIN m ON m.entity IN (t.a, t.b, t.c)), d AS (SELECT a, b, c, document_id, count(DISTINCT entity) AS shared FROM h GROUP BY ALL),
 p AS (SELECT a, b, c, k, page_id, document_id, count(DISTINCT entity) AS n FROM h GROUP BY ALL), q AS (SELECT p.*, max(n) OVER (PARTITION BY p.a, p.b, p.c) AS top, shared FROM p JOIN d ON p.a = d.a AND p.b = d.b AND p.c IS NOT DISTINCT FROM d.c AND p.document_id IS NOT DISTINCT FROM d.document_id)
 SELECT a, b, c, page_id, CAST(row_number() OVER (PARTITION BY a, b, c ORDER BY CASE WHEN top = k THEN n < k ELSE shared < k END, page_id) AS INTEGER) AS place FROM q QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY CASE WHEN top = k THEN n < k ELSE shared < k END, page_id) <= 4""",
    "structure_items": _ITEMS,
    "work_items_remaining": f"SELECT * FROM ({_ITEMS}) WHERE NOT ends_with(key, ':0')",
    "vision_batches": f"SELECT page_id, printf('vision_batch:%04d', CAST(n // 4 AS BIGINT)) AS key, CAST(n % 4 AS INTEGER) AS place FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS n FROM pages WHERE {S.REASON} = 'keep' AND {S.VISUAL_CORPUS} <> '')",
    "judge_batches": _BATCH.format("pair_id", 5, "(SELECT pair_id, _source.document_id AS document_id FROM sft)"),
    "judge_accept": f"SELECT pair_id, CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS verdict, reason FROM (SELECT pair_id, {_REASONS} AS reason FROM sft)",
    "judge_rekey": "SELECT pair_id, 'judged:' || coalesce(sft_key, CAST(pair_id AS VARCHAR)) AS key, coalesce(_source.sft_key, sft_key) AS kept_key FROM sft",
    "question_dedupe": f"SELECT min(pair_id) AS pair_id, qhash FROM (SELECT pair_id, {_QHASH} AS qhash FROM sft) WHERE qhash IS NOT NULL GROUP BY qhash",
    "token_overlap": f"SELECT pair_id, round({_OVERLAP_OF.format(_TOK.format(_FIRST.format('user')), _TOK.format(_FIRST.format('assistant')))}, 6) AS overlap FROM sft",
    "probe_split": f"SELECT pair_id, CAST(hits AS INTEGER) AS hits, hits >= 2 AS known FROM (SELECT pair_id, len(list_filter(list_filter(messages, lambda m: m.role = 'assistant' AND m.content IS NOT NULL)[1:3], lambda a: {_OVERLAP_OF.format(_TOK.format('gold'), _TOK.format('a.content'))} >= 0.5)) AS hits FROM (SELECT pair_id, messages, {_FIRST.format('assistant')} AS gold FROM sft) WHERE gold IS NOT NULL)",
    "grounding_pages": f"SELECT pair_id, coalesce(text, '') AS page_text FROM sft s LEFT JOIN (SELECT document_id, {S.PAGE_NO} AS n, arg_max(text, page_id) AS text FROM pages GROUP BY 1, 2) p ON p.document_id = s._source.document_id AND p.n = s._source.page_number",
    "mix_split": "SELECT pair_id, CASE WHEN CAST('0x' || left(sha256('v1' || _source.document_id), 8) AS BIGINT) % 100 < 10 THEN 'validation' ELSE 'train' END AS split FROM sft",
    "mix_general_sample": "SELECT pair_id, generator FROM sft ORDER BY sha256('mix' || pair_id), pair_id LIMIT 200",
    "training_scrub": "SELECT pair_id, generator, CAST(len(messages) AS INTEGER) AS turns FROM sft",
    "output_counts": f"SELECT generator, count(*) AS records, CAST(sum({S.tokens(_FIRST.format('assistant'))}) AS BIGINT) AS tokens, count(*) FILTER (judge IS NOT NULL) AS judged FROM sft GROUP BY generator",
    "slugs": "SELECT document_id, CASE WHEN s = '' THEN 'document' ELSE s END AS slug FROM (SELECT document_id, regexp_replace(lower(regexp_replace(regexp_replace(filename, '\\.[A-Za-z0-9]{1,5}$', ''), '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS s FROM doc_outputs)",
    "document_tags": f"SELECT document_id, array_to_string(list(tag ORDER BY o, tag)[1:30], '; ') AS tags FROM ({_TAG}) GROUP BY document_id",
    "report_parts": _PARTS,
    "markdown_reports": f"SELECT p.document_id, '# ' || coalesce(any_value(d.filename), p.document_id) || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY pos, page_id) AS markdown FROM ({_PARTS}) p LEFT JOIN doc_outputs d ON d.document_id = p.document_id GROUP BY p.document_id",
    "page_records": f"SELECT page_id, CAST({S.PAGE_NO} AS INTEGER) AS number, text FROM pages",
    "table_records": f"SELECT p.page_id, p.document_id, d.filename, n AS page_number, CAST(k - 1 AS INTEGER) AS table_index, CAST(len(t) AS INTEGER) AS n_rows, printf('tables/page-%04d-table-%d.csv', n, k) AS path FROM (SELECT page_id, document_id, {S.PAGE_NO} AS n, unnest(tables) AS t, generate_subscripts(tables, 1) AS k FROM pages) p LEFT JOIN doc_outputs d ON d.document_id = p.document_id",
    "brief_inventory": f"SELECT filename, count(DISTINCT p.document_id) AS documents, count(*) AS pages, count(*) FILTER ({S.HAS_SUMMARY}) AS summarised FROM pages p JOIN doc_outputs d ON d.document_id = p.document_id GROUP BY filename",
}


def _stub(s, r):
    from folio_spark.operators.enrich import Stub, summaries

    return summaries(_pages(s, r), Stub()).select("page_id", F.array_join("notes", "\n").alias("notes"), F.array_join("topics", "; ").alias("topics"), "relevancy", "validated", "attempts", "tokens")


def _passthrough(s, r):
    from folio_spark.operators.enrich import passthrough

    return passthrough(_pages(s, r)).select("page_id", F.array_join("notes", "\n").alias("notes"), "relevancy", "validated")


def _stages(s, r):
    """Stage metrics of all documents: sums, and the floor of the mean score."""
    at = _outputs(s, r).select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(f"metrics.stages.{k}").alias("m")) for k in ("extraction", "vision", "summarization")])).alias("x")).where("x.m IS NOT NULL")
    return at.groupBy("x.stage").agg(F.count("*").alias("documents"), F.sum("x.m.pages_processed").alias("pages"), F.sum("x.m.tokens").alias("tokens"), F.sum("x.m.total_attempts").alias("attempts"), F.floor(F.sum("x.m.avg_relevancy") / F.count("x.m.avg_relevancy")).alias("avg_relevancy"))


def _plain_seeds(s, r):
    return corpus.seeds(_pages(s, r), _outputs(s, r), _runs(s, r))


def _made(items, kind, parse=None):
    from folio_spark.operators import generate as G
    from folio_spark.session import materialize

    items = materialize(items, "items")
    return items, materialize(G.ask(items, G.Echo(), kind, parse), "answers")


def _rephrased(s, r):
    from folio_spark.operators import generate as G

    return G.passages(*_made(G.rephrase_items(G.once(_plain_seeds(s, r)), 2), "passage")).select("key", "style", "text", "reject_reason")


def _tuple_passages(s, r):
    from folio_spark.operators import generate as G

    made = G.passages(*_made(G.tuple_items(_pages(s, r), _plain_seeds(s, r), 200, 100), "passage"))
    return made.select("key", "kind", F.size("entities").alias("n"), F.regexp_count("text", F.lit("\n---\n")).alias("breaks"))


def _asked(s, r):
    from folio_spark.operators import generate as G

    made = G.qa_records(*_made(G.qa_items(G.once(_plain_seeds(s, r))), "qa", G.pairs_of), "sys", "echo")
    return made.select("key", "qhash", synth.message("assistant").alias("answer"))


def _seen(s, r):
    from folio_spark.operators import generate as G

    return G.vision_records(*_made(G.vision_prompts(G.once(_plain_seeds(s, r))), "vision", G.passages_of), min_words=5).select("key", "batch_key", "text")


def _judged(s, r):
    from folio_spark.operators import generate as G

    return G.judged(*_made(G.judge_items(_sft(s, r), _plain_seeds(s, r)), "judge", G.scores_of), "echo").select("pair_id", "key", "judge.groundedness", "judge.clarity", "judge.usefulness")


def _manifest(s, r):
    from folio_spark.operators import generate as G

    items, answers = _made(G.rephrase_items(G.once(_plain_seeds(s, r)), 2), "passage")
    row = G.manifest(G.passages(items, answers), G.failures(items, answers, "rephrase", "echo"), items.count())
    return row.select(F.col("counts_by_kind")["rephrase"].alias("kept"), "rejected_count", "failed_count", "total")


def _mixed(s, r):
    """Records of one generator stand for the general ones, rejected ones for texts."""
    sft = _sft(s, r)
    general = sft.where("_source.document_id IS NULL OR pair_id IS NULL").select("pair_id", "messages")
    texts = _pages(s, r).where(P.has_text("text")).select(F.col("page_id").alias("key"), "text")
    return corpus.mix_outputs(sft, general.unionByName(sft.where("reject_reason IS NOT NULL").select("pair_id", "messages")), texts).select("output", "k", F.length("text").alias("chars"), F.size("messages").alias("turns"))


QUERIES |= {
    "mix_outputs": _mixed, "corpus_totals": lambda s, r: corpus.corpus_totals(_pages(s, r)), "brief_lines": lambda s, r: corpus.brief_lines(_pages(s, r), _outputs(s, r)),
    "document_heads": lambda s, r: PagesFrame(_pages(s, r)).documents(_outputs(s, r)).select("document_id", "filename", "total_pages", "metadata"),
}
QUERIES |= {
    "generate_rephrased": _rephrased, "generate_tuple_passages": _tuple_passages, "generate_questions": _asked, "generate_vision_passages": _seen, "generate_judged": _judged, "generate_manifest": _manifest,
}
QUERIES |= {"summarize_passthrough": _passthrough, "summarize_stub_loop": _stub, "stage_metrics": _stages}
_FIRST_LINE = f"list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')[1]"
_STAGE = "SELECT '{0}' AS stage, metrics.stages.{0} AS m FROM doc_outputs WHERE metrics.stages.{0} IS NOT NULL"
_ONCE = f"""SELECT document_id, page_number, arg_max(sd, page_id) AS sd FROM (SELECT s.page_id, s.document_id, s.page_number, struct_pack(id := s.page_id, filename := s.filename, text := p.text, tables_md := s.tables_md, visual_text := s.visual_text, notes := p.summary_notes, topics := p.summary_topics) AS sd FROM ({SQL['seeds']}) s JOIN pages p ON p.page_id = s.page_id) GROUP BY ALL"""
_FULL = "array_to_string(list_filter([coalesce(sd.{0}, ''), coalesce(sd.{1}, ''), coalesce(sd.{2}, '')], lambda x: x <> ''), chr(10) || chr(10))"
_REPHRASE = f"""SELECT 'rephrase:' || document_id || ':' || page_number || ':' || style AS key, style, {S.strip('left(' + _FULL.format('text', 'tables_md', 'visual_text') + ', 4000)')} AS text
 FROM (SELECT *, unnest(list_transform(list_sort(list_transform([{_STYLES}], lambda x: struct_pack(o := sha256(sd.id || '|' || x), s := x)))[1:2], lambda x: x.s)) AS style FROM ({_ONCE}))"""
_GENERAL = "SELECT pair_id, messages FROM sft WHERE _source.document_id IS NULL OR pair_id IS NULL UNION ALL SELECT pair_id, messages FROM sft WHERE reject_reason IS NOT NULL"
_DRAWN = f"SELECT pair_id, messages FROM (SELECT *, row_number() OVER (ORDER BY sha256('mix' || pair_id), pair_id) - 1 AS n FROM ({_GENERAL})) WHERE n < least((SELECT count(*) FROM ({_GENERAL})), (SELECT CAST(floor(count(*) * 0.25 / 0.75) AS BIGINT) FROM sft))"
SQL |= {
    "mix_outputs": f"""WITH g AS ({_DRAWN}), d AS (SELECT document_id, row_number() OVER (ORDER BY sha256('mix' || document_id), document_id) - 1 AS n FROM (SELECT DISTINCT _source.document_id AS document_id FROM sft WHERE _source.document_id IS NOT NULL)),
 v AS (SELECT document_id FROM d WHERE n >= (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM d)), o AS (SELECT CASE WHEN _source.document_id IN (SELECT document_id FROM v) THEN 'val' ELSE 'train_sft' END AS output, pair_id, messages FROM sft UNION ALL SELECT 'train_sft', pair_id, messages FROM g),
 c AS (SELECT page_id, text FROM pages WHERE {S.filled('text')}), p AS (SELECT *, row_number() OVER (ORDER BY sha256('mix-replay' || pair_id), pair_id) - 1 AS n FROM g)
 SELECT output, CAST(pair_id AS VARCHAR) AS k, NULL::INTEGER AS chars, CAST(len(messages) AS INTEGER) AS turns FROM o UNION ALL SELECT 'valid', CAST(pair_id AS VARCHAR), NULL, CAST(len(messages) AS INTEGER) FROM o WHERE output = 'val'
 UNION ALL SELECT 'train_cpt', CAST(page_id AS VARCHAR), length(text), NULL FROM c UNION ALL SELECT 'train_cpt', 'replay:' || pair_id, length(messages[-1].content), NULL FROM p WHERE n < least((SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM c), (SELECT count(*) FROM g)) AND coalesce(messages[-1].content, '') <> ''""",
    "corpus_totals": f"""SELECT count(DISTINCT document_id) AS documents, count(*) FILTER (reason = 'keep') AS pages_kept, count(*) FILTER (reason <> 'keep') AS pages_dropped, (SELECT count(DISTINCT lower({S.strip('x')})) FROM (SELECT unnest(summary_topics) AS x FROM pages WHERE {S.REASON} = 'keep')) AS distinct_topics,
 count(*) FILTER (reason = 'keep') * 500 AS real_tokens, count(*) FILTER (reason = 'keep') * 25000 AS target_50x, count(*) FILTER (reason = 'keep') * 50000 AS target_100x FROM (SELECT document_id, {S.REASON} AS reason FROM pages)""",
    "brief_lines": f"""SELECT 'inventory' AS section, document_id, 0 AS place, '| ' || coalesce(filename, 'document') || ' | ' || coalesce(CAST(total_pages AS VARCHAR), '0') || ' |' AS line FROM doc_outputs
 UNION ALL SELECT 'topics', NULL, -mentions, '| ' || label || ' | ' || mentions || ' |' FROM (SELECT lower(t) AS topic, count(*) AS mentions, arg_min(t, (page_id, k)) AS label FROM (SELECT page_id, k, {S.strip('x')} AS t FROM (SELECT page_id, unnest(summary_topics) AS x, generate_subscripts(summary_topics, 1) AS k FROM pages)) WHERE t <> '' GROUP BY 1)
 UNION ALL SELECT 'digests', document_id, n, '- ' || note FROM (SELECT document_id, note, row_number() OVER (PARTITION BY document_id ORDER BY pos, page_id) AS n FROM (SELECT document_id, pos, page_id, {S.DESCRIPTION} AS note FROM pages) WHERE coalesce(note, '') <> '') WHERE n <= 5""",
    "document_heads": "SELECT document_id, filename, total_pages, coalesce(metadata, '{}') AS metadata FROM doc_outputs WHERE document_id IN (SELECT document_id FROM pages)",
    "generate_rephrased": f"SELECT *, CASE WHEN {S.words('text')} < 50 THEN 'rejected: output under 50 words' END AS reject_reason FROM ({_REPHRASE})",
    "generate_questions": f"""WITH q AS (SELECT 'qa:' || document_id || ':' || page_number AS key, k, note, sha256(regexp_replace(lower('What follows from this: ' || note), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]', '', 'g')) AS qhash
 FROM (SELECT *, {S.strip('n')} AS note FROM (SELECT document_id, page_number, unnest(string_split(array_to_string(list_transform(sd.notes, lambda x: '- ' || x), chr(10)), chr(10))) AS line, generate_subscripts(string_split(array_to_string(list_transform(sd.notes, lambda x: '- ' || x), chr(10)), chr(10)), 1) AS k FROM ({_ONCE})) l, (SELECT 1) one, LATERAL (SELECT substr(l.line, 3) AS n) s WHERE starts_with(l.line, '- ')) WHERE {S.words('note')} >= 10)
 SELECT key, qhash, note AS answer FROM q QUALIFY row_number() OVER (PARTITION BY qhash ORDER BY key, k) = 1""",
    "generate_judged": "SELECT pair_id, 'judge:' || coalesce(document_id, '') || ':' || coalesce(CAST(n AS VARCHAR), '') || ':' || (spot // 15) AS key, 8 AS groundedness, 7 AS clarity, CAST(8 - (spot % 15 + 1) % 2 AS INTEGER) AS usefulness FROM (SELECT pair_id, _source.document_id AS document_id, _source.page_number AS n, row_number() OVER (PARTITION BY _source.document_id, _source.page_number ORDER BY pair_id) - 1 AS spot FROM sft)",
    "generate_manifest": f"SELECT count(*) FILTER ({S.words('text')} >= 50) AS kept, count(*) FILTER ({S.words('text')} < 50) AS rejected_count, 0 AS failed_count, count(*) AS total FROM ({_REPHRASE})",
    "summarize_passthrough": f"SELECT page_id, coalesce({_FIRST_LINE}, '') AS notes, 100 AS relevancy, false AS validated FROM pages",
    "stage_metrics": "SELECT stage, count(*) AS documents, CAST(sum(m.pages_processed) AS BIGINT) AS pages, CAST(sum(m.tokens) AS BIGINT) AS tokens, CAST(sum(m.total_attempts) AS BIGINT) AS attempts, CAST(floor(avg(m.avg_relevancy)) AS BIGINT) AS avg_relevancy FROM (" + " UNION ALL ".join(_STAGE.format(k) for k in ("extraction", "vision", "summarization")) + ") GROUP BY stage",
}
