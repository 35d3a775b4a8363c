"""Queries over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio_spark.functions import pages as P
from folio_spark.functions import tables as M
from folio_spark.functions import text as X
from folio_spark.operators import corpus
from folio_spark.operators.chunking import chunk
from folio_spark.operators.pages import PagesFrame
from folio_spark.operators.text_tables import footer_move, text_tables
from folio_spark.plans import sql as S
from folio_spark.session import table


def _pages(spark, root):
    return PagesFrame(table(spark, root, "pages"))


def _rows(spark, root):
    return table(spark, root, "pages")


def _all_tables(spark, root):
    return _rows(spark, root).select("page_id", F.posexplode("tables").alias("at", "t")).withColumn("table_no", F.col("at") + 1)


def _notes(spark, root):
    return _rows(spark, root).where(P.some("summary_notes")).select("page_id", F.array_join(F.transform("summary_notes", lambda n: F.concat(F.lit("* "), n)), "\n").alias("raw"), F.array_join("summary_topics", ", ").alias("topics"))


def _effort(spark, root):
    n = F.col("attempt")
    quality = F.when(n <= 5, 90).otherwise(85)
    tier = F.when(n <= 10, 1).when(n <= 20, 2).otherwise(3)
    return spark.range(1, 31).select(F.col("id").cast("int").alias("attempt")).select("attempt", quality.alias("threshold"), tier.alias("tier"), F.when(n <= 5, "primary").otherwise("fallback").alias("prompt"))


QUERIES = {
    "kept_topic_counts": lambda s, r: PagesFrame(corpus.kept(_rows(s, r))).topics(),
    "topic_counts": lambda s, r: _pages(s, r).topics(),
    "topic_counts_lower": lambda s, r: corpus.brief_topics(_rows(s, r)),
    "topic_top25": lambda s, r: corpus.brief_topics(_rows(s, r)).select("topic", "mentions").orderBy(F.desc("mentions"), "topic").limit(25),
    "page_stats": lambda s, r: _pages(s, r).stats(),
    "page_stats_by_document": lambda s, r: _pages(s, r).stats("document_id"),
    "effective_page_number": lambda s, r: _rows(s, r).select("page_id", P.effective_page_number().alias("number"), P.page_identity().alias("identity")),
    "page_range_filter": lambda s, r: _pages(s, r).select_range("1-3,8").pages.select("page_id", "document_id", P.effective_page_number().alias("number")),
    "fields_projection": lambda s, r: _pages(s, r).fields(["chunk_id", "doc_title", "summary_relevancy", "visual_text"]),
    "document_summary": lambda s, r: _pages(s, r).summary(),
    "grep_counts": lambda s, r: _pages(s, r).grep_counts("valve station|pump house"),
    "grep_snippets": lambda s, r: _pages(s, r).grep("valve station|pump house"),
    "table_csv": lambda s, r: _pages(s, r).tables(),
    "table_markdown_report": lambda s, r: _all_tables(s, r).select("page_id", "table_no", M.report_markdown(F.col("t")).alias("markdown")),
    "table_markdown_bundle": lambda s, r: _all_tables(s, r).select("page_id", "table_no", M.bundle_markdown(F.col("t")).alias("markdown")),
    "table_markdown_corpus": lambda s, r: _rows(s, r).where(P.some("tables")).select("page_id", M.corpus_markdown(F.col("tables")).alias("markdown")),
    "table_widths": lambda s, r: _all_tables(s, r).select("page_id", "table_no", M.width(F.col("t")).alias("columns"), F.size("t").alias("n_rows")),
    "without_images": lambda s, r: _pages(s, r).without_images().select("page_id", F.explode("embedded_images").alias("i")).select("page_id", "i.id", "i.content_type", "i.filename"),
    "unvalidated_summaries": lambda s, r: _rows(s, r).where(P.unvalidated_summary()).select("page_id", "summary_relevancy"),
    "summary_flags": lambda s, r: _rows(s, r).select("page_id", P.has_summary().alias("summary"), P.some("summary_notes").alias("notes"), P.some("summary_topics").alias("topics")),
    "visual_text": lambda s, r: _rows(s, r).where(P.visual_text_corpus() != "").select("page_id", P.visual_text_corpus().alias("corpus_form"), P.visual_text_query().alias("query_form")),
    "page_context": lambda s, r: _rows(s, r).select("page_id", P.page_context().alias("context")),
    "page_tokens": lambda s, r: _rows(s, r).select("page_id", P.page_tokens().alias("tokens"), X.word_count("text").alias("words")),
    "vision_tokens": lambda s, r: _rows(s, r).select("page_id", P.vision_tokens().alias("tokens")),
    "token_totals_by_document": lambda s, r: _rows(s, r).select("document_id", P.page_tokens().alias("t")).groupBy("document_id").agg(F.sum("t").alias("tokens")),
    "clean_bullets": lambda s, r: _notes(s, r).select("page_id", F.array_join(X.clean_bullets("raw"), "\n").alias("notes")),
    "clean_topics": lambda s, r: _notes(s, r).where("topics IS NOT NULL").select("page_id", F.array_join(X.clean_topics("topics"), "\n").alias("topics")),
    "parse_percent": lambda s, r: _rows(s, r).select("page_id", X.parse_percent(F.concat(F.lit("score: "), F.col("summary_relevancy").cast("string"), F.lit("%"))).alias("percent")),
    "quality_policy": _effort,
    "probe_documents": lambda s, r: _rows(s, r).groupBy("document_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"), F.sum(F.coalesce(F.size("tables"), F.lit(0))).alias("tables")),
    "call_estimate": lambda s, r: _rows(s, r).groupBy("document_id").agg(F.count("*").alias("pages"), (F.count("*") * 3).alias("detailed_calls"), F.count_if(P.some("embedded_images")).alias("vision_calls"), (F.count("*") * 300).alias("seconds_bound")),
    "chunk_windows": lambda s, r: chunk(table(s, r, "documents"), "doc_id"),
    "text_tables": lambda s, r: text_tables(_rows(s, r).select("page_id", "text"), "page_id"),
    "footer_move": lambda s, r: _rows(s, r).select("page_id", F.concat(F.lit("© 2030 Works\nAll rights\n\n"), F.regexp_replace("text", "\r", "")).alias("text")).select("page_id", footer_move(F.col("text")).alias("text")),
}


def _cut(w: str) -> str:
    """Where a window is cut: after its last separator that isn't at its beginning."""
    at = lambda sep, n: f"(CASE WHEN strpos(reverse(replace({w}, chr(13), chr(1))), reverse({sep})) = 0 THEN -1 ELSE length({w}) - strpos(reverse(replace({w}, chr(13), chr(1))), reverse({sep})) - {n} + 1 END)"
    seps = [("chr(10) || chr(10)", 2), ("chr(10)", 1), ("'. '", 2), ("' '", 1)]
    return "(CASE " + " ".join(f"WHEN {at(s, n)} > 0 THEN {at(s, n)} + {n}" for s, n in seps) + f" ELSE length({w}) END)"


_T = "SELECT page_id, document_id, {strip} AS t FROM (SELECT page_id, document_id, unnest(summary_topics) AS x FROM pages{where})"
_TABLES = "SELECT page_id, unnest(tables) AS t, generate_subscripts(tables, 1) AS table_no FROM pages"
_ESCAPED = S.strip(r"replace(replace(replace(c, '\', '\\'), '|', '\|'), chr(10), ' ')")
_GREP = f"""{S.strip("regexp_replace(concat_ws(chr(10), coalesce(text, ''), array_to_string(coalesce(summary_notes, []), chr(10)), " + S.VISUAL_QUERY + "), '" + S.WS + "+', ' ', 'g')")}"""
_BULLET = S.strip("regexp_replace(regexp_replace(" + S.strip("x") + ", '^[*\\-•]+', ''), '^[0-9.)]+', '')")
_CELL = "CASE WHEN regexp_matches(c, '[,\"\\r\\n]') THEN '\"' || replace(c, '\"', '\"\"') || '\"' ELSE c END"
_CONTEXT_TABLE = "'Table ' || i || ':' || chr(10) || array_to_string(list_transform(t, lambda r: array_to_string(r, ' | ')), chr(10))"
_IMAGE = f"coalesce({S.strip('image_text')}, '')"
_CELL_TOKENS = f"coalesce(list_sum(list_transform(flatten(flatten(coalesce(tables, []))), lambda c: {S.tokens('c')})), 0)"
_BODY = S.strip(f"array_to_string(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '{S.WS}+$', '')), chr(10))")
_STATS = f"count(*) AS pages, count(*) FILTER ({S.VISUAL_QUERY} <> '') AS with_vision, count(*) FILTER ({S.HAS_SUMMARY}) AS with_summaries, count(*) FILTER ({S.some('tables')}) AS with_tables"
_LOWER = f"SELECT lower(t) AS topic, count(*) AS mentions, arg_min(t, (page_id, k)) AS label FROM (SELECT page_id, k, {S.strip('x')} AS t FROM (SELECT page_id, unnest(summary_topics) AS x, generate_subscripts(summary_topics, 1) AS k FROM pages)) WHERE t <> '' GROUP BY 1"
SQL = {
    "kept_topic_counts": f"SELECT t AS topic, count(*) AS mentions FROM ({_T.format(strip=S.strip('x'), where=' WHERE ' + S.REASON + chr(32) + '= ' + chr(39) + 'keep' + chr(39))}) WHERE t <> '' GROUP BY t",
    "topic_counts": f"SELECT t AS topic, count(*) AS mentions FROM ({_T.format(strip=S.strip('x'), where='')}) WHERE t <> '' GROUP BY t",
    "topic_counts_lower": _LOWER,
    "topic_top25": f"SELECT topic, mentions FROM ({_LOWER}) ORDER BY mentions DESC, topic LIMIT 25",
    "page_stats": f"SELECT {_STATS} FROM pages",
    "page_stats_by_document": f"SELECT document_id, {_STATS} FROM pages GROUP BY document_id",
    "effective_page_number": f"SELECT page_id, {S.PAGE_NO} AS number, document_id || ':' || {S.PAGE_NO} AS identity FROM pages",
    "page_range_filter": f"SELECT page_id, document_id, {S.PAGE_NO} AS number FROM pages WHERE {S.PAGE_NO} IN (1, 2, 3, 8)",
    "fields_projection": f"SELECT page_id, {S.PAGE_NO} AS page_number, chunk_id, doc_title, summary_relevancy, {S.VISUAL_QUERY} AS visual_text FROM pages",
    "document_summary": f"SELECT page_id, document_id, {S.PAGE_NO} AS page_number, {S.DESCRIPTION} AS description FROM pages",
    "grep_counts": f"SELECT page_id, CAST(len(regexp_extract_all({_GREP}, '(?i)valve station|pump house')) AS INTEGER) AS hits FROM pages WHERE regexp_matches({_GREP}, '(?i)valve station|pump house')",
    "table_csv": f"SELECT page_id, CAST(table_no AS INTEGER) AS table_no, array_to_string(list_transform(t, lambda r: array_to_string(list_transform(r, lambda c: {_CELL}), ',')), chr(10)) AS csv FROM ({_TABLES})",
    "table_markdown_report": f"SELECT page_id, CAST(table_no AS INTEGER) AS table_no, {S.md_table('t')} AS markdown FROM ({_TABLES})",
    "table_markdown_bundle": f"SELECT page_id, CAST(table_no AS INTEGER) AS table_no, {S.md_table('t', _ESCAPED)} AS markdown FROM ({_TABLES})",
    "table_markdown_corpus": f"SELECT page_id, string_agg({S.md_table('t', padded=False)}, chr(10) || chr(10) ORDER BY table_no) AS markdown FROM ({_TABLES}) WHERE len(t) > 0 GROUP BY page_id",
    "table_widths": f"SELECT page_id, CAST(table_no AS INTEGER) AS table_no, CAST(list_max(list_transform(t, lambda r: len(r))) AS INTEGER) AS columns, CAST(len(t) AS INTEGER) AS n_rows FROM ({_TABLES})",
    "without_images": "SELECT page_id, i.id, i.content_type, i.filename FROM (SELECT page_id, unnest(embedded_images) AS i FROM pages)",
    "unvalidated_summaries": f"SELECT page_id, summary_relevancy FROM pages WHERE summary_quality_validated = false AND summary_relevancy IS NOT NULL AND {S.some('summary_notes')}",
    "summary_flags": f"SELECT page_id, {S.HAS_SUMMARY} AS summary, {S.some('summary_notes')} AS notes, {S.some('summary_topics')} AS topics FROM pages",
    "visual_text": f"SELECT page_id, {S.VISUAL_CORPUS} AS corpus_form, {S.VISUAL_QUERY} AS query_form FROM pages WHERE {S.VISUAL_CORPUS} <> ''",
    "page_context": f"SELECT page_id, array_to_string(list_filter(list_concat([coalesce({S.strip('text')}, '')], list_transform(coalesce(tables, []), lambda t, i: {_CONTEXT_TABLE}), [CASE WHEN {_IMAGE} <> '' THEN 'Image extraction:' || chr(10) || {_IMAGE} ELSE '' END]), lambda x: x <> ''), chr(10) || chr(10)) AS context FROM pages",
    "page_tokens": f"SELECT page_id, CAST({S.tokens('text')} + {_CELL_TOKENS} AS BIGINT) AS tokens, CAST({S.words('text')} AS INTEGER) AS words FROM pages",
    "vision_tokens": f"SELECT page_id, CAST((image_classifier IS NOT NULL)::INTEGER + list_sum(list_transform({S.VISUALS}, lambda c: {S.tokens('c')})) AS BIGINT) AS tokens FROM pages",
    "token_totals_by_document": f"SELECT document_id, CAST(sum({S.tokens('text')} + {_CELL_TOKENS}) AS BIGINT) AS tokens FROM pages GROUP BY document_id",
    "clean_bullets": f"SELECT page_id, array_to_string(list_filter(list_transform(list_transform(summary_notes, lambda n: '* ' || n), lambda x: {_BULLET}), lambda x: x <> ''), chr(10)) AS notes FROM pages WHERE {S.some('summary_notes')}",
    "clean_topics": f"SELECT page_id, array_to_string(list_filter(list_transform(string_split(array_to_string(summary_topics, ', '), ','), lambda x: {_BULLET}), lambda x: x <> '')[1:5], chr(10)) AS topics FROM pages WHERE {S.some('summary_notes')} AND summary_topics IS NOT NULL",
    "parse_percent": "SELECT page_id, CASE WHEN abs(summary_relevancy) <= 100 THEN abs(summary_relevancy) END AS percent FROM pages",
    "quality_policy": "SELECT CAST(n AS INTEGER) AS attempt, CASE WHEN n <= 5 THEN 90 ELSE 85 END AS threshold, CASE WHEN n <= 10 THEN 1 WHEN n <= 20 THEN 2 ELSE 3 END AS tier, CASE WHEN n <= 5 THEN 'primary' ELSE 'fallback' END AS prompt FROM range(1, 31) t(n)",
    "probe_documents": "SELECT document_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS INTEGER) AS longest, CAST(sum(coalesce(len(tables), 0)) AS BIGINT) AS tables FROM pages GROUP BY document_id",
    "call_estimate": f"SELECT document_id, count(*) AS pages, count(*) * 3 AS detailed_calls, count(*) FILTER ({S.some('embedded_images')}) AS vision_calls, count(*) * 300 AS seconds_bound FROM pages GROUP BY document_id",
    "footer_move": f"SELECT page_id, CASE WHEN {_BODY} = '' THEN '' ELSE {_BODY} || chr(10) END || '© 2030 Works' || chr(10) || 'All rights' AS text FROM pages",
    "chunk_windows": """
WITH RECURSIVE w AS (
  SELECT doc_id, text, length(text) AS n, 0 AS start, CASE WHEN length(text) <= 3000 THEN length(text) ELSE 0 + off END AS cut
  FROM (SELECT doc_id, text, {cut0} AS off FROM documents WHERE text IS NOT NULL AND text <> '')
  UNION ALL
  SELECT doc_id, text, n, nxt AS start, nxt + {cutn} AS cut
  FROM (SELECT doc_id, text, n, CASE WHEN greatest(cut - 80, 0) > start AND greatest(cut - 80, 0) < cut THEN greatest(cut - 80, 0) ELSE cut END AS nxt FROM w WHERE cut < n)
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, cut) - 1 AS INTEGER) AS ord, CAST(start AS INTEGER) AS start, CAST(cut AS INTEGER) AS "end",
       CASE WHEN n <= 3000 THEN text ELSE {piece} END AS text
FROM w WHERE n <= 3000 OR {piece} <> ''""".format(cut0=_cut("substr(text, 1, 3000)"), cutn=_cut("substr(text, nxt + 1, 3000)"), piece=S.strip("substr(text, start + 1, cut - start)")),
}
