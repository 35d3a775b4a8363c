"""Lines repeated across one source's documents: bitmaps of pages per line, per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.session import materialize, table

MIN_LETTERS, MIN_PAGES, MIN_SHARE_PCT = 8, 10, 5
MAX_BROADCAST_ROWS = 500_000


def lines(pages: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """doc_title, page_id, line_no, key of every line with enough letters; key: letters only, in lower case."""
    return (
        pages.select("doc_title", "page_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .withColumn("letters", F.regexp_replace("line", r"[^\p{L}]+", ""))
        .where(F.length("letters") >= min_letters)
        .select("doc_title", "page_id", (F.col("at") + 1).alias("line_no"), F.lower("letters").alias("key"), F.xxhash64("line").alias("variant"))
    )


def recurring(pages: DataFrame, min_letters: int = MIN_LETTERS, min_pages: int = MIN_PAGES, min_share_pct: int = MIN_SHARE_PCT) -> DataFrame:
    """doc_title, page_id, line_no, key: every occurrence of a line that is on at least
    ``min_pages`` page rows and ``min_share_pct`` percent of all page rows of its title.

    1. Lines are counted by hashes of title and key. The count of occurrences can't be below that of
       pages, so what fails it can't recur; all but a few lines end here, after a map-side sum. Hashes that
       clash only let more through. The few that are left are counted and, if few indeed, sent to the lines.
    2. Each written form (variant) of a remaining line gets a bitmap of its pages in chunks of
       32,768 page ids, compressed in shuffle and files; the bitmaps of all variants with one
       key are joined by OR, and their exact cardinalities are held against the thresholds.
    3. An occurrence is given out if its page's bit is set in the bitmap of its key.

    Keys by title, line and chunk spread a title that holds a third of all rows. The null
    title is a title of its own. Pages with a null id or text have no lines, though they count
    as page rows. A page row given twice counts twice among the page rows, once in a bitmap.
    """
    pages = pages.select("doc_title", "page_id", "text")
    rows = pages.groupBy("doc_title").agg(F.count("*").alias("page_rows"))
    every = lines(pages.where("page_id IS NOT NULL"), min_letters).withColumns({"t": F.xxhash64("doc_title"), "h": F.xxhash64("key")})
    often = every.groupBy("t", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    least = rows.groupBy(F.xxhash64("doc_title").alias("t")).agg(F.min("page_rows").alias("least"))
    often = materialize(often.join(least, "t").where(f"n * 100 >= least * {min_share_pct}").select("t", "h"), "p6-often")
    few = often.count() <= MAX_BROADCAST_ROWS
    left = every.join(F.broadcast(often) if few else often, ["t", "h"], "left_semi").drop("t", "h")
    left = materialize(left.selectExpr("doc_title", "key", "variant", "page_id", "line_no", "bitmap_bucket_number(page_id) AS chunk", "bitmap_bit_position(page_id) AS bit"), "p6-lines")
    chunk = ["doc_title", "key", "chunk"]
    maps = (
        left.groupBy(*chunk, "variant").agg(F.bitmap_construct_agg("bit").alias("pages"))
        .groupBy(*chunk).agg(F.bitmap_or_agg("pages").alias("pages"))
    )
    maps = materialize(maps, "p6-bitmaps")
    enough = (
        maps.groupBy("doc_title", "key").agg(F.sum(F.bitmap_count("pages")).alias("n")).alias("m")
        .join(rows.alias("r"), F.expr("m.doc_title <=> r.doc_title"))
        .where(f"n >= {min_pages} AND n * 100 >= page_rows * {min_share_pct}").selectExpr("m.doc_title", "m.key")
    )
    kept = maps.alias("m").join(enough.alias("e"), F.expr("m.doc_title <=> e.doc_title AND m.key = e.key")).selectExpr("m.doc_title", "m.key", "m.chunk", "m.pages")
    bit = "bit_get(cast(conv(hex(substring(k.pages, cast(l.bit div 8 as int) + 1, 1)), 16, 10) as bigint), cast(l.bit % 8 as int)) = 1"
    return (
        left.alias("l").join(kept.alias("k"), F.expr("l.doc_title <=> k.doc_title AND l.key = k.key AND l.chunk = k.chunk"))
        .where(bit).selectExpr("l.doc_title", "l.page_id", "l.line_no", "l.key")
    )


def without_recurring(pages: DataFrame, **how: int) -> DataFrame:
    """page_id, text, removed: each page's text without its recurring lines, and their number.

    Pages without such lines keep their text as it is; null texts stay null.
    """
    drop = recurring(pages, **how).groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
    joined = pages.select("page_id", "text").join(drop, "page_id", "left")
    clean = F.expr("array_join(filter(split(text, '\\n'), (l, i) -> NOT array_contains(drop, i + 1)), '\\n')")
    return joined.select("page_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(clean).alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("removed"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return recurring(table(spark, root, "pages")).select("page_id", "line_no")


def p6_clean(spark: SparkSession, root: str) -> DataFrame:
    return without_recurring(table(spark, root, "pages"))


QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean}
_SQL = r"""
WITH l AS (SELECT doc_title, page_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM pages),
k AS (SELECT *, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) AS key FROM l WHERE length(regexp_replace(line, '[^\p{L}]+', '', 'g')) >= 8),
n AS (SELECT doc_title, count(*) AS page_rows FROM pages GROUP BY doc_title),
r AS (SELECT k.doc_title, key FROM k JOIN n USING (doc_title) GROUP BY k.doc_title, key, page_rows
      HAVING count(DISTINCT page_id) >= 10 AND count(DISTINCT page_id) * 100 >= page_rows * 5),
f AS (SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN r USING (doc_title, key))
"""
SQL = {
    "p6_found": _SQL + "SELECT page_id, line_no FROM f",
    "p6_clean": _SQL + """, kept AS (SELECT l.page_id, string_agg(line, chr(10) ORDER BY l.line_no) AS text FROM l LEFT JOIN f ON f.page_id = l.page_id AND f.line_no = l.line_no WHERE f.page_id IS NULL GROUP BY l.page_id),
c AS (SELECT page_id, count(*) AS removed FROM f GROUP BY page_id)
SELECT p.page_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(removed, 0) AS INTEGER) AS removed
FROM pages p LEFT JOIN kept USING (page_id) LEFT JOIN c USING (page_id)""",
}
