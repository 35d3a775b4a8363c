"""Entities (topics) of a corpus, where they occur, and pairs and triples of them.

All pairs of a document's entities grow with the square of its size, and one document may
hold a third of all pages. So all pairs of a document are made in cells that are spread over
tasks, and ``draw`` takes as many as are wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions.text import normalize_entity
from folio_spark.session import materialize, numbered

CELLS = 8


def mentions(pages: DataFrame) -> DataFrame:
    """entity, page_id, document_id: distinct."""
    at = pages.select("page_id", "document_id", F.explode("summary_topics").alias("t"))
    return at.select(normalize_entity("t").alias("entity"), "page_id", "document_id").where("entity != ''").distinct()


def postings(pages: DataFrame) -> DataFrame:
    """entity, pages, documents: exact distinct counts."""
    return mentions(pages).groupBy("entity").agg(F.count("*").alias("pages"), F.count_distinct("document_id").alias("documents"))


def _sets(pages: DataFrame) -> DataFrame:
    entities = F.array_sort(F.array_distinct(F.filter(F.transform("summary_topics", normalize_entity), lambda x: x != "")))
    return pages.select("page_id", "document_id", entities.alias("e"))


def page_pairs(pages: DataFrame) -> DataFrame:
    """a, b (a < b), pages: pairs of entities on one page, and on how many pages."""
    at = _sets(pages).select(F.posexplode("e").alias("i", "a"), "e")
    return at.select("a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("pages"))


def document_pairs(pages: DataFrame, cells: int = CELLS) -> DataFrame:
    """a, b (a < b): all pairs of entities of one document that are on no page together.

    The pairs of a document are made in ``cells`` times ``cells`` cells by entity hash, so that a large one is spread over tasks.
    """
    own = mentions(pages).select("document_id", "entity").distinct().withColumn("cell", F.expr(f"cast(pmod(xxhash64(entity), {cells}) AS int)"))
    other = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    x = own.select("document_id", F.col("entity").alias("a"), F.col("cell").alias("i"), other.alias("j"))
    y = own.select("document_id", F.col("entity").alias("b"), F.col("cell").alias("j"), other.alias("i"))
    pairs = x.join(y, ["document_id", "i", "j"]).where("a < b").select("a", "b").distinct()
    return pairs.join(page_pairs(pages).select("a", "b"), ["a", "b"], "left_anti")


def document_triples(pages: DataFrame) -> DataFrame:
    """a, b, c (in order): all triples of entities of one document."""
    own = mentions(pages).select("document_id", "entity").distinct()
    two = own.withColumnRenamed("entity", "a").join(own.withColumnRenamed("entity", "b"), "document_id").where("a < b")
    return two.join(own.withColumnRenamed("entity", "c"), "document_id").where("b < c").select("a", "b", "c").distinct()


def cross_pairs(pages: DataFrame, n: int, seed: str = "cross") -> DataFrame:
    """a, b (a < b), apart: ``n`` pairs of entities on two or more pages each that have no document in common, or all if there are fewer.

    Entities stand in a ring in the order of a hash. Pairs are drawn by how far apart they stand, the nearest first, then by the place of
    the first; as many distances are tried, in blocks that double, as it takes to find ``n``. Only pairs that are
    drawn are looked up for a document in common: no step pairs all with all.
    """
    often = postings(pages).where("pages >= 2").select("entity").withColumn("_o", F.sha2(F.concat(F.lit(seed), "entity"), 256))
    ring = materialize(numbered(often, ["_o", "entity"], "at").select("entity", "at"), "ring")
    own = materialize(mentions(pages).select("document_id", "entity").where("document_id IS NOT NULL").distinct(), "ring-documents")
    size = ring.count()
    found, lo, width = None, 1, 4
    while lo <= size // 2 or found is None:
        hi = min(lo + width - 1, max(1, size // 2))
        step = ring.select(F.col("entity").alias("x"), "at", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("apart")).withColumn("to", F.expr(f"(at + apart) % {max(1, size)}"))
        step = step.where(f"2 * apart < {size} OR (2 * apart = {size} AND at < to)")
        pairs = step.join(ring.select(F.col("entity").alias("y"), F.col("at").alias("to")), "to").select("x", "y", "at", "apart")
        common = pairs.join(own.withColumnRenamed("entity", "x"), "x").join(own.withColumnRenamed("entity", "y"), ["document_id", "y"], "left_semi").select("x", "y").distinct()
        new = materialize(pairs.join(common, ["x", "y"], "left_anti"), "ring-pairs")
        found = new if found is None else found.unionByName(new)
        lo, width = hi + 1, width * 2
        if found.count() >= n:
            break
    drawn = found.orderBy("apart", "at").limit(n)
    return drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("apart").cast("int").alias("apart"))


def draw(tuples: DataFrame, n: int, seed: str = "draw") -> DataFrame:
    """``n`` of the rows in the order of a hash of all columns."""
    return tuples.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), *tuples.columns), 256), *tuples.columns).limit(n)


def tuple_material(pages: DataFrame, tuples: DataFrame, most: int = 4) -> DataFrame:
    """a, b, c, page_id, place: the first ``most`` pages for every pair (c is null) or triple of entities.

    Common pages come first, or where there are none pages of common documents; then the other pages of any of the entities; by id.
    """
    named = tuples.withColumn("e", F.array_compact(F.array("a", "b", "c")))
    at = named.select("a", "b", "c", F.size("e").alias("k"), F.explode("e").alias("entity")).join(mentions(pages), "entity")
    document = Window.partitionBy("a", "b", "c", "document_id")
    at = at.withColumn("entities", F.size(F.collect_set("entity").over(document)))
    on = at.groupBy("a", "b", "c", "k", "page_id", "document_id", "entities").agg(F.count("*").alias("n"))
    on = on.withColumn("most", F.max("n").over(Window.partitionBy("a", "b", "c")))
    on = on.withColumn("later", F.expr("CASE WHEN most = k THEN n < k ELSE entities < k END"))
    order = Window.partitionBy("a", "b", "c").orderBy("later", "page_id")
    return on.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("a", "b", "c", "page_id", "place")
