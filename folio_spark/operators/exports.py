"""Markdown reports and knowledge bundles as (path, content) rows, and their writer."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import pages as P
from folio_spark.functions.tables import bundle_markdown, report_markdown
from folio_spark.functions.text import slugify, strip, yaml_scalar

SLIDES = (".pptx", ".ppt")


def _only(condition: Column, *parts: Column) -> Column:
    """The lines if ``condition`` holds, else none."""
    return F.when(condition, F.concat(*parts)).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<string>")


def _line(*x: Column | str) -> Column:
    return F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])


def _list(c: str) -> Column:
    return F.transform(F.coalesce(c, _none()), lambda x: F.concat(F.lit("- "), x))


def _tables() -> Column:
    return F.coalesce("tables", F.array().cast("array<array<array<string>>>"))


def page_report(summarised: Column) -> Column:
    """A page's section of the report: topics and notes; text and tables too if its document has no summary at all."""
    def table(t: Column, i: Column) -> Column:
        title = _only(F.size("tables") > 1, _line(F.concat(F.lit("#### Table "), (i + 1).cast("string"))))
        return F.concat(title, F.filter(F.array(report_markdown(t)), lambda x: x != ""), _line(""))

    number = F.coalesce("page_number", F.col("pos") + 1).cast("string")
    parts = F.concat(
        _line(F.concat(F.lit("## Page "), number), ""),
        _only(P.some("summary_topics"), _line("### Topics"), _list("summary_topics"), _line("")),
        _only(P.some("summary_notes"), _line("### Summary Notes"), _list("summary_notes"), _line("")),
        _only(~summarised & P.has_text("text"), _line("### Extracted Text"), F.array(strip("text")), _line("")),
        _only(~summarised & P.some("tables"), _line("### Tables"), F.flatten(F.transform(_tables(), table))),
    )
    return F.array_join(parts, "\n")


def report_parts(pages: DataFrame) -> DataFrame:
    """document_id, pos, page_id, part: the pages of each report; of a document with any summary only those with one.

    One row for each page, so a document of any number of pages stays spread; its report is
    a title, an empty line and the parts in order of pos and page_id, joined by line ends.
    """
    any_of = pages.groupBy("document_id").agg(F.max(P.has_summary()).alias("_any"))
    rows = pages.join(any_of, "document_id").where(P.has_summary() | ~F.col("_any"))
    return rows.select("document_id", "pos", "page_id", page_report(F.col("_any")).alias("part"))


def names_of(doc_outputs: DataFrame) -> DataFrame:
    return doc_outputs.select("document_id", "filename").dropDuplicates(["document_id"])


def markdown_reports(pages: DataFrame, doc_outputs: DataFrame) -> DataFrame:
    """document_id, markdown: the whole report of each document in one value, as the one file it becomes; see ``report_parts``."""
    merged = report_parts(pages).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", "page_id", "part"))).alias("all"))
    title = F.concat(F.lit("# "), F.coalesce("filename", "document_id"), F.lit("\n"))
    body = F.array_join(F.concat(F.array(title), F.transform("all", lambda x: x.part)), "\n")
    return merged.join(names_of(doc_outputs), "document_id", "left").select("document_id", body.alias("markdown"))


def document_tags(pages: DataFrame, most: int = 30) -> DataFrame:
    """document_id, tags: distinct topics in the order they first appear, at most ``most``."""
    at = pages.select("document_id", "pos", "page_id", F.posexplode("summary_topics").alias("at", "t")).select("document_id", strip("t").alias("tag"), F.struct("pos", "page_id", "at").alias("o")).where("tag != ''")
    first = at.groupBy("document_id", "tag").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("o", "tag"))
    listed = first.withColumn("_at", place).where(F.col("_at") <= most).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("o", "tag"))).alias("all"))
    return listed.select("document_id", F.transform("all", lambda x: x.tag).alias("tags"))


def front_matter(pairs: list[tuple[str, Column, str]]) -> Column:
    """YAML between rules; of (name, value, kind) those that are null or empty are left out. kind: text, plain or list."""
    def one(name: str, value: Column, kind: str) -> Column:
        if kind == "list":
            items = F.filter(F.transform(F.coalesce(value, _none()), strip), lambda x: x != "")
            return F.when(F.size(items) > 0, F.concat(F.lit(f"{name}: ["), F.array_join(F.transform(items, yaml_scalar), ", "), F.lit("]")))
        shown = value.cast("string") if kind == "plain" else F.when(value != "", yaml_scalar(value))
        return F.concat(F.lit(f"{name}: "), shown)

    return F.concat_ws("\n", F.lit("---"), *[one(*p) for p in pairs], F.lit("---"))


def page_sections(level: int) -> Column:
    """The content of a page as lines, under headings of ``level``."""
    h = "#" * level
    shown = F.filter(F.transform(_tables(), bundle_markdown), lambda x: x != "")
    numbered = F.transform(shown, lambda t, i: F.when(F.size(shown) > 1, F.concat(F.lit(f"{h}# Table "), (i + 1).cast("string"), F.lit("\n"), t)).otherwise(t))
    visual = P.visual_text_query()
    lines = F.concat(
        _only(P.some("summary_topics"), _line("", f"{h} Topics"), _list("summary_topics")),
        _only(P.some("summary_notes"), _line("", f"{h} Notes"), _list("summary_notes")),
        _only(visual != "", _line("", f"{h} Visual Extraction", visual)),
        _only(P.has_text("text"), _line("", f"{h} Extracted Text", strip("text"))),
        _only(F.size(shown) > 0, _line("", f"{h} Tables"), numbered),
    )
    return F.when(F.size(lines) == 0, _line("", "_(No extracted content for this page.)_")).otherwise(lines)


def _described(pages: DataFrame, doc_outputs: DataFrame) -> DataFrame:
    """Pages with what their bundle says of the document: filename, title, total, unit, dir."""
    title = F.get_json_object("metadata", "$.title")
    docs = doc_outputs.select("document_id", "filename", title.alias("_title"), "total_pages").dropDuplicates(["document_id"])
    rows = pages.select("document_id").distinct().join(docs, "document_id", "left").withColumn("filename", F.coalesce("filename", F.lit("document")))
    slug = slugify("filename")
    first = rows.groupBy(slug.alias("_slug")).agg(F.min("document_id").alias("_first"))
    rows = rows.withColumn("_slug", slug).join(first, "_slug")
    folder = F.when(F.col("document_id") == F.col("_first"), F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), F.left("document_id", F.lit(8))))
    slides = F.lower("filename").endswith(SLIDES[0]) | F.lower("filename").endswith(SLIDES[1])
    return rows.select("document_id", "filename", F.coalesce(F.nullif("_title", F.lit("")), "filename").alias("title"), "total_pages", F.when(slides, "Slide").otherwise("Page").alias("unit"), folder.alias("dir"))


def _document_head(counts: Column, total: Column, at: Column) -> Column:
    return front_matter([
        ("type", F.lit("Document"), "text"), ("title", F.col("title"), "text"),
        ("description", F.concat("filename", F.lit(" — "), total.cast("string"), F.lit(" pages, "), counts.cast("string"), F.lit(" summarized.")), "text"),
        ("tags", F.col("tags"), "list"), ("timestamp", at, "text"), ("source_document_id", F.col("document_id"), "text"), ("source_filename", F.col("filename"), "text"), ("source_total_pages", F.col("total_pages"), "plain"),
    ])


def bundle_files(pages: DataFrame, doc_outputs: DataFrame, at: str | None = None) -> DataFrame:
    """path, content of a knowledge bundle for each document: page files, their index, the document, the bundle index and a log.

    Documents with the same name get folders of their own: the first by id has the plain name. Pages with the
    same number write the same file; the last one stays, as all are listed. ``at``: the time, as text.
    The indexes of a document hold one line for each of its pages.
    """
    at = at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    docs = _described(pages, doc_outputs)
    number = P.effective_page_number()
    rows = pages.join(docs, "document_id").withColumn("_n", number).withColumn("_file", F.format_string("page-%04d.md", number)).withColumn("_about", F.coalesce(P.first_description(), F.lit("")))
    head = front_matter([
        ("type", F.when(F.col("unit") == "Slide", "Slide").otherwise("Document Page"), "text"), ("title", F.concat("unit", F.lit(" "), F.col("_n").cast("string"), F.lit(" — "), "filename"), "text"),
        ("description", F.col("_about"), "text"), ("tags", F.col("summary_topics"), "list"), ("timestamp", F.lit(at), "text"), ("summarizer_chunk_id", F.col("chunk_id"), "text"),
        ("summarizer_relevancy", F.col("summary_relevancy"), "plain"), ("summarizer_quality_validated", F.col("summary_quality_validated"), "plain"), ("source_document_id", F.col("document_id"), "text"), ("source_page_number", F.col("_n"), "plain"),
    ])
    place = F.concat("unit", F.lit(" "), F.col("_n").cast("string"), F.lit(" of ["), "filename", F.lit("](/document.md)."))
    content = F.array_join(F.concat(_line(head, "", place), page_sections(1), _line("")), "\n")
    page_files = rows.select(F.concat("dir", F.lit("/pages/"), "_file").alias("path"), F.struct("pos", "page_id").alias("o"), content.alias("content")).groupBy("path").agg(F.max_by("content", "o").alias("content"))
    about = F.when(F.col("_about") == "", "No description.").otherwise(F.col("_about"))
    entry = F.concat(F.lit("* ["), "unit", F.lit(" "), F.col("_n").cast("string"), F.lit("]({}"), "_file", F.lit(") - "), about)
    listed = rows.groupBy("document_id").agg(F.count("*").alias("_pages"), F.count_if(P.has_summary()).alias("_noted"), F.array_sort(F.collect_list(F.struct("pos", "page_id", entry.alias("x")))).alias("_all"))
    whole = docs.join(listed, "document_id").join(document_tags(pages), "document_id", "left").withColumn("_total", F.coalesce("total_pages", "_pages").cast("string"))

    def entries(prefix: str) -> Column:
        return F.transform("_all", lambda e: F.replace(e.x, F.lit("]({}"), F.lit(f"]({prefix}")))

    def text(*lines: Column) -> Column:
        return F.array_join(F.concat(*lines, _line("")), "\n")

    said = F.concat(F.lit("Structured extraction of **"), "filename", F.lit("** ("), "_total", F.lit(" pages)."))
    files = {
        "pages/index.md": text(_line("# Pages", ""), entries("")),
        "document.md": text(_line(_document_head(F.col("_noted"), F.col("_total"), F.lit(at)), "", said, "", "# Pages"), entries("/pages/")),
        "index.md": text(_line('---\nokf_version: "0.1"\n---', "", "# Bundle", "", F.concat(F.lit("* ["), "filename", F.lit("](document.md) - Whole-document concept.")), F.concat(F.lit("* [Pages](pages/) - "), F.col("_pages").cast("string"), F.lit(" per-"), F.lower("unit"), F.lit(" concept(s).")))),
        "log.md": text(_line("# Directory Update Log", "", f"## {at[:10]}", "", F.concat(F.lit("* **Creation**: Generated OKF bundle from "), "filename", F.lit(" ("), "_total", F.lit(" pages).")))),
    }
    named = F.explode(F.array(*[F.struct(F.concat("dir", F.lit(f"/{k}")).alias("path"), v.alias("content")) for k, v in files.items()]))
    return page_files.unionByName(whole.select(named.alias("f")).select("f.path", "f.content"))


def single_files(pages: DataFrame, doc_outputs: DataFrame, at: str | None = None) -> DataFrame:
    """path, content: each document with all of its pages as one knowledge file."""
    at = at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    docs = _described(pages, doc_outputs)
    rows = pages.join(docs, "document_id")
    part = F.array_join(F.concat(_line("", F.concat(F.lit("## "), "unit", F.lit(" "), P.effective_page_number().cast("string"))), page_sections(3)), "\n")
    listed = rows.groupBy("document_id").agg(F.count("*").alias("_pages"), F.count_if(P.has_summary()).alias("_noted"), F.array_sort(F.collect_list(F.struct("pos", "page_id", part.alias("x")))).alias("_all"))
    whole = docs.join(listed, "document_id").join(document_tags(pages), "document_id", "left").withColumn("_total", F.coalesce("total_pages", "_pages").cast("string"))
    said = F.concat(F.lit("Structured extraction of **"), "filename", F.lit("** ("), "_total", F.lit(" pages)."))
    head = _line(_document_head(F.col("_noted"), F.col("_total"), F.lit(at)), "", F.concat(F.lit("# "), "title"), "", said)
    content = F.array_join(F.concat(head, F.transform("_all", lambda e: e.x), _line("")), "\n")
    return whole.select(F.concat("dir", F.lit(".okf.md")).alias("path"), content.alias("content"))


def page_records(pages: DataFrame) -> DataFrame:
    """One JSON line for each page: number, text, notes and topics."""
    fields = F.struct(P.effective_page_number().alias("page_number"), "text", "summary_notes", "summary_topics")
    return pages.select("document_id", "pos", "page_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("line"))


def table_records(pages: DataFrame, doc_outputs: DataFrame) -> DataFrame:
    """document_id, filename, page_number, table_index (from 0), rows, path: every table, and the CSV file that it is exported to."""
    at = pages.select("document_id", "page_id", P.effective_page_number().alias("page_number"), F.posexplode("tables").alias("table_index", "rows"))
    path = F.format_string("tables/page-%04d-table-%d.csv", "page_number", F.col("table_index") + 1)
    return at.join(names_of(doc_outputs), "document_id", "left").select("document_id", "page_id", "filename", "page_number", "table_index", "rows", path.alias("path"))


def image_files(pages: DataFrame) -> DataFrame:
    """document_id, path, data: the page images that are valid base64, named by number and kind."""
    data = F.try_to_binary("image_base64", F.lit("base64"))
    rows = pages.where("coalesce(image_base64, '') <> ''").select("document_id", P.effective_page_number().alias("n"), data.alias("data")).where("data IS NOT NULL")
    start = F.hex(F.substring("data", 1, 4))
    kind = F.when(start == "89504E47", ".png").when(start.startswith("FFD8"), ".jpg").otherwise(".bin")
    return rows.select("document_id", F.concat(F.format_string("images/page-%04d", "n"), kind).alias("path"), "data")


def write_files(files: DataFrame, root: str) -> None:
    """Write (path, content) rows below ``root``, each file by the task that holds it, in one step of renaming.

    ``root`` is the address of a shared file system (hdfs://, s3://, file:// of a shared mount …); a plain path is one
    of the local machine, and refused on a cluster, where it would scatter the files over hosts.
    """
    import posixpath
    import uuid

    if "://" not in root and not files.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("give the address of a file system that all executors share")

    def write(rows) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        base = posixpath.normpath(base)
        for r in rows:
            to = posixpath.normpath(posixpath.join(base, r.path))
            if not to.startswith(base + "/"):
                raise ValueError(f"a path outside the bundle: {r.path}")
            system.create_dir(posixpath.dirname(to), recursive=True)
            part = f"{to}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(r.content.encode() if isinstance(r.content, str) else bytes(r.content))
            system.move(part, to)

    files.select("path", "content").foreachPartition(write)
