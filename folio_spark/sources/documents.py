"""Document files as pages: dispatch by extension, readers for text, DOCX and PPTX, a hook for PDF."""

from __future__ import annotations

import base64
import posixpath
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.config import PipelineConfig
from folio_spark.operators.chunking import OVERLAP, SIZE, cuts
from folio_spark.operators.pages import parse_range
from folio_spark.sources.opc import OFFICE_ID, Package, PackageError, image_allowed
from folio_spark.session import skip_empty

KINDS = {"pdf": "pdf", "pptx": "pptx", "docx": "docx", "txt": "text", "md": "text", "markdown": "text"}
PAGE_SCHEMA = (
    "document_id string, pos int, chunk_id string, doc_title string, page_number int, text string, tables array<array<array<string>>>, extraction_warnings array<string>, "
    "embedded_images array<struct<id: string, relationship_id: string, content_type: string, filename: string, alt_text: string, base64: string>>, image_base64 string, total_pages int, error string"
)
PAGE_COLUMNS = ("document_id", "pos", "chunk_id", "doc_title", "page_number", "text", "tables", "extraction_warnings", "embedded_images", "image_base64", "total_pages", "error")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
#: A page as readers yield it: text, tables, warnings, image, and, if there are any, embedded images.
Page = tuple


def kind_of(path: Column) -> Column:
    """text, docx, pptx or pdf by the extension in any case; null for anything else."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[suffix]


def text_pages(data: bytes, size: int, overlap: int) -> list[Page]:
    """UTF-8 text in chunks; an empty file is one empty page."""
    text = data.decode("utf-8-sig", "replace")
    spans = cuts(text, size, overlap)
    pieces = [text] if len(spans) <= 1 else [p for a, b in spans if (p := text[a:b].strip())]
    return [(p, [], [], None) for p in pieces]


def _runs(paragraph) -> str:
    out = []
    for x in paragraph.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag in (W + "br", W + "cr") and x.get(W + "type") != "page":
            out.append("\n")
    return "".join(out).strip()


def _heading(package: Package) -> dict[str, int]:
    """style id → heading level 1..9, by the style's id or name."""
    root = package.xml("word/styles.xml")
    out = {}
    for s in root.iter(W + "style") if root is not None else ():
        name = (s.find(W + "name").get(W + "val", "") if s.find(W + "name") is not None else "").lower()
        names = (s.get(W + "styleId", "").lower(), name)
        if m := next((m for n in names if (m := re.fullmatch(r"heading([1-9])", n.replace(" ", "")))), None):
            out[s.get(W + "styleId", "")] = int(m[1])
    return out


def _numbering(package: Package) -> dict[tuple[str, str], str]:
    """(numbering instance, level) → format, by the abstract numbering that the instance refers to."""
    root = package.xml("word/numbering.xml")
    formats, out = {}, {}
    for a in root.iter(W + "abstractNum") if root is not None else ():
        for level in a.findall(W + "lvl"):
            kind = level.find(W + "numFmt")
            formats.setdefault(a.get(W + "abstractNumId"), {})[level.get(W + "ilvl")] = "unknown" if kind is None else kind.get(W + "val", "unknown")
    for n in root.iter(W + "num") if root is not None else ():
        of = n.find(W + "abstractNumId")
        for level, kind in formats.get(None if of is None else of.get(W + "val"), {}).items():
            out[n.get(W + "numId"), level] = kind
    return out


def _content_types(package: Package) -> dict[str, str]:
    """Part names (beginning with /) and extensions → content type."""
    root = package.xml("[Content_Types].xml")
    out = {}
    for x in root if root is not None else ():
        out[x.get("PartName") or (x.get("Extension") or "").lower()] = x.get("ContentType", "")
    return out


def _images(package: Package, relations: dict, types: dict[str, str], paragraph, images: list[dict]) -> list[dict]:
    """The embedded images of a paragraph; ids run on over the document. Links to the outside are left out."""
    out = []
    for drawing in [x for x in paragraph.iter() if x.tag in (W + "drawing", W + "pict")]:
        about = next((x for x in drawing.iter() if x.tag.endswith("}docPr")), None)
        alt = None if about is None else about.get("descr") or about.get("title")
        for blip in drawing.iter(A + "blip"):
            relation = blip.get(OFFICE_ID + "embed") or blip.get(OFFICE_ID + "link")
            target, kind, outside = relations.get(relation, ("", "", True))
            if outside or not kind.endswith("/image"):
                continue
            data = package.read(target)
            suffix = target.rsplit(".", 1)[-1].lower()
            images.append({"id": f"image_{len(images) + 1}", "relationship_id": relation, "content_type": types.get("/" + target) or types.get(suffix), "filename": posixpath.basename(target), "alt_text": alt, "base64": base64.b64encode(data).decode() if data else None})
            out.append(images[-1])
    return out


def _docx_table(table) -> list[list[str]]:
    rows = []
    for tr in table.findall(W + "tr"):
        cells = []
        for tc in tr.findall(W + "tc"):
            cells.append("\n".join(t for p in tc.iter(W + "p") if (t := _runs(p))))
        if cells:
            rows.append(cells)
    return rows


def docx_blocks(package: Package, tables: bool = True, pictures: bool = True) -> list[tuple[str, str, object]]:
    """(kind, text, payload) in reading order: headers, the body, footers.

    Kinds: header, footer, heading (payload: level), list, table (payload: rows), image (payload: the image), section, paragraph,
    break. Images, notes and comments follow the paragraph that has them. Cells that go on with a merged one are kept, as they are written.
    """
    root = package.xml("word/document.xml")
    if root is None:
        raise PackageError("no word/document.xml")
    levels, formats, types = _heading(package), _numbering(package), _content_types(package)
    relations = package.relations("word/document.xml")
    images: list[dict] = []
    notes = {}
    for part, tag, label in (("footnotes", "footnote", "Footnote"), ("endnotes", "endnote", "Endnote"), ("comments", "comment", "Comment")):
        tree = package.xml(f"word/{part}.xml")
        for n in tree.iter(W + tag) if tree is not None else ():
            if n.get(W + "type") is None and (t := "\n".join(x for p in n.iter(W + "p") if (x := _runs(p)))):
                notes[tag, n.get(W + "id")] = f"[{label}] {t}"
    out: list[tuple[str, str, object]] = []

    def walk(parent, forced: str | None) -> None:
        for x in parent:
            if x.tag == W + "sectPr":
                out.append(("section", "[Section break]", None))
            elif x.tag == W + "tbl" and tables:
                rows = _docx_table(x)
                out.append((forced or "table", "\n".join(" | ".join(r) for r in rows), None if forced else rows))
            elif x.tag == W + "p":
                pages = [b for b in x.iter(W + "br") if b.get(W + "type") == "page"]
                text = _runs(x)
                style = x.find(f"{W}pPr/{W}pStyle")
                level = levels.get(style.get(W + "val", "")) if style is not None else None
                before = x.find(f"{W}pPr/{W}pageBreakBefore") is not None
                number = x.find(f"{W}pPr/{W}numPr")
                if before or (pages and not text):
                    out.append(("break", "", None))
                if text:
                    if forced:
                        out.append((forced, text, None))
                    elif number is not None:
                        depth, instance = number.find(W + "ilvl"), number.find(W + "numId")
                        at = "0" if depth is None else depth.get(W + "val", "0")
                        mark = "1. " if instance is not None and formats.get((instance.get(W + "val"), at)) == "decimal" else "- "
                        out.append(("list", "  " * int(at if at.isdigit() else 0) + mark + text, None))
                    elif level:
                        out.append(("heading", "#" * min(level, 6) + " " + text, level))
                    else:
                        out.append(("paragraph", text, None))
                for image in _images(package, relations, types, x, images) if pictures else ():
                    out.append(("image", f"[Image: {image['alt_text'] or image['filename']}]", image))
                if text and pages:
                    out.append(("break", "", None))
                for ref in x.iter():
                    for tag in ("footnote", "endnote", "comment"):
                        if ref.tag == f"{W}{tag}Reference" and (tag, ref.get(W + "id")) in notes:
                            out.append(("note", notes[tag, ref.get(W + "id")], None))

    for label in ("header", "footer"):
        if label == "footer":
            body = root.find(W + "body")
            walk(body if body is not None else [], None)
        for name in sorted(n for n in package.names() if re.fullmatch(rf"word/{label}\d*\.xml", n)):
            tree = package.xml(name)
            walk(tree if tree is not None else [], label)
    return out


def docx_pages(data: bytes, size: int, overlap: int, config: PipelineConfig = PipelineConfig()) -> list[Page]:
    """Pages at page breaks if there are any, else chunks at top headings and within ``size``."""
    package = Package(data)
    blocks = docx_blocks(package, not (config.skip_tables or config.text_only), not (config.skip_images or config.text_only))
    groups: list[list] = [[]]
    if any(k == "break" for k, *_ in blocks):
        for b in blocks:
            if b[0] == "break":
                groups.append([])
            else:
                groups[-1].append(b)
    else:
        length = 0
        for kind, text, payload in blocks:
            parts = [text[a:b].strip() for a, b in cuts(text, size, 0)] if kind in ("paragraph", "header", "footer") and len(text) > size else [text]
            for t in filter(None, parts):
                if groups[-1] and ((payload == 1 and any(k not in ("header", "heading") for k, *_ in groups[-1])) or length + len(t) > size):
                    groups.append([])
                    length = 0
                groups[-1].append((kind, t, payload))
                length += len(t)
    label = {"header": "[Header] ", "footer": "[Footer] "}
    groups = [g for g in groups if g] or [[]]
    out = []
    for g in groups:
        pictures = [p for k, _, p in g if k == "image"]
        first = next((p["base64"] for p in pictures if p["base64"] and image_allowed(base64.b64decode(p["base64"]))), None)
        shown = pictures if config.keep_base64_images else [{**p, "base64": None} for p in pictures]
        out.append(("\n\n".join(label.get(k, "") + t for k, t, _ in g if t), [p for k, _, p in g if k == "table"], [], first, shown))
    return out


def _paragraphs(root, inside_tables: bool) -> list[str]:
    skip = set()
    if not inside_tables:
        for t in root.iter(A + "tbl"):
            skip.update(id(p) for p in t.iter(A + "p"))
    return [t for p in root.iter(A + "p") if id(p) not in skip and (t := "".join(x.text or "" for x in p.iter(A + "t")).strip())]


def _continues(cell) -> bool:
    """Whether a table cell only goes on with one that is merged over it."""
    properties = cell.find(A + "tcPr")
    return properties is not None and "1" in (properties.get("hMerge"), properties.get("vMerge"))


def _slide_tables(root) -> list[list[list[str]]]:
    out = []
    for t in root.iter(A + "tbl"):
        rows = []
        for tr in t.findall(A + "tr"):
            cells = ["\n".join(x for r in tc.iter(A + "t") if (x := (r.text or "").strip())) for tc in tr.findall(A + "tc") if not _continues(tc)]
            if cells:
                rows.append(cells)
        if rows:
            out.append(rows)
    return out


def pptx_pages(data: bytes, size: int, overlap: int, config: PipelineConfig = PipelineConfig()) -> list[Page]:
    """A page per slide in the order of the show: text outside tables, speaker notes, tables, the largest picture.

    Notes go with ``skip_tables``, tables only with ``skip_pptx_tables``.
    """
    notes_too, tables_too = not (config.skip_tables or config.text_only), not (config.skip_pptx_tables or config.text_only)
    package = Package(data)
    show = package.xml("ppt/presentation.xml")
    relations = package.relations("ppt/presentation.xml")
    order = [relations[r.get(OFFICE_ID + "id")][0] for r in (show.iter(P + "sldId") if show is not None else ()) if r.get(OFFICE_ID + "id") in relations]
    slides = order or sorted((n for n in package.names() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", posixpath.basename(n))[0]))
    if not slides:
        raise PackageError("no slides")
    pages = []
    for name in slides:
        root = package.xml(name)
        if root is None:
            raise PackageError(f"no {name}")
        own = package.relations(name)
        text = "\n".join(_paragraphs(root, False))
        for target, kind, outside in own.values():
            if notes_too and kind.endswith("/notesSlide") and not outside and (notes := package.xml(target)) is not None and (said := "\n".join(_paragraphs(notes, True))):
                text = f"{text}\n\n[Speaker Notes]\n{said}"
        pictures = [d for target, kind, outside in own.values() if kind.endswith("/image") and not outside and (d := package.read(target)) and image_allowed(d)]
        image = base64.b64encode(max(pictures, key=len)).decode() if pictures else None
        pages.append((text, _slide_tables(root) if tables_too else [], [], image))
    return pages


#: Readers that take the configuration as well are given it.
Reader = Callable[..., list[Page]]
CONFIGURED = (docx_pages, pptx_pages)
READERS: dict[str, Reader] = {"text": text_pages, "docx": docx_pages, "pptx": pptx_pages}


def read_documents(spark: SparkSession, path: str, size: int = SIZE, overlap: int = OVERLAP, readers: dict[str, Reader] | None = None, recursive: bool = True, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Pages of all files under ``path`` (a folder, file or glob), one row per page.

    A file of another kind, of a kind without reader (PDF, unless one is passed), or that
    can't be read, is one row with ``error`` and no text. Files are read where Spark puts
    them; a file is the unit of work. ``config``: what to skip, and the pages wanted, where
    a document with fewer pages says so once; page range and skipped tables and images hold for all readers.
    """
    wanted = set(parse_range(config.page_range)) if config.page_range else None
    no_tables, no_images = config.skip_tables or config.text_only, config.skip_images or config.text_only
    known = {**READERS, **(readers or {})}
    configured = {k for k, f in known.items() if f in CONFIGURED}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    # Scans skip files without a byte; the file index knows them.
    empty = spark.createDataFrame([(re.sub(r"^(\w+):/+", r"\1:/", unquote(p)),) for p in files.inputFiles()], "path string")
    empty = empty.join(files.select(F.regexp_replace("path", r"^(\w+):/+", "$1:/").alias("path")), "path", "left_anti").select("path", F.to_binary(F.lit("")).alias("content"))
    every = files.select("path", "content").unionByName(empty)
    rows = every.select("path", "content", kind_of(F.col("path")).alias("kind"), F.sha2(F.when(F.length("content") > 0, F.col("content")).otherwise(F.encode("path", "utf-8")), 256).alias("sha"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, data, kind, sha in zip(pdf.path, pdf.content, pdf.kind, pdf.sha):
                title, doc = posixpath.basename(at), f"doc_{sha[:16]}"
                error, pages = None, []
                if kind not in known:
                    error = f"no reader for {kind or 'this kind of file'}"
                else:
                    try:
                        pages = known[kind](bytes(data), size, overlap, **({"config": config} if kind in configured else {}))
                    except (PackageError, ValueError) as e:
                        error = f"{type(e).__name__}: {e}"
                clipped = [f"page_range '{config.page_range}' was clipped to the document's {len(pages)} pages"] if wanted and max(wanted) > len(pages) else []
                out = []
                for k, (t, tables, warnings, image, *more) in enumerate(pages):
                    if wanted is None or k + 1 in wanted:
                        out.append((doc, k, f"chunk_{k + 1}", title, k + 1, t, [] if no_tables and kind != "pptx" else tables, [*warnings, *([] if out else clipped)], more[0] if more else [], None if no_images else image, len(pages), None))
                out = out or [(doc, 0, None, title, None, None, [], clipped, [], None, len(pages), error)]
                yield pd.DataFrame(out, columns=PAGE_COLUMNS)

    return rows.mapInPandas(skip_empty(run), PAGE_SCHEMA)


def select_pages(pages: DataFrame, spec: str) -> DataFrame:
    """The pages of a range like ``1-3,8``; a document that has fewer gets one warning, on its first kept page."""
    wanted = parse_range(spec)
    kept = pages.where(F.col("page_number").isin(wanted))
    first = kept.groupBy("document_id").agg(F.min("page_number").alias("first"))
    said = F.concat(F.lit(f"page_range '{spec}' was clipped to the document's "), F.col("total_pages").cast("string"), F.lit(" pages"))
    clipped = F.when((F.col("page_number") == F.col("first")) & (F.col("total_pages") < max(wanted)), F.array(said)).otherwise(F.array().cast("array<string>"))
    return kept.join(first, "document_id").withColumn("extraction_warnings", F.concat("extraction_warnings", clipped)).drop("first")
