import base64
import io
import json
import struct
import zipfile

import pytest

from folio_spark.config import PipelineConfig
from folio_spark.sources import documents as D
from folio_spark.sources import results as R
from folio_spark.sources.opc import Package, PackageError, pixels, resolve

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def p(text, style="", extra=""):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{s}<w:r><w:t>{text}</w:t></w:r>{extra}</w:p>"


def docx(body):
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    notes = f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:t>a note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/footnotes.xml": notes, "word/header1.xml": f"<w:hdr {W}>{p('Top')}</w:hdr>"})


TABLE = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"


def test_docx_in_reading_order():
    note = '<w:r><w:footnoteReference w:id="2"/></w:r>'
    pages = D.docx_pages(docx(p("Title", "H1") + p("Body", extra=note) + TABLE + p("Next", "H1") + p("More")), 3000, 80)
    assert [t for t, *_ in pages] == ["[Header] Top\n\n# Title\n\nBody\n\n[Footnote] a note\n\na | b\nc", "# Next\n\nMore"]
    assert pages[0][1] == [[["a", "b\nc"]]]


def test_docx_page_breaks_collapse():
    br = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    assert [t for t, *_ in D.docx_pages(docx(p("one") + br + br + p("two") + br), 3000, 80)] == ["[Header] Top\n\none", "two"]


def test_docx_lists_images_sections_and_merged_cells():
    item = lambda t, n, level=0: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    picture = '<w:p><w:r><w:t>See</w:t></w:r><w:r><w:drawing><docPr descr="a map"/><a:blip r:embed="i1"/></w:drawing></w:r><w:r><w:drawing><a:blip r:embed="i2"/><a:blip r:embed="i3"/></w:drawing></w:r></w:p>'.replace("docPr", "w:docPr")
    cell = lambda t, m: f'<w:tc><w:tcPr>{m}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>'
    table = f"<w:tbl><w:tr>{cell('x', '')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('y', '')}</w:tr></w:tbl>"
    body = item("one", 1) + item("two", 2, 1) + item("three", 9) + picture + table + "<w:sectPr/>"
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 4, 4)
    image = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
    data = package({
        "word/document.xml": f"<w:document {W} {A}><w:body>{body}</w:body></w:document>",
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num></w:numbering>',
        "word/_rels/document.xml.rels": RELS.format(f'<Relationship Id="i1" Type="{image}" Target="media/m.png"/><Relationship Id="i2" Type="{image}" Target="http://x/y.png" TargetMode="External"/><Relationship Id="i3" Type="{image}" Target="media/none.gif"/>'),
        "word/media/m.png": png, "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="png" ContentType="image/png"/></Types>',
    })
    (text, tables, _, first, shown), = D.docx_pages(data, 3000, 80)
    assert text == "1. one\n\n  - two\n\n- three\n\nSee\n\n[Image: a map]\n\n[Image: none.gif]\n\nx\n | y\n\n[Section break]" and tables == [[["x"], ["", "y"]]]
    assert [(i["id"], i["relationship_id"], i["content_type"], i["filename"], i["alt_text"], i["base64"]) for i in shown] == [("image_1", "i1", "image/png", "m.png", "a map", None), ("image_2", "i3", None, "none.gif", None, None)]
    assert first == base64.b64encode(png).decode()
    assert D.docx_pages(data, 3000, 80, PipelineConfig(keep_base64_images=True))[0][4][0]["base64"] == first
    text, tables, _, first, shown = D.docx_pages(data, 3000, 80, PipelineConfig(text_only=True))[0]
    assert text == "1. one\n\n  - two\n\n- three\n\nSee\n\n[Section break]" and not (tables or first or shown)


def test_pptx_flags():
    data = package(slides())
    whole, notes, tables = (D.pptx_pages(data, 3000, 80, PipelineConfig(**c)) for c in ({}, {"skip_tables": True}, {"skip_pptx_tables": True}))
    assert any(p[1] for p in whole) and [p[1] for p in notes] == [p[1] for p in whole] and not any(p[1] for p in tables)
    assert any("[Speaker Notes]" in p[0] for p in tables) and not any("[Speaker Notes]" in p[0] for p in notes)


def slides():
    cell = lambda t, m="": f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody><a:tcPr{m}/></a:tc>"
    table = f"<a:tbl><a:tr>{cell('x')}{cell('y')}</a:tr><a:tr>{cell('1')}{cell('', ' hMerge=' + chr(34) + '1' + chr(34))}</a:tr></a:tbl>"
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 4, 4)
    return {
        "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/><Relationship Id="r2" Type="x/slide" Target="/ppt/slides/slide2.xml"/>'),
        "ppt/slides/slide1.xml": f"<p:sld {A}><a:p><a:r><a:t>Hel</a:t></a:r><a:r><a:t>lo</a:t></a:r></a:p>{table}</p:sld>",
        "ppt/slides/slide2.xml": f"<p:sld {A}><a:p><a:r><a:t>First</a:t></a:r></a:p></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": RELS.format('<Relationship Id="a" Type="x/notesSlide" Target="../notes/n1.xml"/><Relationship Id="b" Type="x/image" Target="../media/i.png"/><Relationship Id="c" Type="x/image" Target="http://x/y.png" TargetMode="External"/>'),
        "ppt/notes/n1.xml": f"<p:notes {A}><a:p><a:r><a:t>Say it</a:t></a:r></a:p></p:notes>",
        "ppt/media/i.png": png,
    }


def test_pptx():
    pages = D.pptx_pages(package(slides()), 3000, 80)
    assert [x[0] for x in pages] == ["First", "Hello\n\n[Speaker Notes]\nSay it"]
    assert pages[1][1] == [[["x", "y"], ["1"]]] and pages[0][3] is None and pages[1][3]


def test_packages_are_guarded():
    with pytest.raises(PackageError):
        Package(b"no zip")
    with pytest.raises(PackageError):
        Package(package({"a": b"x" * 100}), limit=50).read("a")
    with pytest.raises(PackageError):
        Package(package({"a.xml": '<!DOCTYPE x [<!ENTITY y "z">]><x/>'})).xml("a.xml")
    with pytest.raises(PackageError):
        D.docx_pages(package({"x": "y"}), 1, 0)
    assert resolve("ppt/slides", "../media/a.png") == "ppt/media/a.png" and resolve("ppt", "/word/x") == "word/x" and resolve("a", "../../../b") == "b"
    assert pixels(b"GIF89a" + struct.pack("<HH", 3, 5)) == (3, 5) and pixels(b"?") is None


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("Alpha. Beta. Gamma. Delta.")
    (tmp_path / "b.md").write_text("")
    (tmp_path / "c.bin").write_text("x")
    (tmp_path / "d.pdf").write_text("x")
    (tmp_path / "e.docx").write_bytes(docx(p("one")))
    (tmp_path / "f.pptx").write_bytes(package(slides()))
    (tmp_path / "g.docx").write_text("broken")
    rows = D.read_documents(spark, str(tmp_path), size=7, overlap=0).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_title, []).append(r)
    assert [r.text for r in by["a.TXT"]] == ["Alpha.", "Beta.", "Gamma.", "Delta."] and by["a.TXT"][0].total_pages == 4
    assert [r.text for r in by["b.md"]] == [""] and len(by["f.pptx"]) == 2
    assert by["c.bin"][0].error.startswith("no reader") and by["d.pdf"][0].error == "no reader for pdf" and by["g.docx"][0].error.startswith("PackageError")
    picked = D.select_pages(D.read_documents(spark, str(tmp_path / "a.TXT"), 7, 0), "3-4,9").orderBy("page_number").collect()
    said = "page_range '3-4,9' was clipped to the document's 4 pages"
    assert [(r.page_number, list(r.extraction_warnings)) for r in picked] == [(3, [said]), (4, [])]
    config = PipelineConfig(page_range="3-4,9")
    assert [(r.page_number, list(r.extraction_warnings), r.total_pages) for r in D.read_documents(spark, str(tmp_path / "a.TXT"), 7, 0, config=config).orderBy("page_number").collect()] == [(3, [said], 4), (4, [], 4)]
    plugged = D.read_documents(spark, str(tmp_path / "d.pdf"), readers={"pdf": lambda data, size, overlap: [(data.decode(), [], [], None)]}).collect()
    assert [r.text for r in plugged] == ["x"]


def test_results(spark, tmp_path):
    good = {"document": {"document_id": "d", "filename": "f", "total_pages": 2}, "pages": [{"chunk_id": "c", "doc_title": "f", "text": "t", "summary_relevancy": 91.5, "summary_notes": None}, {"text": "u", "summary_relevancy": 120}]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text("{ broken")
    (tmp_path / "c.json").write_text("[1]")
    pages = R.result_pages(R.read_results(spark, str(tmp_path / "*.json"))).orderBy("pos").collect()
    assert [(r.document_id, r.pos, r.text, r.summary_relevancy) for r in pages] == [("d", 0, "t", 92), ("d", 1, "u", None)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in R.read_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    R.write_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    R.write_lines(spark.createDataFrame([(2, "x")], "a int, b string"), str(tmp_path / "out"))
    assert R.read_lines(spark, str(tmp_path / "out"), "a int, b string").count() == 2
