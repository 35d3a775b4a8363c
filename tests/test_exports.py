import pytest

from folio_spark.operators import exports as X

COLUMNS = "document_id string, pos int, page_id bigint, page_number int, chunk_id string, text string, tables array<array<array<string>>>, summary_notes array<string>, summary_topics array<string>, summary_relevancy int, summary_quality_validated boolean, image_text string, image_text_1 string, image_text_2 string, image_text_3 string, image_base64 string"
NONE = (None,) * 4


def rows(spark):
    pages = [
        ("d1", 1, 2, None, "c2", "bare", [], None, None, None, None, *NONE, "iVBORw0KGgo="), ("d1", 0, 1, 7, "c1", "text", [], ["first note"], ["topic-a", "b"], 92, True, *NONE, "not base64!"),
        ("d2", 0, 3, 1, "c3", " plain ", [[["h|"], ["1", "2"]]], None, None, None, None, " seen ", *NONE[1:], None), ("d3", 0, 4, None, None, None, None, None, None, None, None, *NONE, None),
    ]
    docs = [("d1", "One.pdf", 2, '{"title": "The \\"One\\""}'), ("d2", "Two.pptx", None, None), ("d3", "two.md", 1, None)]
    return spark.createDataFrame(pages, COLUMNS), spark.createDataFrame(docs, "document_id string, filename string, total_pages int, metadata string")


def test_reports(spark):
    got = {r.document_id: r.markdown for r in X.markdown_reports(*rows(spark)).collect()}
    assert got == {
        "d1": "# One.pdf\n\n## Page 7\n\n### Topics\n- topic-a\n- b\n\n### Summary Notes\n- first note\n",
        "d2": "# Two.pptx\n\n## Page 1\n\n### Extracted Text\nplain\n\n### Tables\n| h| |  |\n|---|---|\n| 1 | 2 |\n",
        "d3": "# two.md\n\n## Page 1\n",
    }


def test_bundle(spark, tmp_path):
    pages, docs = rows(spark)
    files = X.bundle_files(pages, docs, "2030-01-02T03:04:05Z")
    got = {r.path: r.content for r in files.collect()}
    assert len(got) == 4 + 3 * 4
    assert got["one/pages/page-0007.md"] == (
        '---\ntype: "Document Page"\ntitle: "Page 7 — One.pdf"\ndescription: "first note"\ntags: ["topic-a", "b"]\ntimestamp: "2030-01-02T03:04:05Z"\nsummarizer_chunk_id: "c1"\nsummarizer_relevancy: 92\n'
        'summarizer_quality_validated: true\nsource_document_id: "d1"\nsource_page_number: 7\n---\n\nPage 7 of [One.pdf](/document.md).\n\n# Topics\n- topic-a\n- b\n\n# Notes\n- first note\n\n# Extracted Text\ntext\n'
    )
    assert got["two/pages/page-0001.md"].endswith("Slide 1 of [Two.pptx](/document.md).\n\n# Visual Extraction\nseen\n\n# Extracted Text\nplain\n\n# Tables\n| h\\| |  |\n|---|---|\n| 1 | 2 |\n")
    assert got["two-d3/pages/page-0001.md"].endswith("\n\n_(No extracted content for this page.)_\n")
    assert got["one/pages/index.md"] == "# Pages\n\n* [Page 7](page-0007.md) - first note\n* [Page 2](page-0002.md) - bare\n"
    assert 'title: "The \\"One\\""\ndescription: "One.pdf — 2 pages, 1 summarized."\ntags: ["topic-a", "b"]' in got["one/document.md"]
    assert got["one/document.md"].endswith("Structured extraction of **One.pdf** (2 pages).\n\n# Pages\n* [Page 7](/pages/page-0007.md) - first note\n* [Page 2](/pages/page-0002.md) - bare\n")
    assert "per-slide concept(s)." in got["two/index.md"] and "## 2030-01-02" in got["two/log.md"]
    X.write_files(files, str(tmp_path / "b"))
    assert (tmp_path / "b/one/log.md").read_text() == got["one/log.md"]
    with pytest.raises(Exception, match="outside"):
        X.write_files(spark.createDataFrame([("../x", "y")], "path string, content string"), str(tmp_path / "b"))
    single = {r.path: r.content for r in X.single_files(pages, docs, "2030").collect()}
    assert set(single) == {"one.okf.md", "two.okf.md", "two-d3.okf.md"} and "\n## Page 7\n\n### Topics\n" in single["one.okf.md"]
    assert {r.document_id: r.tags for r in X.document_tags(pages).collect()} == {"d1": ["topic-a", "b"]}


def test_assets(spark):
    pages, docs = rows(spark)
    assert [(r.document_id, r.path, bytes(r.data)[:4]) for r in X.image_files(pages).collect()] == [("d1", "images/page-0002.png", b"\x89PNG")]
    assert [r.line for r in X.page_records(pages.where("page_id = 3")).collect()] == ['{"page_number":1,"text":" plain ","summary_notes":null,"summary_topics":null}']
    assert [(r.filename, r.table_index, r.path) for r in X.table_records(pages, docs).collect()] == [("Two.pptx", 0, "tables/page-0001-table-1.csv")]
