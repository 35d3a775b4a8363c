from hypothesis import given, settings
from hypothesis import strategies as st

from folio_spark.llm import split as S

TEXT = st.lists(st.sampled_from(["ab", "c", " ", "  ", "\n", "\n\n", "\r\n", ". ", "x" * 9, ", ", "é", "😀"]), max_size=120).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(2, 40), st.data())
def test_pieces_cover_the_text_and_repeat_the_overlap(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    spans = S.spans(text, size, overlap)
    assert all(b - a <= size for a, b in spans)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (_, end), (start, next_end) in zip(spans, spans[1:]):
        assert start == end - overlap and next_end > end
    whole = text[: spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:])
    assert whole == text


def test_cuts_at_the_strongest_boundaries():
    text = "One two. Three four.\n\nFive six. Seven eight."
    assert [text[a:b] for a, b in S.spans(text, 30, 0)] == ["One two. Three four.\n\n", "Five six. Seven eight."]
    assert all(b - a <= 10 for a, b in S.spans("a" * 25, 10, 3))


def test_operator_defaults_nulls_and_clashing_names(spark):
    pages = spark.createDataFrame(
        [(1, "d", "word " * 700, "x"), (2, "d", None, "x"), (3, "d", "", "x"), (4, "e", "word " * 30, "x"), (4, "e", "word " * 30, "x"), (5, None, "short", "x"), (6, "f", "word " * 30, "x")],
        "page_id bigint, document_id string, text string, size string",
    )
    per = spark.createDataFrame([("d", None, None), ("e", 50, 90), ("f", -1, -5)], "document_id string, chunk_size int, chunk_overlap int")
    rows = S.split_oversized(pages, per).collect()
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    assert 2 not in by and [r.text for r in by[3]] == [""] and [r.text for r in by[5]] == ["short"]
    assert len(by[1]) == 2 and max(r.n_chars for r in by[1]) <= 3000
    assert all(r.n_chars <= 50 for r in by[4]) and len(by[6]) == 1
    assert len(by[4]) == 2 * len({r.piece_no for r in by[4]})


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, document_id string, text string")
    per = spark.createDataFrame([], "document_id string, chunk_size int, chunk_overlap int")
    assert S.split_oversized(pages, per).count() == 0
