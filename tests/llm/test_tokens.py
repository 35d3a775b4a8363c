import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio_spark.llm import tokens as T

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def counting():
    try:
        return T.Counting()
    except OSError:
        pytest.skip("no vocabulary files")


TEXT = st.lists(st.sampled_from(["the", " the", "ing", " ", "  ", "\n", "\t", " ", "63", "don't", "é", "é", "😀", "漢字", "...", "—", "zzqx", "A"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_chunks_count_exactly(text):
    counting = T.Counting()
    assert counting(text) == len(counting.encoding.encode_ordinary(text)) and "".join(T.chunks(text)) == text


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12), max_size=30))
def test_prefix_states_are_exact(pieces):
    known = T.Counting().encoding._mergeable_ranks
    encode = T.Counting().encoding._encode_single_piece
    pieces = sorted(pieces)
    assert list(T.prefix_states(pieces, known, encode)) == [len(encode(p)) for p in pieces]


test_chunks_count_exactly = pytest.mark.usefixtures("counting")(test_chunks_count_exactly)
test_prefix_states_are_exact = pytest.mark.usefixtures("counting")(test_prefix_states_are_exact)


@pytest.mark.parametrize("head", [0, 5, 65536])
def test_operator_equals_the_tokenizer(spark, counting, head):
    texts = ["The valve station at Dexlimm Works.", None, "", " \n\n ", "Zahl 63.727 und 1,5 %", "x" * 3000, "The valve station at Dexlimm Works.", "the the  the\tthe\r\n"]
    items = spark.createDataFrame([("c", i, "s", t, -1) for i, t in enumerate(texts)], "corpus string, item_id bigint, source string, text string, tokens int")
    got = {r.item_id: r.tokens for r in T.token_items(items, ["corpus", "item_id", "source"], max_head=head).collect()}
    assert got == {i: len(counting.encoding.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_languages_and_totals(spark, counting):
    from pyspark.sql import functions as F

    codes = spark.createDataFrame([("en-GB",), ("EN",), ("eng",), ("",), (None,), ("fra",), ("de_AT",)], "l string").select(T.language(F.col("l")).alias("l")).collect()
    assert [r.l for r in codes] == ["en", "en", "en", None, None, "fr", "de"]
    items = spark.createDataFrame([("c", 1, "a", "en", None, 3), ("c", 2, "a", None, "x", 4), ("c", 3, "b", "en", "x", 5)], "corpus string, item_id bigint, source string, lang string, domain string, tokens bigint")
    got = {(r.level, r.source, r.lang, r.domain): r.tokens for r in T.totals(items).collect()}
    assert got["corpus", None, None, None] == 12 and got["source", "a", None, None] == 7 and got["lang", None, "en", None] == 8 and got["domain", None, None, "x"] == 9 and got["all", "a", None, "x"] == 4


def test_empty(spark, counting):
    assert T.token_items(spark.createDataFrame([], "item_id bigint, text string"), ["item_id"]).count() == 0
