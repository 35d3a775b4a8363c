import pytest
from pyspark.sql import functions as F

from folio_spark.config import PipelineConfig
from folio_spark.functions import tables as M
from folio_spark.functions import text as X
from folio_spark.operators.chunking import chunk, cuts
from folio_spark.operators.pages import PagesFrame, parse_range, sample_range
from folio_spark.operators.text_tables import footer_move, text_tables


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [("92%", 92), ("8/10", 8), ("0.85", 0), ("score: 110", None), ("no score", None), (None, None), ("9" * 40, None)])
def test_percent(spark, text, want):
    assert one(spark, text, X.parse_percent) == want


def test_text_functions(spark):
    assert one(spark, " \n a  b\t", X.strip) == "a  b"
    assert one(spark, "a b\nc", X.word_count) == 3
    assert one(spark, "", X.estimate_tokens) == 0 and one(spark, " x ", X.estimate_tokens) == 1 and one(spark, "a" * 41, X.estimate_tokens) == 11
    assert one(spark, "* 3 items\n2024 sales\n\n-• x \r\n1.) y", X.clean_bullets) == ["3 items", "sales", "x", "y"]
    assert one(spark, "- a, b\nc,d,,e, f", X.clean_topics) == ["a", "b", "c", "d", "e"]
    assert one(spark, "My Report (v2).docx", X.slugify) == "my-report-v2" and one(spark, "....pdf", X.slugify) == "document"
    assert one(spark, 'a "b"\\', X.yaml_scalar) == '"a \\"b\\"\\\\"' and one(spark, " a\r\nb\n", X.yaml_scalar) == '"a b"'
    assert one(spark, " <|channel|>thought<channel|> said ", X.clean_answer) == "said" and one(spark, "a <|channel|>thought<channel|>", X.clean_answer) == "a <|channel|>thought<channel|>"
    assert one(spark, "What is it?", X.question_hash) == one(spark, "what  IS, it", X.question_hash)
    assert one(spark, "token=abc123; Authorization: Bearer x, sk-abcdefghijkl xoxb-123456789012 ghp_abcdefghijkl sk-short", X.redact) == "token=[REDACTED]; Authorization: [REDACTED] x, [REDACTED] [REDACTED] [REDACTED] sk-short"
    assert one(spark, "../a b/c", X.log_base_name) == "a-b-c" and one(spark, None, X.log_base_name) == "app"
    assert [one(spark, v, X.score_value) for v in ("7.9", "0", "99", "x", None)] == [7, 1, 10, None, None]


def test_tables(spark):
    t = [["a", "b"], ["1"], ["x|y", "c\nd", 'q"']]
    kind = "array<array<string>>"
    assert one(spark, t, M.report_markdown, kind) == '| a | b |  |\n|---|---|---|\n| 1 |  |  |\n| x|y | c\nd | q" |'
    assert one(spark, t, M.bundle_markdown, kind).endswith('| x\\|y | c d | q" |')
    assert one(spark, [t[:2], [], [["z"]]], M.corpus_markdown, f"array<{kind}>") == "| a | b |\n|---|---|\n| 1 |\n\n| z |\n|---|"
    assert one(spark, [["h"]] + [[str(i)] for i in range(3000)], M.report_markdown, kind).count("\n") == 3001 and one(spark, [[], []], M.report_markdown, kind) == ""
    assert one(spark, t[2], M.csv_line, "array<string>") == 'x|y,"c\nd","q"""'


def test_page_ranges():
    assert parse_range("3,1-2,2") == [1, 2, 3]
    for bad in ("0", "3-2", "1,,2", "", "a"):
        with pytest.raises(ValueError):
            parse_range(bad)
    assert sample_range(10, 3) == [1, 6, 10] and sample_range(100, 6) == [1, 2, 50, 51, 99, 100] and sample_range(5, 0) == [1] and sample_range(3, 9) == [1, 2, 3]
    for total in range(1, 40):
        for n in range(1, 12):
            got = sample_range(total, n)
            assert len(got) == min(n, total) and got == sorted(set(got)) and got[0] >= 1 and got[-1] <= total


def test_chunks(spark):
    text = "Alpha. Beta. Gamma. Delta."
    assert [text[a:b].strip() for a, b in cuts(text, 7, 0)] == ["Alpha.", "Beta.", "Gamma.", "Delta."]
    assert cuts("", 5, 1) == [] and cuts("abc", 5, 1) == [(0, 3)] and cuts("abcdefg", 3, 0) == [(0, 3), (3, 6), (6, 7)]
    assert len(cuts("alpha beta gamma delta eps zeta", 18, 5)) > 1
    rows = spark.createDataFrame([(1, text * 20), (2, None), (3, " a ")], "k bigint, t string")
    whole = chunk(rows, "k", "t", 50, 10).collect()
    assert [r.text for r in whole if r.k == 3] == [" a "] and {r.k for r in whole} == {1, 3}
    assert chunk(rows, "k", "t", 50, 10, dedupe_contained=True).count() < len(whole)


def test_text_tables(spark):
    text = "Name    Sales\nNorth   10\nSouth   20\nA line of prose.\n| a | b |\n| 1 | 2 |\n| 3 | 4 |"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "x\ty")], "page_id bigint, text string")
    assert [(r.page_id, r.table_no, r.n_rows, r.n_cols, r.first_line) for r in text_tables(rows, "page_id").orderBy("table_no").collect()] == [(1, 1, 3, 2, 0), (1, 2, 3, 2, 4)]


def test_footer_moves(spark):
    assert one(spark, "© 2030 Works\nmore\n\nBody.\n\nEnd.", footer_move) == "Body.\n\nEnd.\n© 2030 Works\nmore"
    assert one(spark, "Body © here\n\nEnd.", footer_move) == "End.\nBody © here" and one(spark, " Body.\n\n© x\n", footer_move) == "Body.\n\n© x"
    assert one(spark, "\n \n © a \n b\n", footer_move) == "© a\nb" and one(spark, " \n ", footer_move) == "" and one(spark, "© a\r\n\r\nx  \r\ny", footer_move) == "x\ny\n© a"


def test_log_fields():
    assert X.redact_json('{"a":{"my-token":[1],"x":"secret: s1, y"},"n":[1,null,"ghp_abcdefghijkl"]}') == '{"a":{"my-token":"[REDACTED]","x":"secret: [REDACTED], y"},"n":[1,null,"[REDACTED]"]}'
    assert X.redact_json("not json, password=x") == "not json, password=[REDACTED]" and X.redact_json(None) is None and X.redact_json('{ "b": 1 }') == '{ "b": 1 }'
    assert [X.secret_name(n) for n in ("API_KEY", "apikey", "user.key", "keys", "monkey", "Authorization")] == [True, True, True, False, False, True]


def test_fields_are_checked(spark):
    with pytest.raises(ValueError, match="no such field: nope"):
        PagesFrame(spark.createDataFrame([(1,)], "page_id int")).fields(["nope"])


def test_config():
    base = PipelineConfig()
    assert base.merged({"chunk_size": 10, "unknown": 1, "chunk_overlap": None}).chunk_size == 10
    assert base.with_settings(["chunk_size=5", "vision_mode=codex"]).vision_mode == "codex" and base.preset("finetune-ingest").summarizer_detailed_extraction
    assert base.digest() == PipelineConfig().digest() != base.merged({"chunk_size": 1}).digest()
    with pytest.raises(ValueError):
        PipelineConfig(pdf_image_dpi="99")


def test_most_frequent_is_bounded(spark):
    from folio_spark.session import most_frequent, numbered

    rows = spark.createDataFrame([(f"w{i}", 1 + i // 10) for i in range(1000)], "word string, n bigint")
    got = {r.n for r in most_frequent(rows, "n", 100).collect()}
    assert 0 < len(got) <= 10 and got == set(range(101 - len(got), 101))
    assert most_frequent(rows, "n", 5).count() == 0 and most_frequent(rows, "n", 5000).count() == 1000 and most_frequent(rows.limit(0), "n", 5).count() == 0
    placed = numbered(rows.repartition(7), [F.desc("n"), "word"], "at").collect()
    assert [r.word for r in sorted(placed, key=lambda r: r.at)] == [r.word for r in rows.orderBy(F.desc("n"), "word").collect()] and sorted(r.at for r in placed) == list(range(1000))
