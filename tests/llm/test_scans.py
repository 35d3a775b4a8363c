import pytest

from folio_spark.llm import scans as S

CLEAN = "The committee approved the preliminary maintenance budget across both regions because the valve station was closed. " * 40


@pytest.fixture(scope="module")
def words():
    from collections import Counter

    return S.Words(dict(Counter(CLEAN.lower().replace(".", "").split()) + Counter({"low-cost": 20})))


@pytest.fixture(scope="module")
def layout():
    return S.Layout.from_counts(S.tally(S.page_rows(S._PRIOR, {1})[1], [S.NUMBER, S.HEADER, S.BODY, S.BODY, S.BREAK, S.BODY, S.BODY, S.NUMBER]))


@pytest.mark.parametrize(("token", "word"), [("va1ve", "valve"), ("valvc", "valve"), ("c0mmittee", "committee"), ("rnaintenance", "maintenance"), ("stafion", "station"), ("@pproved", "approved"), ("valve", None), ("B10", None), ("2031", None), ("zebra", None)])
def test_readings(words, token, word):
    assert words.reading(token) == word


@pytest.mark.parametrize(("left", "right", "whole"), [("the prelim-", "inary budget", "preliminary"), ("the prelim\xad", "inary", "preliminary"), ("a low-", "cost plan", None), ("pre-", "and post", None), ("no hyphen", "here", None)])
def test_joins(words, left, right, whole):
    assert S.joins(left, right, words) == whole


def test_page_is_repaired(words, layout):
    text = "WORKS | BUDGET – THE PLAN   7\nThe committee approved the prelim-\ninary budget, because the va1ve station\n\nwas closed. The budget was approved.\n\nThe committee approved the budget.\n- 7 -"
    noise, repaired = S.read_page(text, {0}, True, layout, words)
    assert noise == {"running_header", "page_number", "hyphenation", "misread"}
    assert repaired == "The committee approved the preliminary budget, because the valve station was closed. The budget was approved.\n\nThe committee approved the budget."
    assert S.read_page("", set(), True, layout, words) == (set(), "")


def labelled_pages(seed, n):
    """Pages with the true state of each line: headings and page numbers in clear and in doubtful forms, among body lines."""
    import random

    rng = random.Random(seed)
    words = CLEAN.lower().replace(".", "").split()[:17]
    out = []
    for page in range(1, n + 1):
        lines, states, repeated = [], [], set()

        def add(line, state):
            lines.append(line)
            states.append(state)

        def number():
            add(rng.choice(["- {} -", "{}", "Page {}", "[{}]", "p. {}", "{} / 40"]).format(page) if rng.random() < 0.8 else rng.choice(["PAGE ll", "Page l", "p. O"]), S.NUMBER)

        def heading():
            repeated.add(len(lines))
            add(rng.choice(["Works | Budget: the plan", "WORKS · BUDGET – THE PLAN", "Works Budget Plan Of The Region"]), S.HEADER)

        top = rng.choice(["number", "heading", "none"])
        if top != "none":
            number() if top == "number" else heading()
        for _ in range(rng.randint(3, 9)):
            body = " ".join(rng.choice(words) for _ in range(rng.randint(4, 12)))
            add(rng.choice([body, body + ".", body.capitalize(), body + ",", body + " 12.5%)."]), S.BODY)
            if rng.random() < 0.2:
                add("", S.BREAK)
        if rng.random() < 0.3:
            repeated.add(len(lines))
            add(rng.choice(["were missing.", "the margin was thin."]), S.BODY)
        elif lines[-1] == "":
            add("and closed.", S.BODY)
        if top != "number":
            number() if top == "none" or rng.random() < 0.5 else heading()
        out.append(("\n".join(lines), repeated, states))
    return out


def test_the_model_tells_held_out_lines_better_than_the_rule_it_learns_from(spark):
    train, held = labelled_pages(1, 400), labelled_pages(2, 300)
    rows = spark.createDataFrame([(i, t, sorted(r)) for i, (t, r, _) in enumerate(train)], "page_id bigint, text string, repeated array<int>")
    model = S.fit_layout(rows)
    lines = model_wrong = rule_wrong = 0
    for text, repeated, states in held:
        _, features = S.page_rows(text, repeated)
        lines += len(states)
        model_wrong += sum(a != b for a, b in zip(model.label(features), states))
        rule_wrong += sum(a != b for a, b in zip([S.seed_label(f) for f in features], states))
    assert lines > 2000 and model_wrong <= 0.01 * lines and 3 * model_wrong < rule_wrong, (lines, model_wrong, rule_wrong)


def test_operator(spark):
    head = "Works | Budget: the plan"
    body = "The committee approved the budget across both regions.\nThe valve station was closed."
    pages = [(1, "s", 0, f"{head}\n{body}\n- 1 -", None), (2, "s", 1, f"{head.upper()}\n{body}\n2 / 9", "the va1ve station"), (3, "s", 2, None, None), (4, "f", 0, CLEAN, "approved bud-\nget"), (5, None, 0, CLEAN, ""), (6, "s", 3, "", None), (None, "s", 4, body, "x")]
    rows = spark.createDataFrame(pages, "page_id bigint, document_id string, pos int, text string, image_text string").selectExpr("*", "1 AS noise")
    docs = spark.createDataFrame([("s", '{"source_type": "scan"}'), ("s", '{"source_type": "scan"}'), ("f", '{"source_type": "file"}'), ("g", None)], "document_id string, metadata string")
    got = {(r.page_id, r.field_name): list(r.noise) for r in S.read_scans(rows, docs).collect()}
    assert got == {(1, "text"): ["page_number", "running_header"], (2, "text"): ["page_number", "running_header"], (2, "image_text"): ["misread"], (4, "image_text"): ["hyphenation"], (5, "image_text"): [], (6, "text"): []}
    assert S.read_scans(rows.limit(0), docs.limit(0)).count() == 0
