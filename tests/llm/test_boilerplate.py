import re

from folio_spark.llm import boilerplate as B


def brute(rows, least=10, pct=5):
    n, on = {}, {}
    for title, page, text in rows:
        n[title] = n.get(title, 0) + 1
        for k, line in enumerate((text or "").split("\n")):
            letters = "".join(c for c in line if c.isalpha())
            if len(letters) >= 8:
                on.setdefault((title, letters.lower()), []).append((page, k + 1))
    return {x for (t, _), xs in on.items() if len({p for p, _ in xs}) >= least and len({p for p, _ in xs}) * 100 >= pct * n[t] for x in xs}


def test_equals_brute_force(spark):
    rows = []
    for i in range(400):
        foot = ["Issue 12 | Works | For internal use", "ISSUE 13  works for INTERNAL use!", "issue works for internal use - 7"][i % 3]
        rows.append(("hot", i * 977, f"Body number {'abcdefghij'[i % 10] * (i % 17 + 3)}\n\n{foot if i % 3 else ''}\nshort 1"))
    rows += [("rare", 10**12 + i, "Only on nine pages of this title") for i in range(9)] + [(None, 5 * 10**9 + i, "The null title has lines too\r") for i in range(12)]
    rows += [("t", 77, None), ("t", 78, ""), ("twice", 90, "\n".join(["The same line again"] * 20))]
    pages = spark.createDataFrame(rows, "doc_title string, page_id bigint, text string")
    got = {(r.page_id, r.line_no) for r in B.recurring(pages).collect()}
    assert got == brute(rows) and len(got) > 200
    clean = {r.page_id: r for r in B.without_recurring(pages).collect()}
    assert clean[977].text.split("\n")[0].startswith("Body") and not re.search("internal", clean[977].text) and clean[977].removed == 1
    assert clean[77].text is None and clean[78].text == "" and len(clean) == len(rows)


def test_empty(spark):
    assert B.recurring(spark.createDataFrame([], "doc_title string, page_id bigint, text string")).count() == 0
