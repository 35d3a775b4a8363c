"""Pieces of the SQL that the queries are compared with."""

from __future__ import annotations

WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def filled(x: str) -> str:
    return f"(coalesce({strip(x)}, '') <> '')"


def some(x: str) -> str:
    return f"(coalesce(len({x}), 0) > 0)"


def words(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{NOT_WS}+'))"


def tokens(x: str) -> str:
    s = f"coalesce({strip(x)}, '')"
    return f"(CASE WHEN {s} = '' THEN 0 ELSE greatest({words(s)}, CAST(ceil(length({s}) / 4.0) AS BIGINT), 1) END)"


PAGE_NO = "coalesce(CASE WHEN page_number > 0 THEN page_number END, pos + 1)"
VISUALS = "[image_text, image_text_1, image_text_2, image_text_3]"
VISUAL_CORPUS = strip(f"array_to_string(list_filter({VISUALS}, lambda x: x IS NOT NULL AND {strip('x')} <> ''), chr(10))")
VISUAL_QUERY = f"array_to_string(list_filter(list_transform({VISUALS}, lambda x: {strip(chr(99) + 'oalesce(x, ' + chr(39) * 2 + ')')}), lambda x: x <> ''), chr(10) || chr(10))"
REASON = (
    f"CASE WHEN {some('extraction_warnings')} THEN 'extraction_warnings' WHEN summary_relevancy < 70 THEN 'low_relevancy' "
    f"WHEN NOT {filled('text')} AND {VISUAL_CORPUS} = '' AND NOT {some('tables')} THEN 'empty' ELSE 'keep' END"
)
HAS_SUMMARY = f"({some('summary_notes')} OR {some('summary_topics')})"
FLAT = f"regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')"
DESCRIPTION = (
    f"coalesce(CASE WHEN {some('summary_notes')} THEN {strip('summary_notes[1]')} END, "
    f"nullif(CASE WHEN length({strip(FLAT)}) > 120 THEN left({strip(FLAT)}, 117) || '...' ELSE {strip(FLAT)} END, ''), "
    f"{strip('left(' + VISUAL_QUERY + ', 120)')})"
)


def md_row(cells: str) -> str:
    return f"('| ' || array_to_string({cells}, ' | ') || ' |')"


def md_table(t: str, cell: str = "c", padded: bool = True) -> str:
    n = f"list_max(list_transform({t}, lambda r: len(r)))" if padded else f"len({t}[1])"
    cells = f"list_transform(r, lambda c: {cell})"
    row = md_row(f"list_concat({cells}, list_transform(range(0, greatest(0, {n} - len(r))), lambda i: ''))" if padded else cells)
    rows = f"list_transform({t}, lambda r: {row})"
    rule = f"('|' || repeat('---|', {n}))"
    return f"array_to_string(list_concat({rows}[1:1], [{rule}], {rows}[2:]), chr(10))"
