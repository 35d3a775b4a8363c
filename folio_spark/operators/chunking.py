"""Fixed-size chunks with overlap, as document readers cut plain text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from folio_spark.session import skip_empty

SIZE, OVERLAP = 3000, 80
SEPARATORS = ("\n\n", "\n", ". ", " ")


def cuts(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the windows of ``text`` in code points.

    A window is cut after its last blank line, else line end, else sentence, else blank; a
    separator at its very beginning doesn't count. The last window is cut in the same way,
    so tails come in ever smaller windows. The next one starts ``overlap`` before the cut,
    or at the cut where that would be no progress.
    """
    if not text:
        return []
    if len(text) <= size:
        return [(0, len(text))]
    overlap = min(overlap, max(size - 1, 0))
    out, start = [], 0
    while True:
        window = text[start : start + size]
        cut = next((start + at + len(s) for s in SEPARATORS if (at := window.rfind(s)) > 0), start + len(window))
        out.append((start, cut))
        if cut >= len(text):
            return out
        back = max(0, cut - overlap)
        start = back if start < back < cut else cut


def chunk(rows: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, dedupe_contained: bool = False) -> DataFrame:
    """``key``, ord, start, end, text: trimmed non-blank chunks (a text that fits is left as it is).

    ``dedupe_contained`` leaves out windows that lie within the one before them.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                spans, last = cuts(t, size, overlap), 0
                if len(spans) == 1:
                    out.append((k, 0, 0, len(t), t))
                    continue
                n = 0
                for a, b in spans:
                    if (piece := t[a:b].strip()) and not (dedupe_contained and b <= last):
                        out.append((k, n, a, b, piece))
                        n += 1
                    last = max(last, b)
            yield pd.DataFrame(out, columns=[key, "ord", "start", "end", "text"])

    return rows.selectExpr(f"{key} AS k", f"{text} AS t").where("t IS NOT NULL").mapInPandas(skip_empty(run), f"{key} {kind}, ord int, start int, end int, text string")
