"""Tables in plain text: runs of lines with as many cells, at least two by two."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.functions.text import lines, strip


def cells(line: Column, keep_spaces: bool = False) -> Column:
    """Cells of a line: cut at tabs, else at bars (outer ones dropped), else at runs of blanks.

    Blank cells are dropped, and a line of fewer than two cells has none. Cells cut at runs
    of blanks lose their single blanks, unless ``keep_spaces``.
    """
    bars = F.regexp_replace(strip(line), r"^\||\|$", "")
    gaps = F.transform(F.split(strip(line), " {2,}", -1), lambda c: c if keep_spaces else F.replace(c, F.lit(" "), F.lit("")))
    raw = F.when(line.contains("\t"), F.split(line, "\t", -1)).when(line.contains("|"), F.split(bars, r"\|", -1)).otherwise(gaps)
    out = F.filter(F.transform(raw, strip), lambda c: c != "")
    return F.when(F.size(out) >= 2, out).otherwise(F.array().cast("array<string>"))


def text_tables(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, table_no, n_rows, n_cols, first_line: maximal runs of at least two lines with one number of cells.

    Lines are cut into cells in the JVM; the runs in a text's numbers of cells are found row by row, so nothing is shuffled.
    """

    @F.pandas_udf("array<struct<n_rows: bigint, n_cols: int, first_line: int>>")
    def runs(counts: pd.Series) -> pd.Series:
        def of(n: np.ndarray) -> list[dict]:
            n = np.asarray(n)
            starts = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.zeros(0, int)
            long = np.diff(np.append(starts, len(n)))
            return [{"n_rows": int(k), "n_cols": int(n[a]), "first_line": int(a)} for a, k in zip(starts, long) if n[a] >= 2 and k >= 2]

        return counts.map(of)

    at = rows.where(F.col(text).isNotNull()).select(key, runs(F.transform(lines(text), lambda x: F.size(cells(x)))).alias("found"))
    return at.select(key, F.posexplode("found").alias("at", "t")).select(key, (F.col("at") + 1).alias("table_no"), "t.n_rows", "t.n_cols", "t.first_line")


def footer_move(text: Column) -> Column:
    """A page's text, trimmed; if its first filled line bears a copyright sign, the block of lines that it begins, trimmed, is put to the end.

    The block ends at the first blank line; the rest loses blanks at line ends and stands before it.
    """
    every = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), lambda x: x)
    first = F.array_position(F.transform(every, lambda x: strip(x) != ""), F.lit(True)).cast("int")
    rest = F.slice(every, first, F.size(every) - first + 1)
    blank = F.array_position(F.transform(rest, lambda x: strip(x) == ""), F.lit(True)).cast("int")
    length = F.when(blank > 0, blank - 1).otherwise(F.size(rest))
    footer = F.array_join(F.transform(F.slice(rest, F.lit(1), length), strip), "\n")
    after = F.when(blank > 0, F.slice(rest, blank + 1, F.size(rest) - blank)).otherwise(F.array().cast("array<string>"))
    body = strip(F.array_join(F.transform(after, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n"))
    moved = F.when(body == "", footer).otherwise(F.concat(body, F.lit("\n"), footer))
    return F.when(first == 0, F.lit("")).when(F.contains(F.get(every, first - 1), F.lit("©")), moved).otherwise(strip(text))
