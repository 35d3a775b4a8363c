"""Tables (rows of cells) as Markdown and CSV. The three Markdown forms differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio_spark.functions.text import strip


def width(table: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(table, lambda r: F.size(r))), F.lit(0))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _padded(row: Column, n: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(F.lit(0), n - F.size(row))))


def _rule(n: Column) -> Column:
    return F.concat(F.lit("|"), F.repeat(F.lit("---|"), n))


def _ruled(rows: Column, rule: Column) -> Column:
    """Row lines with the rule after the first."""
    return F.array_join(F.flatten(F.transform(rows, lambda r, i: F.when(i == 0, F.array(r, rule)).otherwise(F.array(r)))), "\n")


def report_markdown(table: Column) -> Column:
    """Rows padded to the widest; the first is the header. A table without cells is empty."""
    n = width(table)
    return F.when(n == 0, F.lit("")).otherwise(_ruled(F.transform(table, lambda r: _row(_padded(r, n))), _rule(n)))


def corpus_markdown(tables: Column) -> Column:
    """Rows as they are, the rule as wide as the header, a blank line between tables."""
    def one(t: Column) -> Column:
        return _ruled(F.transform(t, _row), _rule(F.coalesce(F.size(F.get(t, F.lit(0))), F.lit(0))))

    return F.array_join(F.transform(F.filter(tables, lambda t: F.size(t) > 0), one), "\n\n")


def escape_cell(cell: Column) -> Column:
    """A cell with backslashes, bars and line ends made harmless, trimmed."""
    out = F.replace(F.replace(cell, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return strip(F.replace(out, F.lit("\n"), F.lit(" ")))


def bundle_markdown(table: Column) -> Column:
    """Padded and escaped."""
    return report_markdown(F.transform(table, lambda r: F.transform(r, escape_cell)))


def csv_line(row: Column) -> Column:
    """A row as a CSV line; cells with commas, quotes or line ends are quoted."""
    def cell(x: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(x.rlike('[,"\r\n]'), quoted).otherwise(x)

    return F.array_join(F.transform(row, lambda x: cell(F.coalesce(x, F.lit("")))), ",")
