"""Text functions. Lengths are code points; white space is Unicode white space."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Without white space at both ends (SQL's trim takes blanks only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank(c: ColumnOrName) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def word_count(c: ColumnOrName) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"(?U)\S+"))


def estimate_tokens(c: ColumnOrName) -> Column:
    """The larger of words, a fourth of the characters, and 1; 0 for blank text."""
    text = F.coalesce(strip(c), F.lit(""))
    return F.when(text == "", 0).otherwise(F.greatest(word_count(text), F.ceil(F.length(text) / 4), F.lit(1))).cast("bigint")


def normalize_entity(c: ColumnOrName) -> Column:
    return F.lower(strip(c))


def question_hash(c: ColumnOrName) -> Column:
    """SHA-256 of the lower-case text without anything but word characters."""
    return F.sha2(F.regexp_replace(F.lower(col(c)), r"(?U)\W", ""), 256)


def overlap_tokens(c: ColumnOrName) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"([a-z0-9%$.]{3,})"), 1))


def token_overlap(gold: ColumnOrName, candidate: ColumnOrName) -> Column:
    """Share of the gold text's distinct tokens that the candidate has."""
    mine = overlap_tokens(gold)
    return F.size(F.array_intersect(mine, overlap_tokens(candidate))) / F.greatest(F.lit(1), F.size(mine))


def parse_percent(c: ColumnOrName) -> Column:
    """The first run of digits, if it is at most 100."""
    n = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"([0-9]+)", 1).try_cast("bigint")
    return F.when(n <= 100, n.cast("int"))


def lines(c: ColumnOrName) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r?\n\z", "")
    return F.when(F.coalesce(col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\r?\n", -1))


def clean_bullets(c: ColumnOrName) -> Column:
    """Lines without list marks: a run of ``*-•``, then a run of digits, points and brackets; blank ones dropped.

    There is no trimming between the two, so ``* 3 items`` keeps its number and ``2024 sales`` loses it.
    """
    def one(x: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(strip(x), r"^[*\-•]+", ""), r"^[0-9.)]+", ""))

    return F.filter(F.transform(lines(c), one), lambda x: x != "")


def clean_topics(c: ColumnOrName) -> Column:
    """``clean_bullets`` of the lines and of their parts between commas; the first five."""
    parts = F.flatten(F.transform(lines(c), lambda x: F.split(x, ",", -1)))

    def one(x: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(strip(x), r"^[*\-•]+", ""), r"^[0-9.)]+", ""))

    return F.slice(F.filter(F.transform(parts, one), lambda x: x != ""), 1, 5)


def clean_answer(c: ColumnOrName) -> Column:
    """A model's answer without leading marks of its thinking channel and surrounding white space."""
    return strip(F.regexp_replace(strip(c), r"^(?:<\|channel\|>thought<channel\|>)+", ""))


def score_value(c: ColumnOrName) -> Column:
    """A number as a score from 1 to 10; null if it is none."""
    n = F.floor(col(c).cast("string").try_cast("double")).cast("int")
    return F.when(n.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), n)))


def slugify(c: ColumnOrName) -> Column:
    """A file name's stem in lower case with single hyphens."""
    stem = F.regexp_replace(col(c), r"\.[A-Za-z0-9]{1,5}$", "")
    slug = F.regexp_replace(F.lower(F.regexp_replace(stem, r"[^A-Za-z0-9]+", "-")), r"^-+|-+$", "")
    return F.when(slug == "", F.lit("document")).otherwise(slug)


def yaml_scalar(c: ColumnOrName) -> Column:
    """A string as a double-quoted YAML scalar; line ends become blanks, and the ends are trimmed."""
    flat = strip(F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit(" ")))
    text = F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), text, F.lit('"'))


#: Shapes of secrets that are taken out of log text, in this order, and what stands for them.
SECRETS = (
    (r"(sk-[A-Za-z0-9_\-]{12,})", "[REDACTED]"),
    (r"(xox[baprs]-[A-Za-z0-9\-]{12,})", "[REDACTED]"),
    (r"(gh[pousr]_[A-Za-z0-9_]{12,})", "[REDACTED]"),
    (r"(api[_-]?key|authorization|bearer|token|secret|password)(\s*[:=]\s*)([^\s,;]+)", "$1$2[REDACTED]"),
)
#: Members whose name is one of these, or has a part that is, are taken out whole.
SECRET_NAMES = ("authorization", "password", "secret", "api_key", "apikey")
SECRET_PARTS = ("authorization", "password", "secret", "apikey", "api_key", "key", "token")


def redact(c: ColumnOrName) -> Column:
    """Log text without tokens and key=value secrets."""
    out = col(c)
    for pattern, to in SECRETS:
        out = F.regexp_replace(out, "(?iU)" + pattern, to)
    return out


def redact_text(text: str) -> str:
    """``redact`` for one string."""
    for pattern, to in SECRETS:
        text = re.sub("(?i)" + pattern, to.replace("$1", r"\1").replace("$2", r"\2"), text)
    return text


def secret_name(name: str) -> bool:
    name = "".join(c.lower() if c.isascii() else c for c in name)
    return name in SECRET_NAMES or any(p in SECRET_PARTS for p in re.split("[^a-z0-9]+", name))


def redact_json(text: str | None) -> str | None:
    """A JSON value with the strings in it redacted, and whole members of secret names, at any depth; other text as text."""

    def walk(x):
        if isinstance(x, str):
            return redact_text(x)
        if isinstance(x, list):
            return [walk(v) for v in x]
        if isinstance(x, dict):
            return {k: "[REDACTED]" if secret_name(k) else walk(v) for k, v in x.items()}
        return x

    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return redact_text(text)
    clean = walk(value)
    return text if clean == value else json.dumps(clean, ensure_ascii=False, separators=(",", ":"))


def redact_fields(c: ColumnOrName) -> Column:
    """``redact_json`` of a column, in Arrow batches: JSON of any shape and depth has no built-in transformation."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(redact_json, na_action="ignore")

    return run(col(c))


def log_base_name(c: ColumnOrName) -> Column:
    """A job id made safe as a file name: runs of other characters become one hyphen; at most 120."""
    safe = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^A-Za-z0-9._]+", "-")
    safe = F.left(F.regexp_replace(safe, r"^[-.]+|[-.]+$", ""), F.lit(120))
    return F.when(safe == "", F.lit("app")).otherwise(safe)
