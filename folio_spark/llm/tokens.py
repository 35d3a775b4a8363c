"""Token budgets per source and language under an existing byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.session import materialize, most_frequent, skip_empty, table

#: Where the vocabulary files of public tokenizers lie, on every executor. A parameter of all operators here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that this vocabulary splits text by before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_HEAD, PREFIX = 65_536, 3

_BLANKS = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]
_BEFORE = re.compile(r"(?<=\S)(?= \S)")


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def chunks(text: str) -> list[str]:
    """``text`` cut before every single blank between two words. No piece of the pattern crosses
    such a cut, so texts can be counted chunk by chunk, and there are few distinct chunks."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(b in text for b in _BLANKS):
        return _BEFORE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]]


class Counting:
    """Exact token counts of texts, chunk by chunk, with a bounded memory of chunks."""

    def __init__(self, path: str = TOKENIZERS, vocabulary: str = VOCABULARY, remember: int = 400_000):
        import tiktoken

        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(os.path.join(path, vocabulary)), special_tokens={})
        self.known: dict[str, int] = {}
        self.remember = remember

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        for chunk in chunks(text):
            n = known.get(chunk)
            if n is None:
                if len(known) >= self.remember:
                    known.clear()
                n = known[chunk] = len(self.encoding.encode_ordinary(chunk))
            total += n
        return total


def sized(rows: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and n_tokens of every row; a null text has none. Narrow: for operators that need sizes only."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = Counting(path, vocabulary)
        for pdf in batches:
            out = pdf[keep].copy()
            out["n_tokens"] = [count(t) if t else 0 for t in pdf["_text"]]
            yield out

    return rows.select(*keep, F.col(text).alias("_text")).mapInPandas(skip_empty(run), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint")


def prefix_states(pieces: Iterable[bytes], vocabulary: dict[bytes, int], encode_pair) -> Iterator[int]:
    """Token counts of sorted pieces, walking their prefix trie.

    Along the path to the current piece lie the exact tokenization states of its prefixes:
    the last token of the prefix's encoding and its length in tokens. The encoding of a
    prefix is the one of a shorter prefix plus a last token that merges would not have
    joined differently with the token before it; there is exactly one such token. The next
    piece keeps the states of the prefix it shares and goes on from there.
    """
    longest = max(map(len, vocabulary))
    fits: dict[tuple[bytes, bytes], bool] = {}
    before, last, count = b"", [None], [0]
    for piece in pieces:
        same, most = 0, min(len(piece), len(before))
        while same < most and piece[same] == before[same]:
            same += 1
        del last[same + 1 :], count[same + 1 :]
        for end in range(same + 1, len(piece) + 1):
            for at in range(max(0, end - longest), end):
                token = piece[at:end]
                if token not in vocabulary or (at and last[at] is None):
                    continue
                if at:
                    pair = (last[at], token)
                    if (ok := fits.get(pair)) is None:
                        if len(fits) > 500_000:
                            fits.clear()
                        ok = fits[pair] = encode_pair(pair[0] + token) == [vocabulary[pair[0]], vocabulary[token]]
                    if not ok:
                        continue
                last.append(token)
                count.append(count[at] + 1)
                break
            else:
                raise ValueError(f"the vocabulary has no token for byte {piece[end - 1]}")
        yield count[-1]
        before = piece


def piece_counts(items: DataFrame, path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """piece, n (occurrences in all texts), tokens: every distinct piece of ``items.text``, tokenized once.

    Pieces are counted per task before the shuffle, spread by their first characters, sorted,
    and each part's trie is walked in one pass.
    """

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        pattern = regex.compile(PATTERN)
        seen: Counter = Counter()

        def flush() -> pd.DataFrame:
            found: Counter = Counter()
            for chunk, n in seen.items():
                for piece in pattern.findall(chunk):
                    found[piece] += n
            seen.clear()
            return pd.DataFrame({"piece": list(found), "n": list(found.values())}, columns=["piece", "n"])

        for pdf in batches:
            for text in pdf.text:
                seen.update(chunks(text))
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        known = ranks(os.path.join(path, vocabulary))
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})._encode_single_piece
        rows: list[tuple[str, int]] = []

        def pieces() -> Iterator[bytes]:
            for pdf in batches:
                for piece, n in zip(pdf.piece, pdf.n):
                    rows.append((piece, n))
                    yield piece.encode()

        done = []
        for tokens in prefix_states(pieces(), known, encode):
            done.append((*rows.pop(), tokens))
            if len(done) >= 20_000:
                yield pd.DataFrame(done, columns=["piece", "n", "tokens"])
                done = []
        yield pd.DataFrame(done, columns=["piece", "n", "tokens"])

    seen = items.select("text").where("text IS NOT NULL").mapInPandas(skip_empty(distinct), "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    parts = seen.repartition(F.substring("piece", 1, PREFIX)).sortWithinPartitions("piece")
    return parts.mapInPandas(skip_empty(walk), "piece string, n bigint, tokens int")


def token_items(items: DataFrame, keys: list[str], path: str = TOKENIZERS, vocabulary: str = VOCABULARY, max_head: int = MAX_HEAD) -> DataFrame:
    """``keys`` and tokens of every row of ``items`` (``keys`` and text): its exact token count.

    The ``max_head`` most frequent pieces, a table bounded by that number, go to all tasks and
    nearly always settle a row where it is; only rows with rarer pieces are joined with the
    counts of those, piece by piece. Null texts have no tokens and stay in the result, as do
    rows given twice. Clashing names don't matter: only ``keys`` and ``text`` are read.
    """
    rows = items.select(*keys, "text").withColumn("_row", F.monotonically_increasing_id())
    counts = materialize(piece_counts(rows, path, vocabulary), "p4-pieces")
    head = most_frequent(counts, "n", max_head).select("piece", "tokens").toPandas()
    shared = rows.sparkSession.sparkContext.broadcast(dict(zip(head.piece, (int(n) for n in head.tokens))))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        pattern, known = regex.compile(PATTERN), shared.value
        memo: dict[str, tuple[int, tuple[str, ...]]] = {}
        for pdf in batches:
            totals, rare = [], []
            for text in pdf.text:
                total, tail = 0, None
                for chunk in chunks(text) if text else ():
                    found = memo.get(chunk)
                    if found is None:
                        if len(memo) > 400_000:
                            memo.clear()
                        pieces = pattern.findall(chunk)
                        found = memo[chunk] = (sum(known.get(p, 0) for p in pieces), tuple(p for p in pieces if p not in known))
                    total += found[0]
                    if found[1]:
                        tail = tail or Counter()
                        tail.update(found[1])
                totals.append(total)
                rare.append([{"piece": p, "m": m} for p, m in tail.items()] if tail else None)
            out = pdf.drop(columns=["text"])
            out["tokens"], out["rare"] = totals, rare
            yield out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", _row bigint, tokens bigint, rare array<struct<piece: string, m: bigint>>"
    found = materialize(rows.select(*keys, "_row", "text").mapInPandas(skip_empty(run), schema), "p4-items")
    whole = found.where("rare IS NULL").select(*keys, "tokens")
    tail = found.where("rare IS NOT NULL").select(*keys, "_row", "tokens", F.explode("rare").alias("r")).select(*keys, "_row", "tokens", "r.piece", "r.m")
    rest = tail.join(counts.select("piece", F.col("tokens").alias("each")), "piece").groupBy(*keys, "_row").agg((F.first("tokens") + F.sum(F.col("m") * F.col("each"))).alias("tokens"))
    return whole.unionByName(rest.select(*keys, "tokens"))


def language(label: Column) -> Column:
    """en for en, EN, en-GB and eng; null for null or blank."""
    base = F.lower(F.trim(F.regexp_extract(label, r"^\s*([A-Za-z]+)", 1)))
    #: ISO 639 codes of three letters that stand for a code of two.
    three = F.create_map(*[F.lit(x) for pair in (("eng", "en"), ("fra", "fr"), ("fre", "fr"), ("deu", "de"), ("ger", "de"), ("spa", "es"), ("ita", "it"), ("por", "pt"), ("nld", "nl"), ("dut", "nl")) for x in pair])
    return F.nullif(F.coalesce(three[base], base), F.lit(""))


KEYS = ["corpus", "item_id", "source", "lang", "domain"]


def corpus_items(spark: SparkSession, root: str) -> DataFrame:
    """Pages (source: doc_title) and documents as items; pages with the id of their document, which holds their lang and domain."""
    nothing = F.lit(None).cast("string")
    pages = table(spark, root, "pages").select(F.lit("pages").alias("corpus"), F.col("page_id").alias("item_id"), F.col("doc_title").alias("source"), nothing.alias("lang"), nothing.alias("domain"), "document_id", "text")
    documents = table(spark, root, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("item_id"), "source", language(F.col("lang")).alias("lang"), "domain", nothing.alias("document_id"), "text")
    return pages.unionByName(documents)


def p4_items(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of every page and document. Texts are counted where they lie; only the counts are joined with lang and domain."""
    outputs = table(spark, root, "doc_outputs").groupBy("document_id").agg(F.max("metadata").alias("metadata"))
    meta = outputs.select("document_id", language(F.get_json_object("metadata", "$.lang")).alias("_lang"), F.get_json_object("metadata", "$.domain").alias("_domain"))
    counted = token_items(corpus_items(spark, root), [*KEYS, "document_id"])
    both = counted.join(meta, "document_id", "left")
    return both.select("corpus", "item_id", "source", F.coalesce("lang", "_lang").alias("lang"), F.coalesce("domain", "_domain").alias("domain"), "tokens")


def p4_totals(spark: SparkSession, root: str) -> DataFrame:
    """Items and tokens by source, by language, by domain, and by all three; the others are null, as missing values are."""
    return totals(p4_items(spark, root))


def totals(items: DataFrame) -> DataFrame:
    by = [F.col(c) for c in ("source", "lang", "domain")]
    grouped = items.groupBy("corpus", *by).agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    level = F.when(F.expr("s = 0 AND l = 0 AND d = 0"), "all").when(F.expr("s = 0"), "source").when(F.expr("l = 0"), "lang").when(F.expr("d = 0"), "domain").otherwise("corpus")
    grouped = grouped.groupingSets([["corpus", "source", "lang", "domain"], ["corpus", "source"], ["corpus", "lang"], ["corpus", "domain"], ["corpus"]], "corpus", "source", "lang", "domain")
    out = grouped.agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.grouping("source").alias("s"), F.grouping("lang").alias("l"), F.grouping("domain").alias("d"))
    return out.select("corpus", level.alias("level"), "source", "lang", "domain", "items", "tokens")


QUERIES = {"p4_items": p4_items, "p4_totals": p4_totals}
