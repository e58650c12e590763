"""Token counts: pieces once per distinct pre-token, summed over per-document pre-token frequencies.

Byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens have together. The
distinct pre-tokens of the corpus are counted and tokenised once each. The ``TOP`` commonest ones, a table of bounded
size, are joined to a document's frequencies where the document is; the frequencies of all others go through an
equality join. No token ids are made for documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import cut, slices, table, texts

TOKENIZER = "byte_bpe_50k.json"
#: Pre-tokens in the broadcast table, and their longest length: at most 262,144 x 32 characters.
TOP, TOP_CHARS = 262_144, 32
LIMIT = 512

# fixed values: the tokenizer's split pattern and the one special string it recognises in texts
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

split_parts = regex.compile(PATTERN).findall


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pretokens(text: str) -> list[str]:
    """Pre-tokens in order; a special string is one pre-token of its own."""
    if SPECIAL not in text:
        return split_parts(text)
    out: list[str] = []
    for i, part in enumerate(text.split(SPECIAL)):
        out += ([SPECIAL] if i else []) + split_parts(part)
    return out


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for pdf in slices(batches, "text"):
        for text in pdf["text"]:
            seen.update(pretokens(text))
        if len(seen) > 400_000:
            yield pd.DataFrame({"pretoken": list(seen), "n": list(seen.values())})
            seen = Counter()
    if seen:
        yield pd.DataFrame({"pretoken": list(seen), "n": list(seen.values())})


def pretoken_pieces(docs: DataFrame, path: str) -> DataFrame:
    """``pretoken, n, pieces``: occurrences in the corpus and tokens of every distinct pre-token, each tokenised once."""
    counted = docs.select("text").mapInPandas(_vocabulary, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_batch
        for pdf in batches:
            yield pdf.assign(pieces=[len(e) for e in encode(list(pdf["pretoken"]), add_special_tokens=False)])

    return counted.mapInPandas(pieces, "pretoken string, n long, pieces long")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, top: int = TOP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (``doc_id``, ``text``).

    Null texts count as empty (no bytes, no tokens). Rows are told apart by a number of their own, so repeated and
    null ``doc_id`` keep one result each; other columns are ignored and an empty table gives an empty result.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    rows = texts(docs)
    vocabulary = cut(pretoken_pieces(rows, path))
    # the levels of frequency, an eighth of a power of two each, that have no more than ``top`` pre-tokens together
    short = vocabulary.filter(F.length("pretoken") <= TOP_CHARS).withColumn("level", F.floor(8 * F.log2("n")))
    least, total = 1 << 30, 0
    for level, size in sorted(((r[0], r[1]) for r in short.groupBy("level").count().collect()), reverse=True):
        total += size
        if total > top:
            break
        least = level
    common = short.filter(F.col("level") >= least).select("pretoken", "pieces").toArrow()
    near = docs.sparkSession.sparkContext.broadcast(dict(zip(common["pretoken"].to_pylist(), common["pieces"].to_pylist(), strict=True)))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = near.value
        for pdf in slices(batches, "text"):
            size, total, left = [], [], []
            for text in pdf["text"]:
                freq = Counter(pretokens(text))
                total.append(sum(n * known[t] for t, n in freq.items() if t in known))
                left.append([{"pretoken": t, "k": n} for t, n in freq.items() if t not in known])
                size.append(len(text.encode()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": size, "known": total, "rest": left})

    freq = rows.mapInPandas(frequencies, "doc_id long, n_bytes long, known long, rest array<struct<pretoken:string,k:long>>")
    freq = cut(freq.withColumn("_row", F.monotonically_increasing_id()))
    rare = (
        freq.select("_row", F.explode("rest").alias("r")).select("_row", "r.pretoken", "r.k")
        .join(vocabulary.select("pretoken", "pieces"), "pretoken")
        .groupBy("_row").agg(F.sum(F.col("k") * F.col("pieces")).alias("rare"))
    )
    n = F.col("known") + F.coalesce("rare", F.lit(0))
    return freq.drop("rest").join(rare, "_row", "left").select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
