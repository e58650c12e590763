"""Importance resampling towards a target distribution, with hashed one- and two-word features.

A feature's bucket is its CRC-32 modulo ``BUCKETS``. A batch of texts becomes one buffer of single-spaced words in which
every feature is a slice. Distinct features are grouped by their length in bytes; a group is a two-dimensional uint8
array (one row a feature), whose CRCs are updated together, column by column, and the buckets are scattered back to the
places of the features. Tasks return one histogram each, so all that is gathered is a table of ``BUCKETS`` gains.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.llm.common import cut, slices, table, texts

BUCKETS, SHARE, LEAST, SEED = 10_000, 25, 20, 7
#: Longest feature in a matrix. The few longer ones are single rows; they take the CRC of the standard library.
WIDEST = 512
#: Rows of a matrix that are updated at once.
ROWS = 1 << 15


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (t & np.uint32(1)))
    return t


CRC = _crc_table()
# letters and digits stay, A-Z become small, every other ASCII character ends a word
WORD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def crcs(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``buffer`` (uint8), by matrices of equal length."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        if size > WIDEST:
            for row in order[a:b]:
                out[row] = zlib.crc32(buffer[start[row]:start[row] + size].tobytes())
            continue
        windows = np.lib.stride_tricks.sliding_window_view(buffer, size)
        for at in range(a, b, ROWS):
            rows = order[at:min(b, at + ROWS)]
            matrix = windows[start[rows]]
            crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
            for column in range(size):
                crc = CRC[(crc ^ matrix[:, column]) & np.uint32(255)] ^ (crc >> np.uint32(8))
            out[rows] = ~crc
    return out


def features(found: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the UTF-8 texts of a batch: words of each, and (text, bucket) of all their features."""
    words: list[bytes] = []
    n = np.zeros(len(found), np.int64)
    for i, text in enumerate(found):
        own = text.translate(WORD).split()
        n[i] = len(own)
        words += own
    if not words:
        return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - length - 1
    text = np.repeat(np.arange(len(found)), n)
    buffer = np.frombuffer(b" ".join(words), np.uint8)
    pair = np.flatnonzero(text[1:] == text[:-1])
    one, first = np.unique(ids, return_index=True)
    code, distinct = pd.factorize(ids[pair] * len(one) + ids[pair + 1])
    at = np.zeros(len(distinct), np.int64)
    at[code[::-1]] = pair[::-1]  # a place of each distinct pair
    starts = np.concatenate([start[first], start[at]])
    lengths = np.concatenate([length[first], start[at + 1] + length[at + 1] - start[at]]) if len(at) else length[first]
    bucket = (crcs(buffer, starts, lengths) % buckets).astype(np.int64)
    return n, np.concatenate([text, text[pair]]), np.concatenate([bucket[ids], bucket[len(one) + code]])


def histogram(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of all features of ``docs`` (column ``text``); every task adds up its own first."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in slices(batches, "text"):
            total += np.bincount(features([t.encode() for t in pdf["text"]], buckets)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(counted, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares; ``buckets`` rows of each side reach the driver."""
    sides = []
    for side in (docs, target):
        count = np.zeros(buckets, np.int64)
        for r in histogram(side, buckets).collect():
            count[r.bucket] = r.n
        sides.append(count)
    s, t = sides
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    each = [math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    return np.array(each, np.int64)


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs``."""
    gain = gains(docs, target, buckets)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "text"):
            n, text, bucket = features([t.encode() for t in pdf["text"]], buckets)
            total = np.bincount(text, weights=gain[bucket], minlength=len(n)).astype(np.int64)
            many = np.bincount(text, minlength=len(n))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": n, "n_features": many, "weight": total // np.maximum(many, 1)})

    rows = texts(docs).mapInPandas(weighed, "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: one row per row of ``docs`` (``doc_id``, ``text``).

    The ``share`` percent (rounded down) of the texts with ``least`` words or more that have the highest scores are
    drawn and ranked from 1; ties go to the smaller id, null ids last. Null and wordless texts have no features and weight 0, repeated
    rows are drawn one by one, an empty ``docs`` gives an empty result and an empty ``target`` a uniform one. Texts
    are taken whole; other columns are ignored. A null id is hashed as an empty one.

    Scores are whole numbers over a range set by logarithms, so ranks come from the counts of the scores and from an
    order inside each score; only rows at or above the score of the last one drawn are sorted.
    """
    rows = cut(scored(docs, target, buckets, seed))
    fit = rows.filter(F.col("n_words") >= least)
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = fit.groupBy("score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(down), F.lit(0)))
    quota = share * fit.count() // 100
    levels = levels.filter(F.col("_before") < quota).select("score", "_before")
    last = levels.agg(F.min("score")).first()[0]
    inside = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"))
    own = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select(*own, none)
    above = (F.col("n_words") >= least) & (F.col("score") >= last)
    ranked = rows.filter(above).withColumn("_in", F.row_number().over(inside)).join(levels, "score")
    rank = (F.col("_before") + F.col("_in")).cast("long")
    ranked = ranked.select(*own, F.when(rank <= quota, rank).alias("rank"))
    return ranked.union(rows.filter(~above).select(*own, none))


def drawn_documents(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id ``resample`` draws at least once."""
    ids = resample(docs, target, share, least).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
