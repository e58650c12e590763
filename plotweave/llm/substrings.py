"""Substring deduplication of word passages: FM-indexes over shards, searched backwards through wavelet trees.

``routing`` brings all pieces that can share a window into one shard. A shard's index holds its words' Burrows-Wheeler
transform as a wavelet tree of packed bits with counts per 64 of them, nothing else of the text. The pieces stream
against it: for each of their places the matching statistic is the length (up to the threshold) of the longest passage
ending there that another piece has too, found by one backward step per word while at least two suffixes match.
Intervals at the threshold are reported with the smallest document among their suffixes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import table
from plotweave.llm.routing import Route, Words, covered, mask, resolve, with_ranges

WINDOW, GRAM = 13, 5
SHARD_WORDS = 200_000


class WaveletTree:
    """Rank over a sequence of small numbers, one packed bit row per binary digit."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(64 - len(bit) % 64, bit.dtype)).astype(np.uint8), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1])
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` values."""
        start = np.zeros_like(at)
        for i in range(self.levels):
            one = (symbol >> (self.levels - 1 - i)) & 1 == 1
            a, b = self._ones(i, start), self._ones(i, at)
            start = np.where(one, self.zeros[i] + a, start - a)
            at = np.where(one, self.zeros[i] + b, at - b)
        return at - start


class FMIndex:
    """Index of symbol rows (numbers from 1), each followed by a 0. Serves patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        n, rank, width = len(text), text.astype(np.int64), 1
        while width < depth:
            nxt = np.concatenate([rank[width:], np.zeros(min(width, n), np.int64)])
            rank = np.unique(rank * (rank.max(initial=0) + 1) + nxt, return_inverse=True)[1]
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.tree = WaveletTree(text[self.suffixes - 1])
        self.n = n

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after one more symbol in front."""
        return self.counts[symbol] + self.tree.rank(symbol, lo), self.counts[symbol] + self.tree.rank(symbol, hi)

    def statistics(self, text: np.ndarray, ends: np.ndarray, depth: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For patterns ending before each of ``ends``: matched length up to ``depth``, and interval of those that reach it."""
        length = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        live = np.arange(len(ends))
        for k in range(1, depth + 1):
            a, b = self.step(text[ends[live] - k], lo[live], hi[live])
            many = b - a >= least
            live, a, b = live[many], a[many], b[many]
            lo[live], hi[live], length[live] = a, b, k
        return length, lo, hi


def matches(pdf: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """Windows of the pieces that another piece has, with the smallest document of all pieces that have them."""
    names: dict[bytes, int] = {}
    rows = [[names.setdefault(w, len(names) + 1) for w in c.split(b" ")] for c in pdf["content"]]
    size = np.array([len(r) + 1 for r in rows])
    text = np.array([x for r in rows for x in (*r, 0)], np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    index = FMIndex(text, window)
    ends = np.flatnonzero(place >= window)  # a window ends before each of these
    length, lo, hi = index.statistics(text, ends, window)
    # windows that no other piece has count if their piece itself is at several places
    docs = pdf["lo"].to_numpy()
    least = docs[owner[ends]]
    hit = length >= window
    if hit.any():
        # intervals of one length are equal or apart
        start, inverse = np.unique(lo[hit], return_inverse=True)
        stop = np.zeros(len(start), np.int64)
        stop[inverse] = hi[hit]
        suffix_docs = docs[np.minimum(owner[index.suffixes], len(docs) - 1)]
        edges = np.stack([start, stop], axis=1).ravel()
        least[hit] = np.minimum.reduceat(np.append(suffix_docs, suffix_docs[-1]), edges)[::2][inverse]
    told = hit | (pdf["k"].to_numpy()[owner[ends]] > 1)
    ends, least = ends[told], least[told]
    if not len(ends):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("h", "seg", "first", "end", "lo")})
    first, who = place[ends] - window, owner[ends]
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (first[1:] != first[:-1] + 1) | (least[1:] != least[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(first)) - 1
    return pd.DataFrame({"h": pdf["h"].to_numpy()[who[at]], "seg": pdf["seg"].to_numpy()[who[at]], "first": first[at], "end": first[last] + 1, "lo": least[at]})


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = 256) -> DataFrame:
    """``d, r, ranges``: word ranges of each document covered by windows that start in a document with a smaller id."""
    route = Route(Words, window, min(gram, window), hot)
    found, spans = resolve(docs, route, F.col("lo") < F.col("hi"), F.lit(True), lambda pdf: matches(pdf, window), SHARD_WORDS, ordered=True)
    return covered(found, spans, route, only_earlier=True)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = 256) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row of ``docs`` (``doc_id``, ``text``).

    Words are runs without ASCII white space, kept words are joined by one space. Null texts have no words; a null
    ``doc_id`` counts as the smallest. Rows with equal ids are one document: none precedes another. Other columns are
    ignored; an empty table gives an empty result.
    """

    def apply(doc, text, ranges):
        parts = text.encode().split()
        gone = mask(len(parts), ranges)
        kept = b" ".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g)
        return doc, len(parts), int(gone.sum()), kept.decode()

    return with_ranges(docs, repeated_words(docs, window, gram, hot), apply, "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
