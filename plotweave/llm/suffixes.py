"""Suffix-array deduplication of byte passages: merging the Burrows-Wheeler transforms of shards.

``routing`` brings all pieces that can share a passage into one group. A task takes its pieces as bounded chunks, sorts
the suffixes of each chunk once, and merges the chunks' transforms pairwise by refining an interleave: after t rounds
every suffix of one side knows between which suffixes of the other side it belongs by its first t symbols, because the
place of ``c + rest`` follows from the place of ``rest`` among the suffixes that begin with c. Suffixes without
a partner are settled and drop out. No suffix is sorted again; the round in which a suffix loses its last partner
is its longest common prefix, and what keeps one for ``depth`` rounds belongs to a repeated interval.

A symbol stands for ``stride`` bytes, and a suffix is read in steps of ``stride``, so ``depth`` symbols are a passage
of ``stride * depth`` bytes at any byte offset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import table
from plotweave.llm.routing import Bytes, Route, byte_grams, covered, mask, resolve, with_ranges

LENGTH, GRAM = 400, 64
SHARD_BYTES, CHUNK_BYTES = 1_000_000, 300_000


def stride_of(length: int, most: int = 40) -> int:
    return max(g for g in range(1, most + 1) if length % g == 0)


class Transform:
    """Sorted suffixes of a chunk. ``symbol``: first symbol; ``after``: row of the suffix one symbol further, -1 at the
    end of a piece; ``interval``: one number for all rows that share ``depth`` symbols; ``where``: number of the
    suffix's place. Rows with one first symbol are in the order of their ``after``, as in every such transform."""

    __slots__ = ("symbol", "after", "interval", "where")

    def __init__(self, symbol, after, interval, where):
        self.symbol, self.after, self.interval, self.where = symbol, after, interval, where

    @classmethod
    def of(cls, symbol: np.ndarray, following: np.ndarray, where: np.ndarray, depth: int) -> Transform:
        """``following``: place of the next symbol's suffix, -1 for none. Sorts by doubling the compared length."""
        rank = np.unique(symbol, return_inverse=True)[1] + 1
        jump, width, classes, rest = following, 1, None, depth
        at = np.arange(len(symbol))  # where the symbols not yet compared for ``classes`` begin

        def joined(a: np.ndarray, b: np.ndarray, to: np.ndarray) -> np.ndarray:
            tail = np.where(to >= 0, b[to], 0)
            return np.unique(a * (int(b.max(initial=0)) + 1) + tail, return_inverse=True)[1] + 1

        while True:
            if rest & width:
                classes = rank if classes is None else joined(classes, rank, at)
                at = np.where(at >= 0, jump[at], -1)
                rest -= width
            if not rest and (jump < 0).all():
                break
            rank = joined(rank, rank, jump)
            jump, width = np.where(jump >= 0, jump[jump], -1), 2 * width
        order = np.argsort(rank, kind="stable")
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        return cls(symbol[order], np.where(following[order] >= 0, row[following[order]], -1), classes[order], where[order])


def merge(a: Transform, b: Transform, depth: int, rounds: int) -> Transform:
    """The transform of both chunks. No suffix has more than ``rounds`` symbols; what is still equal then ends alike."""
    n = len(b.symbol)
    start = np.flatnonzero(np.concatenate([[True], b.symbol[1:] != b.symbol[:-1]]))
    block = np.searchsorted(b.symbol[start], a.symbol)  # among b's first symbols
    known = (block < len(start)) & (b.symbol[start][np.minimum(block, len(start) - 1)] == a.symbol)
    b_block = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
    key = b_block * (n + 2) + b.after + 1  # ascends with b's rows
    lo, hi = np.zeros(len(a.symbol), np.int64), np.full(len(a.symbol), n)
    live, interval = np.arange(len(a.symbol)), a.interval + int(b.interval.max(initial=0)) + 1
    for t in range(1, max(depth, rounds) + 2):
        nxt, base = a.after[live], block[live] * (n + 2)
        ended = nxt < 0
        left = np.where(ended, 0, lo[nxt] + 1)
        right = np.where(ended, 1, hi[nxt] + 1)
        if t == 1:
            left, right = np.zeros_like(left), np.full_like(right, n + 2)
        new_lo, new_hi = np.searchsorted(key, base + left), np.searchsorted(key, base + right)
        new_hi = np.where(known[live], new_hi, new_lo)
        lo[live], hi[live] = new_lo, new_hi
        if t == depth:
            shared = new_hi > new_lo
            interval[live[shared]] = b.interval[new_lo[shared]]
        # an ended suffix can't be told further apart
        live = live[(new_hi > new_lo) & ~(ended & (t > 1))]
        if not len(live):
            break
    a_row = np.arange(len(a.symbol)) + lo
    taken = np.zeros(len(a.symbol) + n, bool)
    taken[a_row] = True
    b_row = np.flatnonzero(~taken)
    out = [np.empty(len(taken), x.dtype) for x in (a.symbol, a.after, interval, a.where)]
    for target, x, y in zip(out, (a.symbol, np.where(a.after >= 0, a_row[a.after], -1), interval, a.where),
                            (b.symbol, np.where(b.after >= 0, b_row[b.after], -1), b.interval, b.where), strict=True):
        target[a_row], target[b_row] = x, y
    return Transform(*out)


def repeats(contents: list[bytes], weight: np.ndarray, length: int, chunk: int = CHUNK_BYTES) -> np.ndarray:
    """Which places of the joined contents begin a passage of ``length`` bytes that is at two places or more."""
    stride = stride_of(length)
    depth = length // stride
    rounds = max(map(len, contents), default=0) // stride + 1
    size = np.array([len(c) for c in contents])
    base = np.cumsum(size) - size
    parts, at = [], 0
    while at < len(contents):
        to = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), chunk, side="right")))
        own = size[at:to]
        raw = np.frombuffer(b"".join(contents[at:to]), np.uint8)
        left = np.repeat(np.cumsum(own), own) - np.arange(len(raw))  # bytes up to the end of the piece
        place = np.flatnonzero(left >= stride)
        number = np.full(len(raw), -1, np.int64)
        number[place] = np.arange(len(place))
        more = left[place] >= 2 * stride
        following = np.where(more, number[np.minimum(place + stride, len(raw) - 1)], -1)
        if len(place):
            parts.append(Transform.of(byte_grams(raw, stride)[place], following, place + base[at], depth))
        at = to
    while len(parts) > 1:
        parts = [merge(parts[i], parts[i + 1], depth, rounds) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    found = np.zeros(int(size.sum()), bool)
    if parts:
        whole = parts[0]
        owner = np.searchsorted(base, whole.where, side="right") - 1
        long = base[owner] + size[owner] - whole.where >= length
        count = np.bincount(whole.interval[long], weights=weight[owner[long]], minlength=int(whole.interval.max()) + 1)
        found[whole.where] = long & (count[whole.interval] >= 2)
    return found


def matches(pdf: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    contents = [bytes(c) for c in pdf["content"]]
    hit = repeats(contents, pdf["k"].to_numpy(), length)
    size = np.array([len(c) for c in contents])
    base = np.cumsum(size) - size
    # pieces are longer than their windows are many, so runs never touch
    at = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    first, end = at[::2], at[1::2]
    who = np.searchsorted(base, first, side="right") - 1
    columns = {c: pdf[c].to_numpy()[who] for c in ("h", "seg", "lo")}
    return pd.DataFrame({"h": columns["h"], "seg": columns["seg"], "first": first - base[who], "end": end - base[who], "lo": columns["lo"]})


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 256) -> DataFrame:
    """``d, r, ranges``: byte ranges of each document covered by passages of ``length`` bytes that also start elsewhere."""
    route = Route(Bytes, length, min(gram, length), hot, blocks=(max(1, length // 12), 1))
    found, spans = resolve(docs, route, F.col("k") > 1, F.col("k") > 1, lambda pdf: matches(pdf, length), SHARD_BYTES, ordered=False)
    return covered(found, spans, route, only_earlier=False)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 256) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs`` (``doc_id``, ``text``).

    ``kept`` holds the remaining bytes (a removed passage may begin or end inside a character). All occurrences of
    a repeated passage are removed. Null texts are empty. Repeated rows are other places of their text, so
    they remove each other; ids may be null. Other columns are ignored; an empty table gives an empty result.
    """

    def apply(doc, text, ranges):
        raw = text.encode()
        gone = mask(len(raw), ranges)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        return doc, len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()

    return with_ranges(docs, repeated_bytes(docs, length, gram, hot), apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
