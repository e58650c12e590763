"""Routing of repeated passages: brings equal windows of different documents into one shard, in linear work.

Every window of ``length`` units (words or bytes) has an anchor: its gram of ``gram`` units with the smallest hash, the
leftmost if several. Consecutive windows with one anchor form a piece. Equal windows have equal anchors at equal
places, so pieces grouped by anchor hold all copies of their windows. Anchors seen once are left out first: a
bit table of the repeated anchors (at most ``MAX_BITS``; fuller tables only let more pieces through) is sent to the tasks.
Equal pieces are then merged before they are moved, with their number and smallest document.

A group with more than ``hot`` different pieces is cut further: into blocks of windows keyed by the units that all
windows of a block share, and at last into single windows. Only equal windows share such a key, so each step is exact
and each window stays in exactly one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import cut, slices

MAX_BITS = 1 << 27
LOWEST = -(2**63)
# fixed values: odd multipliers of the gram hashes
C1, C2, C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
PLACES = "d long, r long, start int, h long, seg long, units int"
PIECES = "d long, h long, seg long, k long, anchor int, units int, content binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * C3
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of a text (runs without ASCII white space) as units."""

    def __init__(self, text: str):
        self.parts = text.encode().split()
        self.n = len(self.parts)

    def grams(self, m: int) -> np.ndarray:
        # 32 bits a word are enough: equal hashes of different grams only bring more pieces together
        h = np.fromiter(map(crc32, self.parts), np.uint64, self.n)
        out = h[:self.n - m + 1].copy()
        for k in range(1, m):
            out = out * C1 + h[k:self.n - m + 1 + k]
        return mixed(out)

    def content(self, a: int, b: int) -> bytes:
        return b" ".join(self.parts[a:b])

    @staticmethod
    def cut(content: bytes) -> Words:
        own = Words.__new__(Words)
        own.parts = content.split(b" ")
        own.n = len(own.parts)
        return own


class Bytes:
    """UTF-8 bytes of a text as units."""

    def __init__(self, text: str):
        self.raw = text.encode()
        self.n = len(self.raw)

    def grams(self, m: int) -> np.ndarray:
        return mixed(byte_grams(np.frombuffer(self.raw, np.uint8), m))

    def content(self, a: int, b: int) -> bytes:
        return self.raw[a:b]

    @staticmethod
    def cut(content: bytes) -> Bytes:
        own = Bytes.__new__(Bytes)
        own.raw, own.n = content, len(content)
        return own


def byte_grams(a: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit value of the ``m`` bytes from each place on: polynomials of doubled length, put together."""
    power, width, have = np.array([C1]), 1, a.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if m & width:
            n = len(a) - done - width + 1
            out = have[:len(a) - width + 1] if out is None else out[:n] * power + have[done:done + n]
            done += width
        if done == m:
            return mixed(out[:len(a) - m + 1])
        have = have[:len(have) - width] * power + have[width:]
        power, width = power * power, 2 * width


def runs(grams: np.ndarray, windows: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window and place of the anchor of each piece, and one more first window at the end. ``span`` grams per window."""
    places = []
    step = (1 << 23) - span
    for at in range(0, windows, step):
        part = grams[at:min(at + step, windows) + span - 1]
        key = (part & ~np.uint64((1 << 23) - 1)) | np.arange(len(part), dtype=np.uint64)
        w = 1
        while 2 * w <= span:
            key, w = np.minimum(key[:-w], key[w:]), 2 * w
        if w < span:
            key = np.minimum(key[:len(key) - (span - w)], key[span - w:])
        places.append((key & np.uint64((1 << 23) - 1)).astype(np.int64) + at)
    place = np.concatenate(places)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return first, place[first], np.append(first, windows)


@dataclass(frozen=True)
class Route:
    """What is compared: windows of ``length`` units with anchors of ``gram`` units."""

    units: type
    length: int
    gram: int
    hot: int = 256
    blocks: tuple[int, ...] = (1,)

    def anchors(self, text: str):
        doc = self.units(text)
        windows = doc.n - self.length + 1
        if windows < 1:
            return doc, None
        grams = doc.grams(self.gram)
        first, place, ends = runs(grams, windows, self.length - self.gram + 1)
        return doc, (grams[place], first, place, ends[1:])


def numbered(docs: DataFrame) -> DataFrame:
    """``d`` (``doc_id``, the lowest number for null), ``r`` (hash of the text) and ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("d"), F.xxhash64(text).alias("r"), text.alias("text"))


def repeated_anchors(rows: DataFrame, route: Route, repeated: Column) -> DataFrame:
    """Anchors ``h`` for which ``repeated`` holds over ``lo``, ``hi`` (documents) and ``k`` (places)."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "text"):
            hs, ds = [], []
            for d, text in zip(pdf["d"], pdf["text"], strict=True):
                _, got = route.anchors(text)
                if got:
                    hs.append(got[0])
                    ds.append(np.full(len(got[0]), d))
            if hs:
                h, d = np.concatenate(hs).view(np.int64), np.concatenate(ds)
                order = np.argsort(h, kind="stable")
                h, d = h[order], d[order]
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                yield pd.DataFrame({"h": h[at], "lo": np.minimum.reduceat(d, at), "hi": np.maximum.reduceat(d, at), "k": np.diff(np.append(at, len(h)))})

    seen = rows.select("d", "text").mapInPandas(found, "h long, lo long, hi long, k long")
    return seen.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("k").alias("k")).filter(repeated).select("h")


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of the hashed keys, 16 for each of them but at most ``MAX_BITS``; collected as packed words."""
    n = keys.count()
    bits = 1 << 16
    while bits < min(16 * n, MAX_BITS):
        bits *= 2
    slot = F.pmod(F.col(column), F.lit(bits))
    words = keys.select(F.shiftright(slot, 5).alias("w"), F.expr(f"shiftleft(1L, CAST(pmod({column}, 32) AS INT))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return table


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the (uint64) keys may be in the table. Its size divides 2^64, so signs don't matter."""
    slot = h & np.uint64(32 * len(table) - 1)
    return (table[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def places(rows: DataFrame, route: Route, anchors: DataFrame) -> DataFrame:
    """Pieces of the windows with repeated anchors: where they are, their group ``h`` and the hash ``seg`` of their content."""
    table = rows.sparkSession.sparkContext.broadcast(bit_table(anchors, "h"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "text"):
            out = []
            for d, r, text in zip(pdf["d"], pdf["r"], pdf["text"], strict=True):
                for h, a, _, units, content in _kept(route, text, table.value):
                    out.append((d, r, a, h, xxhash.xxh3_64_intdigest(content) - 2**63, units))
            yield pd.DataFrame(out, columns=["d", "r", "start", "h", "seg", "units"])

    return rows.mapInPandas(found, PLACES)


def pieces(rows: DataFrame, route: Route, groups: DataFrame) -> DataFrame:
    """Content of the pieces in ``groups`` (``h``), equal ones merged within a task's slice of the texts."""
    table = rows.sparkSession.sparkContext.broadcast(bit_table(groups, "h"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "text"):
            seen: dict[tuple[int, bytes], list] = {}
            for d, text in zip(pdf["d"], pdf["text"], strict=True):
                for h, _, anchor, units, content in _kept(route, text, table.value):
                    own = seen.setdefault((h, content), [d, 0, anchor, units])
                    own[0], own[1] = min(own[0], d), own[1] + 1
            out = [(d, h, xxhash.xxh3_64_intdigest(c) - 2**63, k, anchor, units, c) for (h, c), (d, k, anchor, units) in seen.items()]
            yield pd.DataFrame(out, columns=["d", "h", "seg", "k", "anchor", "units", "content"])

    return rows.select("d", "text").mapInPandas(found, PIECES)


def _kept(route: Route, text: str, table: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(anchor, first unit, anchor's place, units, content) of the pieces whose anchor passes the table."""
    doc, got = route.anchors(text)
    if not got:
        return
    h, first, place, end = got
    at = np.flatnonzero(passes(table, h))
    for key, a, p, b in zip(h[at].view(np.int64).tolist(), first[at].tolist(), place[at].tolist(), (end[at] + route.length - 1).tolist(), strict=True):
        yield key, a, p - a, b - a, doc.content(a, b)


def merged(found: DataFrame, lo: str, k: Column) -> DataFrame:
    """Different pieces of each group, with smallest document ``lo`` and number of places ``k``."""
    return found.groupBy("h", "seg").agg(
        F.min(lo).alias("lo"), F.sum(k).alias("k"), F.first("anchor").alias("anchor"), F.first("units").alias("units"), F.first("content").alias("content")
    )


def split(unique: DataFrame, route: Route, block: int) -> DataFrame:
    """Pieces of hot groups as blocks of ``block`` windows at fixed distances from the anchor, with their parents."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, seg, lo, k, anchor, content in zip(*(pdf[c] for c in ("h", "seg", "lo", "k", "anchor", "content")), strict=True):
                doc = route.units.cut(content)
                windows = doc.n - route.length + 1
                a = 0
                while a < windows:
                    base = (a - anchor) // block * block + anchor
                    b = min(base + block, windows)
                    # all windows of a whole block cover these units
                    core = doc.content(base + block - 1, base + route.length)
                    key = xxhash.xxh3_64_intdigest(core, (h ^ (base - anchor)) & (2**64 - 1)) - 2**63
                    own = doc.content(a, b + route.length - 1)
                    out.append((key, xxhash.xxh3_64_intdigest(own) - 2**63, lo, k, anchor - a, b - a + route.length - 1, own, h, seg, a))
                    a = b
            yield pd.DataFrame(out, columns=["h", "seg", "lo", "k", "anchor", "units", "content", "parent_h", "parent_seg", "at"])

    return unique.select("h", "seg", "lo", "k", "anchor", "content").mapInPandas(
        cut_up, "h long, seg long, lo long, k long, anchor int, units int, content binary, parent_h long, parent_seg long, at int"
    )


def joined_runs(spans: Column) -> Column:
    """Spans that touch and have one smallest document as one."""

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        touch = (F.size(done) > 0) & (last["lo"] == s["lo"]) & (s["first"] <= last["end"])
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"), s["lo"].alias("lo"))
        return F.when(touch, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<first:int,end:int,lo:bigint>>"), step)


def resolve(docs: DataFrame, route: Route, repeated: Column, alone: Column, index: Callable[[pd.DataFrame], pd.DataFrame], shard_units: int, ordered: bool) -> tuple[DataFrame, DataFrame]:
    """Places of all pieces that may be repeated (see ``places``), and ``h, seg, spans`` of those with a repeated window;
    spans are (first, last + 1, lo) of windows.

    A group that holds one piece only needs no index: if ``alone`` holds over its ``lo`` and ``k``, all its windows are
    repeated. The others' contents are fetched. ``index`` gets the pieces of whole groups, about ``shard_units`` units of
    them, and returns ``h, seg, first, end, lo``. Unless ``ordered``, nobody asks for the smallest document: ``lo`` is 0.
    """
    rows = numbered(docs)
    least = F.col("lo") if ordered else F.lit(0).cast("long")
    found = cut(places(rows, route, cut(repeated_anchors(rows, route, repeated))))
    groups = cut(found.groupBy("h").agg(
        F.min("seg").alias("seg"), F.max("seg").alias("other"), F.min("d").alias("lo"), F.count(F.lit(1)).alias("k"), F.max("units").alias("units")
    ))
    whole = F.struct(F.lit(0).alias("first"), (F.col("units") - route.length + 1).cast("int").alias("end"), least.alias("lo"))
    single = groups.filter((F.col("seg") == F.col("other")) & alone).select("h", "seg", F.array(whole).alias("spans"))
    several = groups.filter("seg <> other").select("h")
    unique = cut(merged(pieces(rows, route, several), "d", F.col("k")).join(several, "h", "left_semi"))
    levels, parents = [[single]], []
    for block in (*route.blocks, None):
        # written first, so that the join can split a hot anchor's partition
        sizes = cut(unique.groupBy("h").agg(F.count(F.lit(1)).alias("nd")))
        sized = unique.join(sizes, "h")
        if parents:
            levels[-1].append(sized.filter((F.col("nd") == 1) & alone).select("h", "seg", F.array(whole).alias("spans")))
        few = (F.col("nd") > 1) & (F.col("nd") <= route.hot) if block else F.col("nd") > 1
        grouped = sized.filter(few).select("h", "seg", "lo", "k", "anchor", "content")
        shards = 16 + (unique.agg(F.sum("units")).first()[0] or 0) // shard_units
        spans = grouped.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInPandas(
            lambda pdf: index(pdf), "h long, seg long, first int, end int, lo long"
        )
        levels[-1].append(cut(spans.groupBy("h", "seg").agg(joined_runs(F.collect_list(F.struct("first", "end", least.alias("lo")))).alias("spans"))))
        hot = sized.filter(F.col("nd") > route.hot)
        if not block or hot.isEmpty():
            break
        parts = cut(split(hot, route, block))
        parents.append(parts.select("h", "seg", "parent_h", "parent_seg", "at"))
        unique = cut(merged(parts, "lo", F.col("k")))
        levels.append([])  # of this level's parts
    both = reduce(DataFrame.union, levels[-1])
    for own, links in zip(reversed(levels[:-1]), reversed(parents), strict=True):
        moved = F.transform("spans", lambda s: F.struct((s["first"] + F.col("at")).alias("first"), (s["end"] + F.col("at")).alias("end"), s["lo"].alias("lo")))
        up = links.join(both, ["h", "seg"]).select(F.col("parent_h").alias("h"), F.col("parent_seg").alias("seg"), F.explode(moved).alias("s"))
        both = reduce(DataFrame.union, [*own, up.groupBy("h", "seg").agg(joined_runs(F.collect_list("s")).alias("spans"))])
    return found, both


def covered(found: DataFrame, spans: DataFrame, route: Route, only_earlier: bool) -> DataFrame:
    """``d, r, ranges``: unit ranges (from, to) of each document under a repeated window."""
    kept = F.filter("spans", lambda s: s["lo"] < F.col("d")) if only_earlier else F.col("spans")
    ranges = F.transform(kept, lambda s: F.struct((F.col("start") + s["first"]).alias("a"), (F.col("start") + s["end"] + route.length - 1).alias("b")))
    return cut(
        found.select("d", "r", "start", "h", "seg").join(spans, ["h", "seg"])
        .select("d", "r", F.explode(ranges).alias("x")).groupBy("d", "r").agg(F.collect_list("x").alias("ranges"))
    )


def mask(n: int, ranges) -> np.ndarray:
    """Units under any of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    if ranges is not None and len(ranges):
        np.add.at(edge, [x["a"] for x in ranges], 1)
        np.add.at(edge, [x["b"] for x in ranges], -1)
    return np.cumsum(edge[:-1]) > 0


def with_ranges(docs: DataFrame, ranges: DataFrame, apply: Callable, schema: str) -> DataFrame:
    """``apply(doc_id, text, ranges)`` for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("d"), F.xxhash64(text).alias("r"))
    joined = rows.join(ranges, ["d", "r"], "left").select("doc_id", "text", "ranges")
    names = [c.split()[0] for c in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "text"):
            out = [apply(d, t, x) for d, t, x in zip(pdf["doc_id"], pdf["text"], pdf["ranges"], strict=True)]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return joined.mapInPandas(made, schema)
