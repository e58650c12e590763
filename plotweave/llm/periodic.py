"""Periodic runs: maximal stretches of words that repeat with a period, found tile by tile.

Periods are searched by octave. In the octave from ``2^k`` on, a run's words equal those one period ahead over at least
``2^k`` places (12 words less a period for the shortest), so some boundary, a place on a grid of that order, starts a
block of words that returns one period later. A document is cut into overlapping tiles of some ``2^k`` words per octave,
and only tiles with such a boundary go on, each as a row of its own that any task can solve: Z-functions to the right
and to the left of a boundary give, for all periods of the octave, how far the words agree. These fragments meet again by
document and period, where touching ones are stitched; a stretch that has several periods keeps the smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.llm.common import cut, slices, table, texts

LEAST = 12
#: Words of a tile's core, in units of ``2^k`` and at least.
CORE, CORE_LEAST = 8, 64

# fixed values: odd multipliers of the mixing function
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * MIX[1])) * MIX[0]
    x ^= x >> np.uint64(29)
    x *= MIX[1]
    return x ^ (x >> np.uint64(32))


def z_function(s: list[int]) -> list[int]:
    """For each place, how many numbers from there on equal the first ones."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def octave(k: int) -> tuple[int, int, int]:
    """(block, grid, margin): a run of the octave has a boundary on the grid whose block returns, and boundaries less
    than a margin apart."""
    if k <= 2:
        return 4, 2, 8
    half = 1 << (k - 1)
    return half, half, 2 * half


def boundaries(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries) of a document's words (numbers) wherever a block returns at a period of the octave."""
    n = len(ids)
    h, size, order = None, 0, None
    for k in range(max(0, n // 2).bit_length()):
        block, grid, _ = octave(k)
        if n < block:
            return
        if size != block:
            if h is None:
                two = _mixed(ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64))
                h, size = _mixed(two[:-2], two[2:]), 4
            while size < block:
                h, size = _mixed(h[:-size], h[size:]), 2 * size
            order = np.argsort(h, kind="stable")
            again = h[order][1:] == h[order][:-1]
            group = np.concatenate([[0], np.cumsum(~again)])
            both = np.zeros(len(order), bool)
            both[1:] |= again
            both[:-1] |= again
            order, group = order[both], group[both]
            places = group * n + order
        if not len(order):
            return  # longer blocks do not return either
        at = np.flatnonzero(order % grid == 0)
        near = np.searchsorted(places, places[at] + (1 << k))
        last = group[at] * n + np.minimum(order[at] + (2 << k), n)
        ok = near < len(places)
        ok[ok] = places[near[ok]] < last[ok]
        if ok.any():
            yield k, np.sort(order[at[ok]])


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(octave, first word, boundaries, words) of the tiles that have boundaries; tiles overlap by what these look at."""
    for k, found in boundaries(ids):
        core, margin = max(CORE_LEAST, CORE << k), octave(k)[2]
        for own in np.split(found, np.flatnonzero(np.diff(found // core)) + 1):
            first = int(own[0] // core * core)
            lo, hi = max(0, first - margin), min(len(ids), first + core + (2 << k) + margin)
            yield k, lo, own, ids[lo:hi]


def fragments(k: int, lo: int, found: list[int], words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, from, to) in a tile: words ``from`` to ``to - 1`` equal those one period ahead."""
    block, _, margin = octave(k)
    short, far = 1 << k, 2 << k
    spans: dict[int, list[list[int]]] = {}
    for place in found:
        b = place - lo
        right = z_function(words[b:b + far + margin])
        before = words[max(0, b - margin):b][::-1]
        text = words[max(0, b - margin):b + far - 1][::-1]
        left = z_function([*before, -1, *text])
        end = max(0, b - margin) + len(text)  # the word after the text
        for q in range(short, min(far, len(right))):
            if right[q] >= block:
                back = left[len(before) + 1 + end - b - q] if before else 0
                x, y = place - back, place + right[q]
                own = spans.setdefault(q, [])
                if own and x <= own[-1][1]:
                    own[-1][1] = max(y, own[-1][1])
                else:
                    own.append([x, y])
    for q, own in spans.items():
        for x, y in own:
            yield q, x, y


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """``words`` without those that a run (start, length, period) contains after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    return " ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


PARTS = "key long, doc_id long, n_words long, kind int, octave int, lo long, found binary, ids binary, words string"


def _parts(docs: DataFrame) -> DataFrame:
    """Rows of kind 0 (a document without boundaries), 1 (one with), 2 (a tile of it)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "text"):
            known: dict[bytes, int] = {}
            out = []
            for key, doc, text in zip(pdf["key"], pdf["doc_id"], pdf["text"], strict=True):
                words = text.encode().split()
                ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
                own = list(tiles(ids))
                out.append((key, doc, len(words), int(bool(own)), None, None, None, None, b" ".join(words).decode()))
                for k, lo, found, part in own:
                    out.append((key, None, None, 2, k, lo, found.astype(np.int64).tobytes(), part.tobytes(), None))
            names = [c.split()[0] for c in PARTS.split(", ")]
            made = zip(*out, strict=True) if out else [[]] * len(names)
            yield pd.DataFrame({c: pd.array(list(v), "Int64" if k < 6 else object) for k, (c, v) in enumerate(zip(names, made, strict=True))})

    return texts(docs).withColumn("key", F.monotonically_increasing_id()).mapInPandas(made, PARTS)


def _solved(parts: DataFrame, least: int) -> DataFrame:
    """``key, runs``: the runs of each document that has any, by start and period."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, k, lo, found, ids in zip(pdf["key"], pdf["octave"], pdf["lo"], pdf["found"], pdf["ids"], strict=True):
                at, words = np.frombuffer(found, np.int64).tolist(), np.frombuffer(ids, np.int32).tolist()
                out += [(key, q, x, y) for q, x, y in fragments(int(k), int(lo), at, words)]
            yield pd.DataFrame(out, columns=["key", "period", "x", "y"])

    spread = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.filter("kind = 2").select("key", "octave", "lo", "found", "ids").repartition(spread, "key", "octave", "lo")
    rows = rows.mapInPandas(solve, "key long, period long, x long, y long")
    by = Window.partitionBy("key", "period").orderBy("x", "y")
    ahead = F.max("y").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(ahead >= F.col("x"), 0).otherwise(1))
    rows = rows.withColumn("_g", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy("key", "period", "_g").agg(F.min("x").alias("start"), F.max("y").alias("y"))
    length = F.col("y") - F.col("start") + F.col("period")
    spans = spans.withColumn("length", length).filter((F.col("length") >= 2 * F.col("period")) & (F.col("length") >= least))
    runs = spans.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    listed = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    return runs.groupBy("key").agg(F.transform(listed, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: one row per row of ``docs`` (``doc_id``, ``text``).

    ``runs`` are all maximal stretches (``start, length, period``, in words) of ``least`` words and two periods or
    more, under their smallest period; ``collapsed`` are the words, joined by one space, without those a run contains
    after its first period. Null and wordless texts have no words and no runs. Repeated rows and ids stay
    apart, texts are taken whole, other columns are ignored, an empty table gives an empty result. ``least`` is 12 or
    more: blocks of four words mark the boundaries of the shortest periods.
    """
    if least < LEAST:
        raise ValueError(f"runs of at least {LEAST} words")
    parts = cut(_parts(docs))

    def dropped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "words"):
            done = []
            for words, runs in zip(pdf["words"], pdf["runs"], strict=True):
                listed = [] if runs is None else [(r["start"], r["length"], r["period"]) for r in runs]
                done.append(collapse(words.split(" "), listed) if listed else words)
            yield pdf[["doc_id", "n_words", "runs"]].assign(collapsed=done).astype({"doc_id": "Int64"})

    kind = "array<struct<start: long, length: long, period: long>>"
    rows = parts.filter("kind = 1").select("key", "doc_id", "n_words", "words").join(_solved(parts, least), "key", "left")
    live = rows.select("doc_id", "n_words", "runs", "words").mapInPandas(dropped, f"doc_id long, n_words long, runs {kind}, collapsed string")
    rest = parts.filter("kind = 0").select("doc_id", "n_words", F.lit(None).cast(kind).alias("runs"), F.col("words").alias("collapsed"))
    return live.union(rest).withColumn("runs", F.coalesce("runs", F.array().cast(kind)))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; every tenth document (by CRC-32 of its id) gets a periodic tail. A null id gets none."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                h = 1 if pd.isna(doc) else zlib.crc32(str(int(doc)).encode())
                if h % 10 == 0 and (words := text.encode().split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    tail = words[a:a + p]
                    words[a:] = (tail * (-(-(n - a) // len(tail))))[:n - a]
                    text = b" ".join(words).decode()
                out.append(text)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": out})

    return texts(docs).mapInPandas(made, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.floor(-1000 * F.col("best.l") / F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
