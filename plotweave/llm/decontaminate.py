"""Benchmark decontamination: q-gram counting in diagonal bands, then banded alignment.

An item is read as windows of ``WINDOW`` characters (a shorter one as a whole) from every place on. A document region
within ``e`` edits of a window of n characters shares at least n + 1 - q(e + 1) of its q-grams, all on diagonals at
most ``e`` apart. Diagonals (place in the document minus place in the item) are counted in bands twice the step
wide, which overlap by a step of more than ``e``, so one band holds them all. In bands with enough shared q-grams, the
windows that hold enough of them are verified together, by alignments confined to the band's diagonals.

Items are taken in blocks of bounded size; a block's q-gram table is sent to all tasks and the documents stream by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.llm.common import slices, table, texts

WINDOW, Q, CHARS_PER_EDIT = 96, 10, 16
#: Characters of the items in one block: bounds what is sent to the tasks.
BLOCK_CHARS = 4_000_000
# fixed value: odd multiplier of the q-gram hashes
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, item_id long, start long, stop long, edits long, windows long"


def characters(text: str) -> np.ndarray:
    """Code points with A-Z lower-cased and control characters as blanks; one for each character."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    a[a < 32] = 32
    upper = (a >= 65) & (a <= 90)
    a[upper] += np.uint64(32)
    return a


def grams(a: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit value of the ``q`` characters from each place on."""
    n = len(a) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power, width, have, out, done = np.array([BASE]), 1, a, None, 0
    while True:
        if q & width:
            m = len(a) - done - width + 1
            out = have[:m] if out is None else out[:m] * power + have[done:done + m]
            done += width
        if done == q:
            out = out[:n]
            return (out ^ (out >> np.uint64(31))) * BASE
        have = have[:len(have) - width] * power + have[width:]
        power, width = power * power, 2 * width


class Items:
    """Items of a block, and where each q-gram is in them."""

    def __init__(self, ids: list[int], item_texts: list[str], window: int = WINDOW, q: int = Q, per_edit: int = CHARS_PER_EDIT):
        self.q, self.window, self.items, keys, which, place = q, window, [], [], [], []
        for item, text in zip(ids, item_texts, strict=True):
            a = characters(text)
            if len(a) < q:
                continue
            n = min(len(a), max(window, q))
            # as many edits as leave at least one shared q-gram to ask for
            edits = max(0, min(n // per_edit, (n + 1) // q - 1))
            g = grams(a, q)
            keys.append(g)
            which.append(np.full(len(g), len(self.items)))
            place.append(np.arange(len(g)))
            self.items.append((item, a, n, edits, max(1, n + 1 - q * (edits + 1))))
        if self.items:
            keys, which, place = np.concatenate(keys), np.concatenate(which), np.concatenate(place)
            order = np.argsort(keys, kind="stable")
            self.keys, first = np.unique(keys[order], return_index=True)
            self.first = np.append(first, len(order))
            self.which, self.place = which[order], place[order]
            self.need = np.array([w[4] for w in self.items])
            self.step = max(w[3] for w in self.items) + 1
            self.filter = np.zeros(1 << 22, bool)
            self.filter[self.keys >> np.uint64(42)] = True

    def bands(self, a: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, first diagonal, places of windows) where windows of an item share enough q-grams with a text."""
        g = grams(a, self.q)
        at = np.flatnonzero(self.filter[g >> np.uint64(42)])
        if not len(at):
            return
        key = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        same = self.keys[key] == g[at]
        at, key = at[same], key[same]
        times = self.first[key + 1] - self.first[key]
        entry = np.repeat(self.first[key] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        item, place = self.which[entry], self.place[entry]
        low = (np.repeat(at, times) - place + (1 << 40)) // self.step
        code = np.concatenate([item << 44 | low, item << 44 | (low - 1)])  # the bands that begin at low and at low - 1
        order = np.argsort(code, kind="stable")
        found, start, n = np.unique(code[order], return_index=True, return_counts=True)
        enough = n >= self.need[found >> 44]
        for c, k, size in zip(found[enough].tolist(), start[enough], n[enough], strict=True):
            which = c >> 44
            _, chars, length, _, need = self.items[which]
            mark = np.zeros(len(chars) - self.q + 2, np.int64)
            mark[place[order[k:k + size] % len(place)] + 1] = 1
            shared = np.cumsum(mark)
            span = length - self.q + 1
            windows = np.flatnonzero(shared[span:] - shared[:-span] >= need)
            if len(windows):
                yield which, (c & ((1 << 44) - 1)) * self.step - (1 << 40), windows


def aligned_windows(item: np.ndarray, places: np.ndarray, n: int, a: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``n`` characters of the item at ``places``: its fewest edits against a piece of ``a`` on the
    diagonals ``first`` .. ``first + width - 1``, and that piece (starts, stops). Row by row over the windows; a cell is
    edits and start, compared as one number."""
    unit, shift, base = 1 << 40, np.arange(width), (first + places)[:, None]
    low, high = int(base.min()), int(base.max()) + n + width + 1
    pad = np.full(high - low, np.uint64(2**40))
    lo, hi = max(0, low), min(len(a), high)
    if hi > lo:
        pad[lo - low:hi - low] = a[lo:hi]
    inside = lambda i: (base + i + shift >= 0) & (base + i + shift <= len(a))
    last = np.full((len(places), 1), unit << 10)
    cell = np.where(inside(0), base + shift, unit << 10)
    for i in range(n):
        diagonal = cell + unit * (pad[base - low + i + shift] != item[places + i][:, None])
        skipped = np.concatenate([cell[:, 1:], last], axis=1) + unit  # a character of the window that the text lacks
        best = np.where(inside(i + 1), np.minimum(diagonal, skipped), unit << 10)
        cell = np.minimum.accumulate(best - unit * shift, axis=1) + unit * shift  # text characters that the window lacks
    at = np.argmin(cell >> 40, axis=1)
    got = cell[np.arange(len(places)), at]
    return got >> 40, got & (unit - 1), first + places + n + at


def aligned(pattern: np.ndarray, a: np.ndarray, first: int, width: int) -> tuple[int, int, int]:
    """``aligned_windows`` of one pattern as a whole."""
    edits, start, stop = aligned_windows(pattern, np.zeros(1, np.int64), len(pattern), a, first, width)
    return int(edits[0]), int(start[0]), int(stop[0])


def regions(items: Items, text: str) -> list[tuple[int, int, int, int, int]]:
    """(item, start, stop, edits, windows) of the regions of a text: confirmed windows of an item that touch, joined.
    ``edits`` and ``windows`` count the first, the last and those half a window apart between them."""
    a = characters(text)
    hits: dict[int, set[tuple[int, int, int, int]]] = {}
    for which, first, places in items.bands(a):
        item, chars, length, most, _ = items.items[which]
        for k in range(0, len(places), 256):
            at = places[k:k + 256]
            edits, start, stop = aligned_windows(chars, at, length, a, first, 2 * items.step)
            good = (edits <= most) & (stop > start)
            hits.setdefault(which, set()).update(zip(start[good].tolist(), stop[good].tolist(), edits[good].tolist(), at[good].tolist(), strict=True))
    out = []
    for which, found in hits.items():
        best: dict[tuple[int, int], tuple] = {}
        for start, stop, n, at in found:  # one confirmation of a window per place
            key = (at, (start - at) // (4 * items.step))
            best[key] = min(best.get(key, (n, start, stop)), (n, start, stop))
        runs: list[list[tuple]] = []
        reach = -1
        for n, start, stop in sorted(best.values(), key=lambda x: (x[1], x[2])):
            if not runs or start > reach:
                runs.append([])
                reach = stop
            runs[-1].append((start, stop, n))
            reach = max(reach, stop)
        for run in runs:
            counted = [run[0]]
            for x in run[1:]:
                if x[0] >= counted[-1][0] + max(1, items.window // 2):
                    counted.append(x)
            if counted[-1] != run[-1]:
                counted.append(run[-1])
            out.append((items.items[which][0], run[0][0], max(x[1] for x in run), sum(x[2] for x in counted), len(counted)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, q: int = Q, per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``doc_id, item_id, start, stop, edits, windows``: regions of documents that repeat benchmark items.

    Places count characters from 0. ``edits`` adds up over ``windows``, confirmed ones half a window apart. Texts of less than ``q``
    characters and null texts have no regions, neither as documents nor as items; null item ids are kept. Equal items
    and repeated rows each give their own regions. Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    listed = benchmark.select("item_id", "text").filter(F.length("text") >= q)
    # blocks by a running sum of sizes within hashed parts, so that no window holds the whole benchmark
    parts = listed.withColumn("_p", F.pmod(F.xxhash64("item_id", "text"), F.lit(64)))
    sized = parts.groupBy("_p").agg(F.sum(F.length("text")).alias("n")).collect()
    rows = texts(docs)
    found = []
    for group in _groups({r["_p"]: r["n"] for r in sized}):
        block = parts.filter(F.col("_p").isin(group))
        running = F.sum(F.length("text")).over(Window.partitionBy("_p").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0))
        blocks = block.withColumn("_b", F.floor(running / BLOCK_CHARS))
        most = blocks.agg(F.max("_b")).first()[0]
        for b in range(most + 1):
            got = blocks.filter(F.col("_b") == b).orderBy("item_id", "text").select("item_id", "text").collect()
            items = Items([-1 if r[0] is None else r[0] for r in got], [r[1] for r in got], window, q, per_edit)
            if items.items:
                found.append(_scan(rows, spark.sparkContext.broadcast(items)))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], SCHEMA)


def _groups(sizes: dict[int, int]) -> list[list[int]]:
    """Parts put together up to the size of a block."""
    out, total = [], 0
    for p, n in sorted(sizes.items()):
        if out and total + n <= BLOCK_CHARS:
            out[-1].append(p)
            total += n
        else:
            out.append([p])
            total = n
    return out


def _scan(rows: DataFrame, items) -> DataFrame:
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "text"):
            out = [(d, *r) for d, text in zip(pdf["doc_id"], pdf["text"], strict=True) if len(text) >= items.value.q for r in regions(items.value, text)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(made, SCHEMA)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
