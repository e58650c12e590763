"""Importance resampling against plain loops, and the CRC matrices against the standard library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from plotweave.llm import resampling as R
from tests.llm.helpers import DOCS, documents, wordy

ITEMS = "item_id long, text string, bucket string"


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return len(w), [zlib.crc32(f.encode()) % R.BUCKETS for f in found]


def plain(rows, items):
    of = [plain_features(t) for _, t in rows]
    s, t = Counter(b for _, f in of for b in f), Counter(b for x in items for b in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + R.BUCKETS) / ((s[b] + 1) * (T + R.BUCKETS))))
    out = []
    for (i, _), (n, f) in zip(rows, of):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:25 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def found(spark, rows, items):
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], ITEMS)
    return sorted((tuple(r) for r in R.resample(documents(spark, rows), target).collect()), key=str)


def test_equals_loops(spark):
    rows = wordy(2, 120, 60, 40)
    rows += [(None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (-4, "Ab-cD_e9 É漢 " * 30), (9000, "x" * 3000 + " y" + "z" * 700 + " x" * 40)]
    items = [rows[1][1], "w1 w2 W3", None, "", "é漢🙂 w1"]
    assert found(spark, rows, items) == plain(rows, items)


def test_long_text(spark):
    rnd = random.Random(5)
    rows = [(1, " ".join(rnd.choices([f"w{i}" for i in range(3000)], k=300_000))), (2, "w1 " * 25), (3, "w2 " * 25), (4, "w3 w4 " * 25), (5, "w" * 100_000)]
    assert found(spark, rows, ["w1 w2"]) == plain(rows, ["w1 w2"])


def test_empty_tables(spark):
    assert found(spark, [], ["a b"]) == []
    rows = wordy(4, 30, 20, 30)
    assert found(spark, rows, []) == plain(rows, [])
    assert found(spark, [(1, "few words")], ["few"]) == plain([(1, "few words")], ["few"])


def test_drawn_rows_keep_their_columns(spark):
    rows = wordy(6, 80, 40, 40)
    target = spark.createDataFrame([(1, "w1 w2 w3", "x")], ITEMS)
    kept = R.drawn_documents(documents(spark, rows), target)
    ids = {r.doc_id for r in R.resample(documents(spark, rows), target).filter("rank IS NOT NULL").collect()}
    assert kept.columns == documents(spark, []).columns and {r.doc_id for r in kept.collect()} == ids


def test_crc_matrices():
    rnd = random.Random(1)
    raw = bytes(rnd.randrange(256) for _ in range(5000))
    start = np.array([rnd.randrange(4000) for _ in range(900)])
    length = np.array([rnd.choice([1, 2, 3, 7, 30, 512, 513, 900]) for _ in range(900)])
    assert R.crcs(np.frombuffer(raw, np.uint8), start, length).tolist() == [zlib.crc32(raw[a:a + n]) for a, n in zip(start, length)]
