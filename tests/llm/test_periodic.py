"""Periodic runs against a scan of all periods."""

import hashlib
import random
import zlib

import pytest

from plotweave.llm import periodic as P
from tests.llm.helpers import DOCS, documents, wordy


def split(text):
    for c in "\t\n\r\x0b\x0c":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        start = None
        for i in range(len(w) - q + 1):
            if i < len(w) - q and w[i] == w[i + q]:
                start = i if start is None else start
            elif start is not None:
                length = i - start + q
                if length >= max(12, 2 * q):
                    found.setdefault((start, length), q)  # the smallest period comes first
                start = None
    return sorted((s, q, n) for (s, n), q in found.items())


def plain(text):
    w = split(text)
    runs = plain_runs(w)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return len(w), [(s, n, q) for s, q, n in runs], " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            unit = rnd.choices([f"w{k}" for k in range(rnd.choice([2, 5, 60]))], k=rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 11, 15, 16, 17, 31, 33, 70]))
            many = int(len(unit) * rnd.uniform(1.5, 5))
            parts += [f"x{rnd.randrange(99)}" for _ in range(rnd.randint(0, 12))] + (unit * 8)[:many]
        out.append((i, rnd.choice([" ", "\n", "  "]).join(parts)))
    return out


def test_equals_scan_of_all_periods(spark):
    rows = periodic_texts(1, 120) + [(500 + i, t) for i, t in wordy(3, 20, 3, 60)]
    rows += [(None, "a b " * 20), (3, rows[3][1]), (900, "a " * 11), (901, "a " * 12), (902, "a b c d e f " * 2), (903, "a b c d e f g " * 2 + "z")]
    found = P.periodic_runs(documents(spark, rows)).collect()
    key = lambda r: str(r)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    assert sorted(got, key=key) == sorted(((i, *plain(t)) for i, t in rows), key=key)


def test_tiles_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(P, "CORE", 1)
    monkeypatch.setattr(P, "CORE_LEAST", 3)
    for _, text in periodic_texts(7, 60) + wordy(5, 10, 2, 90):
        words = split(text)
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = P.np.array([numbers[w] for w in words], P.np.int32)
        spans = {}
        for k, lo, found, part in P.tiles(ids):
            for q, x, y in P.fragments(k, lo, found.tolist(), part.tolist()):
                spans.setdefault(q, []).append((x, y))
        runs = {}
        for q in sorted(spans):
            joined = []
            for x, y in sorted(spans[q]):
                if joined and x <= joined[-1][1]:
                    joined[-1][1] = max(y, joined[-1][1])
                else:
                    joined.append([x, y])
            for x, y in joined:
                if y - x >= q and y - x + q >= 12:
                    runs.setdefault((x, y - x + q), q)
        assert sorted((s, q, n) for (s, n), q in runs.items()) == plain_runs(words)


def test_long_text_and_z(spark):
    rnd = random.Random(2)
    unit = [f"w{rnd.randrange(4000)}" for _ in range(9_000)]
    text = " ".join([*unit, "mark", *(unit * 3)[:20_000], *["same"] * 5000])
    row = P.periodic_runs(documents(spark, [(1, text)])).first()
    assert [tuple(r) for r in row.runs] == [(9001, 20_000, 9_000), (29_001, 5_000, 1)]
    assert row.collapsed.split() == [*unit, "mark", *unit, "same"]
    s = [rnd.randrange(2) for _ in range(200)]
    same = lambda i: next((k for k in range(200 - i) if s[k] != s[i + k]), 200 - i)
    assert P.z_function(s)[1:] == [same(i) for i in range(1, 200)]


def test_empty_and_short_limits(spark):
    assert P.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(documents(spark, [(1, "a")]), 11)


def test_query_digests(spark, tmp_path):
    rows = wordy(8, 60, 30, 40) + [(70_000 + i, t) for i, t in periodic_texts(4, 20)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in P.op11_periodic_runs(spark, str(tmp_path)).collect()}
    for doc, text in rows:
        w, h = split(text), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        _, runs, collapsed = plain(" ".join(w))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        want = (len(runs), *best, runs and 1000 * best[1] // best[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())
        assert tuple(got[doc])[1:] == want
