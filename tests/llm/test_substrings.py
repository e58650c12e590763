"""Word-window dedup against brute force, and its index against counting."""

import numpy as np
import pytest

from plotweave.llm.substrings import FMIndex, WaveletTree, remove_repeats
from tests.llm.helpers import DOCS, documents, wordy


def brute(rows, n):
    low = lambda i: -(2**63) if i is None else i
    words = [(low(i), (t or "").encode().split()) for i, t in rows]
    first = {}
    for d, w in words:
        for s in range(len(w) - n + 1):
            key = tuple(w[s:s + n])
            first[key] = min(first.get(key, d), d)
    out = []
    for (i, _), (d, w) in zip(rows, words):
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s:s + n])] < d:
                gone[s:s + n] = [True] * n
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,window,gram,hot", [(1, 4, 2, 256), (2, 4, 2, 1), (3, 13, 5, 2), (4, 1, 1, 2)])
def test_equals_brute_force(spark, seed, window, gram, hot):
    rows = wordy(seed, 40, 6, 30)
    assert got(remove_repeats(documents(spark, rows), window, gram, hot)) == brute(rows, window)


def test_null_ids_and_repeated_rows(spark):
    text = "a b c d e f"
    rows = [(None, text), (None, text), (5, text), (5, text), (7, "x " + text), (8, None)]
    found = got(remove_repeats(documents(spark, rows), 4, 2))
    assert found == brute(rows, 4)
    assert (None, 6, 0, text) in found and (7, 7, 6, "x") in found


def test_empty_table_and_long_text(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(str(i) for i in range(60_000))
    rows = [(1, long), (2, "a " + long + " b")]
    assert got(remove_repeats(documents(spark, rows))) == brute(rows, 13)


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    for top in (1, 2, 9, 300):
        v = rng.integers(0, top, 1000)
        tree = WaveletTree(v)
        sym, at = rng.integers(0, top, 500), rng.integers(0, 1001, 500)
        assert tree.rank(sym, at).tolist() == [int((v[:a] == s).sum()) for s, a in zip(sym, at)]


def test_backward_search_counts_and_matching_statistics():
    rng = np.random.default_rng(2)
    rows = [rng.integers(1, 4, 30) for _ in range(5)]
    text = np.concatenate([np.append(r, 0) for r in rows])
    index, depth = FMIndex(text, 6), 6
    ends = np.array([e for e in range(depth, len(text)) if 0 not in text[e - depth:e]])
    length, lo, hi = index.statistics(text, ends, depth)
    windows = lambda k: [tuple(text[s:s + k]) for s in range(len(text) - k + 1)]
    for e, n, a, b in zip(ends, length, lo, hi):
        want = max((k for k in range(1, depth + 1) if windows(k).count(tuple(text[e - k:e])) > 1), default=0)
        assert n == want
        if n:
            assert b - a == windows(int(n)).count(tuple(text[e - n:e]))
