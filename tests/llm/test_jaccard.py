"""Jaccard groups against all pairs, and the signatures' promise on single pairs."""

import random

import numpy as np
import pytest

from plotweave.llm import jaccard as J
from tests.llm.helpers import documents, wordy


def plain_set(text, words=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def changed(rnd, words, times, name):
    out = list(words)
    for k in range(times):
        kind, at = rnd.choice("rid"), rnd.randrange(len(out))
        if kind == "r":
            out[at] = f"{name}{k}"
        elif kind == "i":
            out.insert(at, f"{name}{k}")
        elif len(out) > 1:
            del out[at]
    return out


def copies(seed, families, each, lengths):
    rnd, rows = random.Random(seed), []
    for f in range(families):
        base = rnd.choices([f"b{i}" for i in range(400)], k=rnd.choice(lengths))
        for j in range(each):
            new = changed(rnd, base, rnd.randint(0, 1 + len(base) // 40), f"n{f}_{j}_")
            rows.append((1000 + 100 * f + j, " ".join(new)))
    rnd.shuffle(rows)
    return rows


def check(spark, rows):
    assert sorted((tuple(r) for r in J.similar_groups(documents(spark, rows)).collect()), key=str) == plain(rows)


def test_equals_all_pairs(spark):
    rows = wordy(11, 60, 30, 40) + copies(3, 30, 6, [1, 4, 5, 6, 8, 9, 12, 15, 20, 40, 90, 150, 400])
    check(spark, [*rows, (None, "A B C d e F"), (None, "a b c D e f"), (7, rows[7][1]), (7, rows[7][1])])


def test_small_groups_and_common_passages(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP_CHARS", 3000)
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "FEW", 3)
    passage = " ".join(f"p{i}" for i in range(60))
    rnd = random.Random(8)
    rows = [(i, f"{passage} " + " ".join(f"q{rnd.randrange(3000)}" for _ in range(rnd.choice([3, 8, 10, 40])))) for i in range(120)]
    check(spark, rows + copies(5, 20, 5, [30, 60, 90]))


def test_empty_tables(spark):
    check(spark, [])
    check(spark, [(1, None), (2, ""), (6, " \t"), (4, "one two"), (3, "One TWO"), (5, "one two three")])


def test_long_text(spark):
    rnd = random.Random(9)
    long = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:50_000])), (3, " ".join(long[:40_000])), (4, "w1 " * 50_000)]
    check(spark, rows)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_pairs_share_a_signature(percent):
    rng, bands = np.random.default_rng(percent), J.Bands(percent)
    for n in [*range(1, 40), 75, 120, 333, 1000]:
        for _ in range(12):
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            most = bands.differ[max(0, np.searchsorted(bands.starts, n, "right") - 1)]
            drop, add = rng.integers(0, most + 1), rng.integers(0, most + 1)
            other = np.concatenate([base[min(drop, n - 1):], rng.integers(0, 2**63, add, dtype=np.uint64)])
            both = n - min(drop, n - 1)
            if 100 * both < percent * (n + len(other) - both) or (not drop and not add):
                continue
            a, b = ({int(x) for s, _ in bands.signatures(np.sort(v)) for x in s} for v in (base, other))
            assert a & b
