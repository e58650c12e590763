"""Benchmark passages: planted exact and edited ones are found, clean texts are not, alignments equal a full table."""

import random

import numpy as np

from plotweave.llm import decontaminate as D
from tests.llm.helpers import DOCS, documents

rnd = random.Random(7)
LETTERS = "abcdefghijklmnopqrstuvwxyz      "


def text(n):
    return "".join(rnd.choice(LETTERS) for _ in range(n))


def edit(t, k):
    t = list(t)
    for _ in range(k):
        i = rnd.randrange(len(t))
        rnd.choice([lambda: t.__setitem__(i, "#"), lambda: t.insert(i, "#"), lambda: t.pop(i)])()
    return "".join(t)


ITEMS = [(i, text(rnd.randint(70, 300))) for i in range(30)]


def test_planted_passages(spark):
    rows, want = [], {}
    for i, t in ITEMS:
        rows.append((2 * i, text(rnd.randint(0, 400)) + t.upper() + text(rnd.randint(0, 400))))
        want[2 * i] = (i, len(rows[-1][1]))
        rows.append((1000 + i, text(500)))
    # one edit less than the budget of each window
    for i, t in ITEMS:
        at = rnd.randint(0, 300)
        part = t[:96]
        rows.append((2000 + i, text(at) + edit(part, len(part) // D.CHARS_PER_EDIT) + text(200)))
    rows += [(5000, None), (5001, ""), (5002, "short"), (None, ITEMS[0][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS] + [(None, "too short", "x"), (77, None, "x"), (78, "", "x")], "item_id long, text string, doc_id string")
    found = D.contaminated(documents(spark, rows), bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert {(2 * i, i) for i, _ in ITEMS} <= pairs and {(2000 + i, i) for i, _ in ITEMS} <= pairs
    assert (None, 0) in pairs
    assert all(d is None or d < 1000 or 2000 <= d < 3000 for d, _ in pairs) and len(pairs) == 61
    texts = dict(rows)
    for r in found:
        if r.doc_id is not None and r.doc_id < 1000:
            assert texts[r.doc_id][r.start:r.stop] == dict(ITEMS)[r.item_id].upper() and r.edits == 0


def full(pattern, t, first, width):
    """Fewest edits over all pieces inside the band, by the plain table."""
    big, m = 10**6, len(pattern)
    inside = lambda i, j: 0 <= j <= len(t) and first <= j - i < first + width
    row = {j: 0 for j in range(-m, len(t) + 1) if inside(0, j)}
    for i in range(1, m + 1):
        new = {}
        for j in range(len(t) + 1):
            if inside(i, j):
                cost = min(row.get(j, big) + 1, row.get(j - 1, big) + (j == 0 or t[j - 1] != pattern[i - 1]), new.get(j - 1, big) + 1)
                new[j] = cost
        row = new
    return min(row.values(), default=big)


def test_alignment_equals_full_table():
    for _ in range(60):
        t = [rnd.choice("ab") for _ in range(40)]
        at = rnd.randint(0, 20)
        p = list(edit("".join(t[at:at + 15]), rnd.randint(0, 4)))
        first = at - rnd.randint(0, 6)
        got, start, stop = D.aligned(np.array([ord(c) for c in p], np.uint64), np.array([ord(c) for c in t], np.uint64), first, 12)
        want = full(p, t, first, 12)
        assert got == want or got >= 1000 <= want
        if got < 100:
            assert 0 <= start <= stop <= len(t)


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, [(i, t) for i, t in ITEMS])
    whole = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 900)
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == whole and len(whole) == 30
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.contaminated(spark.createDataFrame([], DOCS), bench).count() == 0


def test_passages_at_any_offset_and_length(spark):
    """Any window of an item, wherever it begins and whatever stands around it, exact or with its edits."""
    own = random.Random(13)
    bench = [(i, text(own.randint(100, 500))) for i in range(20)]
    rows, want = [], {}
    for k in range(200):
        i, t = own.choice(bench)
        n = own.randint(96, min(len(t), 140))
        at = own.choice([own.randint(0, len(t) - n), min(20, len(t) - n)])
        part = t[at:at + n] if k % 2 else edit(t[at:at + 96], 6)
        before = text(own.randint(0, 200))
        rows.append((k, before + part + text(own.randint(0, 200))))
        want[k] = (i, len(before), len(before) + len(part))
    rows += [(1000 + k, text(600)) for k in range(50)]
    found = D.contaminated(documents(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, i) for k, (i, _, _) in want.items()}
    for r in found:
        _, start, stop = want[r.doc_id]
        assert abs(r.start - start) <= 12 and abs(r.stop - stop) <= 12
