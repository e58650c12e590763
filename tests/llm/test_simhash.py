"""Near-duplicate groups against all pairs, and the trees against a scan."""

import random

import numpy as np
import xxhash

from plotweave.llm import simhash
from tests.llm.helpers import DOCS, documents, wordy


def plain(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, ids, k=4):
    u = np.array(fps, np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None]) <= k
    label = np.arange(len(u))
    while True:
        new = np.array([label[a].min() for a in near])
        if (new == label).all():
            break
        label = new
    least = {}
    for x, i in zip(label, ids):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [least.get(x) for x in label]


def check(spark, rows):
    found = sorted((tuple(r)[:3] for r in simhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    fps = [plain(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, groups(fps, [i for i, _ in rows]))), key=str)
    assert found == want


def test_equals_all_pairs(spark):
    rnd = random.Random(3)
    words = [f"v{i}" for i in range(500)]
    rows = wordy(5, 40, 6, 30)
    for g in range(12):
        base = rnd.choices(words, k=120)
        for j in range(8):
            new = list(base)
            new[rnd.randrange(120)] = f"n{g}{j}"
            rows.append((1000 + 10 * g + j, " ".join(new)))
    check(spark, [*rows, (None, "A B C"), (None, "a b c"), (7, rows[7][1])])


def test_small_blocks_and_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SIDE", 20)
    monkeypatch.setattr(simhash, "SHARD", 15)
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in centre for _ in range(20)]
    fps = sorted(set(fps))
    points = spark.createDataFrame([(np.uint64(f).astype(np.int64).item(),) for f in fps], "fp long")
    from plotweave.operators.iterative import components

    edges = simhash.links(points).collect()
    signed = [np.uint64(f).astype(np.int64).item() for f in fps]
    want = groups(fps, signed)
    label = {f: f for f in signed}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 60
        lo, hi = sorted((top(a), top(b)))
        label[hi] = lo
    assert [top(f) for f in signed] == want
    assert len(edges) < 20 * len(fps)
    assert components(points, spark.createDataFrame(edges), "fp").count() == len(fps)


def test_trees_reach_every_near_point():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for k in (0, 1, 4, 7):
        masks = simhash.bands(k)
        assert sum(r + 1 for _, r in masks) == k + 1
        assert np.bitwise_or.reduce([np.uint64(m) for m, _ in masks]) == np.uint64(2**64 - 1)
        near = fps.copy()
        for i in range(len(near)):
            for b in rng.choice(64, k, replace=False):
                near[i] ^= np.uint64(1) << np.uint64(b)
        met = np.zeros(len(fps), bool)
        for mask, radius in masks:
            tree = simhash.Tree(fps[:500], mask, radius, 40)
            home = np.zeros(len(fps), int)
            for shard, rows, own in tree.visits(fps):
                home[rows[own]] = shard
            assert (home > 0).all()
            for shard, rows, _ in tree.visits(near):
                met[rows[home[rows] == shard]] = True
        assert met.all()


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def jaccard(a, b, n=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_documents_around_the_limit(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_SHARD", 60)
    monkeypatch.setattr(simhash, "SIDE", 50)
    rnd = random.Random(8)
    words = [f"v{i}" for i in range(2000)]
    rows, pairs = [], []
    for g in range(240):
        size = rnd.choice([50, 150, 300])
        base = rnd.choices(words, k=size)
        new = list(base)
        for _ in range(rnd.randint(0, max(2, size // 28))):
            new[rnd.randrange(size)] = "x" + str(rnd.random())
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(new))]
        pairs.append((2 * g, jaccard(rows[-2][1], rows[-1][1])))
    rows += [(900 + k, rows[0][1]) for k in range(120)] + [(2000, None), (2001, ""), (None, "a b c"), (None, rows[4][1])]
    found = simhash.similar_documents(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    high = [i for i, j in pairs if j >= 0.8]
    edge = [i for i, j in pairs if 0.8 <= j < 0.85]
    low = [i for i, j in pairs if j < 0.8]
    assert len(edge) > 15 and len(low) > 30
    assert np.mean([got[i + 1] == i for i in high]) >= 0.98
    assert all(got[i + 1] == i + 1 for i in low)
    assert all(got[i] == i for i, _ in pairs) and {got[900 + k] for k in range(120)} == {0}
    assert got[2001] == 2000 and simhash.similar_documents(spark.createDataFrame([], DOCS)).count() == 0
