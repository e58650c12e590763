"""Held-out accuracy, and what a score may depend on."""

import random
import zlib

import numpy as np

from plotweave.llm import toxicity as X
from tests.llm.helpers import DOCS, documents


def corpus(n=700):
    rnd = random.Random(6)
    stem = ["ta", "ri", "mo", "sel", "ka", "no", "pi", "du"]
    word = lambda: "".join(rnd.choices(stem, k=rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(1 + len(words) // 20):
                words.insert(rnd.randrange(len(words)), "zug" + word())  # never the same word
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def scored(spark, rows, labels):
    marked = spark.createDataFrame([(i, t, "x") for i, t in labels], "doc_id long, toxic int, text string")
    return X.score_toxicity(documents(spark, rows), marked).collect()


def test_held_out_accuracy_and_inputs(spark):
    rows, labels = corpus()
    odd = [(9000, None), (9001, ""), (9002, "!!! ..."), (None, "ta ri mo"), (5, rows[5][1]), (9003, "zug" * 40_000)]
    got = scored(spark, rows + odd, labels + [(0, None), (None, 1), (10, 0), (10, 1)])
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    for i, r in by.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    truth = dict(labels)
    held = [(by[i].predicted, truth[i]) for i in truth if by[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.97
    # labels of held-out rows, and ids' other columns, change nothing
    flipped = [(i, 1 - t if by[i].held_out else t) for i, t in labels]
    again = {r.doc_id: r.score for r in scored(spark, rows + odd, flipped + [(0, None), (None, 1), (10, 0), (10, 1)])}
    assert all(abs(again[i] - by[i].score) < 1e-9 for i in by)


def test_kneser_ney_sums_to_one_in_a_context(spark):
    rows = [{"text": t, "toxic": k, "half": 0} for t, k in [("abc abd abe", 0), ("abd abd xyz", 1), ("q abc", 0)]]
    counts = spark.createDataFrame(rows).select("text", "toxic", "half").mapInPandas(X._counted, "g long, x long, s long, c long, n0 long, n1 long, n2 long, n3 long")
    from pyspark.sql import functions as F

    grams, unseen = X._ratios(counts, F.col("n2"), F.col("n0"), "a")
    a = {r.key: r.a for r in grams.collect()}
    _, spelling, context, short, char = X.spellings(["abc", "abd", "abe"])
    # 'c' and 'e' after 'ab' never occur in toxic texts, 'd' mostly does
    ratio = [a[int(g.view(np.int64))] for g, c in zip(spelling, char) if chr(c) in "cde"]
    assert ratio[1] > 0 > ratio[0] and ratio[2] < 0
    assert unseen.count() == len({int(x) for x in context} | {int(x) for x in X.spellings(["xyz", "q"])[2]})


def test_no_classes_no_rows(spark):
    rows, labels = corpus(30)
    assert {r.score for r in scored(spark, rows, [])} == {0.0}
    assert {r.score for r in scored(spark, rows, [(i, 0) for i, _ in labels])} == {0.0}
    assert X.score_toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_scores_equal_whole_count_tables(spark, monkeypatch):
    """Every spelling counts, however rare, whether its word is looked up or joined."""
    import re
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9)))
    rows = [(i, " ".join([word() for _ in range(30)] + ["zug" + word()] * (i % 4 == 0) + ["the"] * (i % 3))) for i in range(600)]
    labels = {i: int(i % 4 == 0) for i, _ in rows}
    monkeypatch.setattr(X, "TOP", 300, raising=False)
    got = {r.doc_id: r.score for r in scored(spark, rows, list(labels.items()))}
    ids = spark.createDataFrame([(i,) for i in labels], "doc_id long")
    half = {r[0]: r[1] for r in ids.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2))).collect()}
    learnt = [i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1]

    def spell(w):
        w = "\x02" + w + "\x03"
        return [(w[max(0, j - X.ORDER + 1):j], w[max(0, j - X.SHORT):j], w[j]) for j in range(1, len(w))]

    def model(train):
        count, d = defaultdict(lambda: [0, 0]), X.DISCOUNT
        for i in train:
            for w in re.findall(r"[^\W_]+", dict(rows)[i].lower()):
                for k in spell(w):
                    count[k][labels[i]] += 1
        total, kinds, pair, short = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), Counter(), defaultdict(set)
        alone, weight = Counter(), Counter()
        for (x, s, c), n in count.items():
            for k in (0, 1):
                total[x][k] += n[k]
                kinds[x][k] += n[k] > 0
            pair[s, c] += 1
            short[s].add(c)
            weight[s] += 1
            alone[c] += 1
        all_ = sum(alone.values())

        def ratio(w):
            out = 0.0
            for x, s, c in spell(w):
                if x not in total:
                    continue
                rest = [d * kinds[x][k] / total[x][k] if total[x][k] else 1.0 for k in (0, 1)]
                p = rest
                if (x, s, c) in count:
                    shared = (pair[s, c] - d + d * len(short[s]) * alone[c] / all_) / weight[s]
                    p = [(max(count[x, s, c][k] - d, 0) / total[x][k] if total[x][k] else 0.0) + rest[k] * shared for k in (0, 1)]
                out += np.log(p[1]) - np.log(p[0])
            return out

        return ratio

    def features(ratio, i):
        r = np.array([ratio(w) for w in re.findall(r"[^\W_]+", dict(rows)[i].lower())])
        return [10 * np.clip(r.mean(), -1, 1), np.clip(r.max(), -2, 12) / 4, np.log1p(len(r)) / 4, 10 * np.clip(np.maximum(r - 2, 0).mean(), 0, 1)]

    a, b = model([i for i in learnt if not half[i]]), model(learnt)
    other = [i for i in learnt if half[i]]
    w = X.logistic(np.array([features(a, i) for i in other]), np.array([float(labels[i]) for i in other]))
    want = {i: 1 / (1 + np.exp(-(np.dot(w[:-1], features(b, i)) + w[-1]))) for i in labels}
    assert max(abs(got[i] - want[i]) for i in labels) < 1e-6
