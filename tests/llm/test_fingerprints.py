"""Algebra of the fingerprints, and the comparison with edited texts against a plain loop."""

import hashlib
import random

from plotweave.llm import fingerprints as P
from tests.llm.helpers import DOCS, documents, wordy


def test_order_sum_insertion_and_deletion():
    a, b, c = "one two three", "four five six seven", ""
    assert P.Sum.of("\n".join([a, b, c])).hex() == P.Sum.of("\n".join([c, b, a])).hex()
    assert (P.Sum.of(a) + P.Sum.of(b)).hex() == P.Sum.of(a + "\n" + b).hex()
    assert (P.Sum.of("\n".join([a, b, c])) - P.Sum.of(b)).hex() == P.Sum.of(a + "\n" + c).hex()
    assert P.Sum.of("a\na").hex() != P.Sum.of("a").hex() != P.Sum.of("").hex()
    assert P.Sum.from_hex(P.Sum.of(b).hex()).hex() == P.Sum.of(b).hex()


def test_update_equals_recomputation(spark):
    rows = [(i, f"p{i}\nshared line\nlast {i}") for i in range(20)]
    changes = [(i, "shared line", -1) for i in range(0, 20, 2)] + [(3, "new one", 1)] * 3 + [(99, "unknown", 1), (None, "x", 1), (4, None, 1)]
    was = P.fingerprint(documents(spark, rows))
    now = dict(P.update(was, spark.createDataFrame(changes, "doc_id long, paragraph string, sign int")).collect())
    for i, t in rows:
        lines = t.split("\n")
        if i % 2 == 0:
            lines.remove("shared line")
        if i == 3:
            lines += ["new one"] * 3
        assert now[i] == P.Sum.of("\n".join(lines)).hex()


def test_edits_and_next_documents(spark):
    rows = wordy(9, 50, 40, 60)
    random.Random(1).shuffle(rows)
    rows += [(None, "the first text"), (3, "twice"), (3, "twice")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for at, (i, t) in enumerate(order):
        t, following = t or "", order[(at + 1) % len(order)][1] or ""
        k = len(t) // 4
        new = t[:len(t) - k] + following[:k]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), P.Sum.of(t).hex(), P.Sum.of(new).hex()))
    found = P.compare_with_edits(documents(spark, rows)).collect()
    assert sorted((tuple(r[:5]) for r in found), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    long = [r for r in found if r.n_chars > 150]
    assert sum(r.near_edited for r in long) / len(long) > 0.5
    twice = [r for r in found if r.doc_id == 3 and r.n_chars == 5]
    assert max(r.near_next for r in twice) == 1.0


def test_small_tables(spark):
    assert P.compare_with_edits(spark.createDataFrame([], DOCS)).count() == 0
    one = P.compare_with_edits(documents(spark, [(5, "abcdefgh")])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0


def test_long_repetitive_texts_stay_alike():
    repeated = lambda n: P.Sum.of("\n".join(["one two three"] * n))
    whole, most = repeated(40_000), repeated(30_000)
    assert abs(whole.likeness(most) - 2 * 0.75 / (1 + 0.75**2)) < 0.01
    assert P.Sum.from_hex(whole.hex()).likeness(most) == whole.likeness(most)
    assert (most + repeated(10_000)).hex() == whole.hex()
