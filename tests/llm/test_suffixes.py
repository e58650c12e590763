"""Byte-passage dedup against brute force, and merging of transforms against counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plotweave.llm.suffixes import op4_suffix_array_dedup, remove_repeats, repeats
from tests.llm.helpers import DOCS, documents, wordy


def brute(rows, n):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(b[s:s + n] for b in raws for s in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(rows, raws):
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if count[b[s:s + n]] > 1:
                gone[s:s + n] = b"\1" * n
        spans = sum(1 for x in bytes(gone).split(b"\0") if x)
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:4], bytes(r[4])) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,length,gram,hot", [(1, 20, 5, 256), (2, 24, 4, 1), (3, 23, 8, 2), (4, 400, 16, 1)])
def test_equals_brute_force(spark, seed, length, gram, hot):
    rows = wordy(seed, 30, 5, 40 if length < 400 else 300)
    rows += [(900, "ab" * length), (901, "a" * (length + 1)), (902, "a" * (length - 1))]
    assert got(remove_repeats(documents(spark, rows), length, gram, hot)) == brute(rows, length)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, "abcdefghij"), (1, "abcdefghij"), (1, "abcdefghij"), (2, None), (3, "xbcdefghix")]
    assert got(remove_repeats(documents(spark, rows), 8, 3)) == brute(rows, 8)
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_query_takes_all_places_of_400_bytes_and_no_shorter_passage(spark, tmp_path):
    rnd = random.Random(7)

    def prose(n):
        return "".join(rnd.choices("abcdefghij ", k=n))

    long, short, common = prose(400), prose(399), prose(450)
    rows = [(1, f"A{long}B{prose(90)}"), (2, f"{prose(80)}C{long}D"), (3, f"E{short}F"), (4, f"{prose(70)}G{short}H"), (5, prose(900))]
    # more different surroundings than a group may have pieces
    rows += [(i, f"{prose(150)}\n{common}\n{prose(150)}") for i in range(10, 310)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in op4_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [found[i]["n_removed"] for i in range(1, 6)] == [400, 400, 0, 0, 0]
    for i, n_bytes, n_removed, n_spans, kept in brute(rows, 400):
        r = found.pop(i)
        # n_bytes is the length of the input, not of what is left
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n_bytes, n_removed, n_spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert not found


@pytest.mark.parametrize("length,chunk", [(12, 50), (7, 30), (30, 1), (80, 400)])
def test_merged_chunks_find_what_counting_finds(length, chunk):
    rnd = random.Random(length)
    base = bytes(rnd.choices(b"ab", k=300))
    contents = []
    for _ in range(12):
        a = rnd.randrange(200)
        contents.append(base[a:a + rnd.randint(length, length + 60)] + bytes(rnd.choices(b"abc", k=rnd.randint(0, 9))))
    contents += [base[:length - 1], contents[0]]
    weight = np.ones(len(contents), np.int64)
    weight[3] = 2
    count = Counter()
    for c, w in zip(contents, weight):
        count.update({c[s:s + length]: 0 for s in range(len(c) - length + 1)})
        for s in range(len(c) - length + 1):
            count[c[s:s + length]] += int(w)
    want = [s + length <= len(c) and count[c[s:s + length]] > 1 for c in contents for s in range(len(c))]
    assert repeats(contents, weight, length, chunk).tolist() == want
