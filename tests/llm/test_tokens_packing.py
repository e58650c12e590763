"""Token counts and packed ids against the tokenizer library, the plan against plain best-fit decreasing."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from plotweave.llm import packing, tokens
from tests.llm.helpers import DOCS, documents, wordy

PATH = public_tokenizers.path(tokens.TOKENIZER)
ODD = ["don't we'll  x\n\n y", "<|endoftext|>a<|endoftext|><|endoftext|>", " <|endoftext|> ", "漢字 🙂🙂 ٣٤ ß\u00a0\u200b\u0085", "\x00\x1f", "a" * 5000, " " * 700, "\r\n\t x", "1 22 333's"]


def rows():
    return [*wordy(11, 25, 30, 400), *[(5000 + i, t) for i, t in enumerate(ODD)], (None, "no id"), (3, "same"), (3, "same")]


@pytest.fixture(scope="module")
def ids():
    tok = tokens.tokenizer(PATH)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("top", [0, 5, 1000])
def test_counts(spark, ids, top):
    want = sorted(((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for i, t in rows()), key=str)
    assert sorted(map(tuple, tokens.count_tokens(documents(spark, rows()), top=top).collect()), key=str) == want


def test_random_texts_split_and_encode_alike(ids):
    rnd = random.Random(2)
    parts = [*"abc'st  \n\t.,é漢🙂0123٣ß\u2003\u200b\x85", "<|endoftext|>", "'ll", "   "]
    encode = packing.encoder(PATH).encode_to_numpy
    for _ in range(1500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        assert encode(t, allowed_special="all").tolist() == ids(t)
        assert sum(len(ids(p)) for p in tokens.pretokens(t)) == len(ids(t))


def plain_best_fit(lengths, limit):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(limit - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    limit = rnd.choice([10, 64, 200])
    lengths = [rnd.randint(1, limit) for _ in range(rnd.randint(1, 400))]
    if seed == 5:
        lengths = [1] * 333 + [limit] * 7
    histogram = Counter(lengths)
    slots = packing.plan(histogram, limit)
    bins, taken = {}, Counter()
    for length, first, n, sequence, offset in slots:
        assert first == taken[length]
        taken[length] += n
        for k in range(n):
            bins.setdefault(sequence + k, []).append((offset, length))
    assert taken == histogram
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(bins) == plain_best_fit(lengths, limit)


@pytest.mark.parametrize("limit", [2048, 64])
def test_packed_documents(spark, ids, limit):
    packed = packing.pack_documents(documents(spark, rows()), limit=limit).collect()
    want = []
    for i, t in rows():
        whole = [*ids(t), 0]
        head = (len(whole) - 1) % limit + 1
        cuts = [0, *range(head, len(whole), limit), len(whole)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, piece, a, b - a, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in packed), key=str) == sorted(want, key=str)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(bins) == plain_best_fit([w[3] for w in want], limit)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert tokens.count_tokens(empty).count() == 0 and packing.pack_documents(empty).count() == 0
