"""Dropped lines against a plain version of the template tree."""

import random
from collections import defaultdict

import pytest

from plotweave.llm import templates as T
from tests.llm.helpers import DOCS, documents


def plain(rows, depth, support, constant):
    seen, lines = defaultdict(set), []
    for key, (i, text) in enumerate(rows):
        own = T.stamped(text or "", depth)
        for no, node, stamp, tokens in own:
            lines.append((key, no, node, stamp, tuple(tokens)))
            seen[node].add(stamp)
    kinds = defaultdict(set)
    for _, _, node, stamp, tokens in lines:
        if len(seen[node]) >= support:
            kinds[node, tokens].add(stamp)
    share = defaultdict(int)
    for (node, tokens), stamps in kinds.items():
        for at, t in enumerate(tokens):
            share[node, at, t] += len(stamps)
    count, shape = defaultdict(set), {}
    for (node, tokens), stamps in kinds.items():
        same = [t != T.FIELD and share[node, at, t] >= support for at, t in enumerate(tokens)]
        if sum(same) / len(same) >= constant:
            shape[node, tokens] = (node, tuple(t if s else T.FIELD for t, s in zip(tokens, same)))
            count[shape[node, tokens]] |= stamps
    gone = defaultdict(set)
    for key, no, node, _, tokens in lines:
        if (node, tokens) in shape and len(count[shape[node, tokens]]) >= support:
            gone[key].add(no)
    out = []
    for key, (i, text) in enumerate(rows):
        own = None if text is None else "\n".join(x for no, x in enumerate(text.split("\n")) if no not in gone[key])
        out.append((i, own, 1 if text is None else text.count("\n") + 1, len(gone[key])))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdef", k=4))
    rows = []
    for i in range(80):
        lines = [" ".join(word() for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 5))]
        if i % 2:
            lines.insert(rnd.randint(0, len(lines)), f"Printed by user{i} on day {i % 7} of the {word()} list")
        if i % 3 == 0:
            lines.append("All rights reserved.")
        rows.append((i, "\n".join(lines)))
    copy = rows[5][1] + "\nand one more line that only these copies have"
    return rows + [(100 + k, copy) for k in range(40)] + [(200, None), (201, ""), (202, "\n\n"), (None, "All rights reserved."), (3, rows[3][1]), (203, "All rights reserved.\r")]


@pytest.mark.parametrize("seed,support", [(1, 10), (2, 4)])
def test_equals_plain_version(spark, seed, support):
    rows = corpus(seed)
    found = T.drop_lines(documents(spark, rows), 3, support, 0.5)
    got = sorted((tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)
    assert got == plain(rows, 3, support, 0.5)
    assert set(found.columns) == {"doc_id", "text", "lang", "source", "n_chars", "d", "r", "h", "fp", "text2", "score", "n_lines", "n_removed"}


def test_boilerplate_goes_and_copies_stay(spark):
    rows = corpus(1)
    got = {r.doc_id: r.text for r in T.drop_lines(documents(spark, rows)).collect() if r.doc_id is not None}
    assert not any("Printed by" in (t or "") for i, t in got.items() if i < 80)
    assert all("only these copies have" in got[100 + k] for k in range(40))


def test_lines_of_one_document_do_not_make_a_template(spark):
    words = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st", "uv", "wx"]
    one = "\n".join(f"of the same kind but {w} only" for w in words)
    others = [(i, f"of the same kind {w} {w}{v} here {v}\nand {w} {v}") for i, (w, v) in enumerate((w, v) for w in words for v in words[:2])]
    got = {r.doc_id: r.n_removed for r in T.drop_lines(documents(spark, [(500, one), *others])).collect()}
    assert got[500] == 0


def test_empty_table(spark):
    assert T.drop_lines(spark.createDataFrame([], DOCS)).count() == 0
