"""Fixtures of the text operator tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, d long, r string, h string, fp string, text2 string, score double"


def documents(spark, rows):
    """Rows of (doc_id, text) with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), 1, "x", "y", "z", t, 0.5) for i, t in rows], DOCS)


def wordy(seed, docs, vocabulary, most, passages=3):
    """Random texts over a small vocabulary with shared passages, copies, empty texts and a null."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    shared = [" ".join(rnd.choices(words, k=rnd.randint(5, 20))) for _ in range(passages)]
    out = []
    for i in range(docs):
        parts = [" ".join(rnd.choices(words, k=rnd.randint(0, most)))]
        if rnd.random() < 0.6:
            parts.append(rnd.choice(shared))
        parts.append(" ".join(rnd.choices(words, k=rnd.randint(0, most))))
        out.append((i, rnd.choice([" ", "\n", "\t "]).join(parts)))
    out += [(docs + k, out[k][1]) for k in range(0, docs, 4)]
    return [*out, (2 * docs, ""), (2 * docs + 1, None), (2 * docs + 2, " \n\t"), (2 * docs + 3, "é漢🙂 w1 w2")]
