"""Toxicity: class-conditional Kneser-Ney models of words, spelled out character by character.

A word's probability under a class is the product over its characters (and its end), each given up to ``ORDER - 1``
characters before it in the word. The counts of full contexts are kept per class; what discounting takes from them goes
to one backoff distribution that both classes share, made of continuation counts over all training documents: given the
last ``SHORT`` characters, then alone. So an expression that is rare in either class costs the ratio little, while a
spelling that one class favours shows even in words never seen. A document's evidence is its length-normalised
log-likelihood ratio (mean over words) and the strongest word's.

All counts stay on Spark as whole tables. Each distinct word of the documents is scored once, by joins of its spellings with
the ratios; the ``TOP`` commonest spellings and then words are looked up where the words and documents are, all others go
through an equality join. A logistic curve over the evidence is fitted on about ``CALIBRATION`` labelled rows of one half
of the training documents, with ratios from the other half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import cut, drawn, slices, table, texts

ORDER, SHORT, DISCOUNT = 6, 2, 0.75
#: Spellings, and words, in a broadcast table; labelled rows for the curve.
TOP, CALIBRATION = 1 << 18, 20_000
THRESHOLD = 0.7

words_of = re.compile(r"[^\W_]+").findall
# fixed values: odd multipliers of the spelling hashes
STEP = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
FEATURES = ["mean", "peak", "words", "strong"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * STEP[0]
    return x ^ (x >> np.uint64(29))


def spellings(words: list[str]) -> tuple[np.ndarray, ...]:
    """For each character and end of each word: word number, hashes of the spelling, of its context and of its short
    context, and the character. Words begin with a character of their own."""
    flat = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    context, short = np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.uint64)
    for k in range(1, ORDER):
        back = np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), flat[:-k]]), 0) if k < len(flat) else np.zeros(len(flat), np.uint64)
        context += _mix(back * STEP[k])
        if k == SHORT:
            short = context.copy()
    own = place > 0
    context, short = _mix(context), _mix(short)
    spelling = _mix(context + _mix(flat * STEP[0]))
    return word[own], spelling[own], context[own], short[own], flat[own]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spellings of a batch with their counts ``n0 .. n3`` by class and half (2 * toxic + half)."""
    for pdf in slices(batches, "text", 8_000_000):
        index: dict[str, int] = {}
        kinds = []
        for text, toxic, half in zip(pdf["text"], pdf["toxic"], pdf["half"], strict=True):
            kinds.append(np.array([index.setdefault(w, len(index)) for w in words_of(text.lower())], np.int64) * 4 + (2 * toxic + half))
        if not index:
            continue
        n = np.bincount(np.concatenate(kinds), minlength=4 * len(index)).reshape(-1, 4)
        word, spelling, context, short, char = spellings(list(index))
        key, first, inverse = np.unique(spelling, return_index=True, return_inverse=True)
        made = {"g": key.view(np.int64), "x": context[first].view(np.int64), "s": short[first].view(np.int64), "c": char[first].astype(np.int64)}
        made |= {f"n{i}": np.bincount(inverse, weights=n[word, i]).astype(np.int64) for i in range(4)}
        yield pd.DataFrame(made)


def _ratios(counts: DataFrame, toxic: Column, plain: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Log ratios of spellings (``g``) and, for unseen ones, of contexts (``x``). Counts of one spelling may be in several rows."""
    d = DISCOUNT
    # dealt by context, so that the sums, the contexts and their join share one shuffle
    dealt = counts.select("g", "x", "s", "c", toxic.alias("t"), plain.alias("o")).filter("t + o > 0").repartition("x")
    seen = dealt.groupBy("g", "x", "s", "c").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    contexts = seen.groupBy("x").agg(
        F.sum("t").alias("tt"), F.sum("o").alias("to"), F.sum(F.signum("t")).alias("nt"), F.sum(F.signum("o")).alias("no")
    )
    pairs = seen.groupBy("s", "c").agg(F.count(F.lit(1)).alias("sc"))
    alone = pairs.groupBy("c").agg(F.sum("sc").alias("kc"))
    total = alone.agg(F.sum("kc")).first()[0] or 1
    shorts = pairs.groupBy("s").agg(F.sum("sc").alias("ks"), F.count(F.lit(1)).alias("ns"))
    backoff = pairs.join(shorts, "s").join(alone, "c").select(
        "s", "c", ((F.col("sc") - d + d * F.col("ns") * F.col("kc") / total) / F.col("ks")).alias("shared")
    )
    rest = lambda n, t: F.when(F.col(t) > 0, d * F.col(n) / F.col(t)).otherwise(1.0)
    own = lambda n, t: F.when(F.col(t) > 0, F.greatest(F.col(n) - d, F.lit(0.0)) / F.col(t)).otherwise(0.0)
    p = lambda n, k, t: own(n, t) + rest(k, t) * F.col("shared")
    grams = seen.join(contexts, "x").join(backoff, ["s", "c"]).select(
        F.col("g").alias("key"), (F.log(p("t", "nt", "tt")) - F.log(p("o", "no", "to"))).alias(name)
    )
    unseen = contexts.select(F.col("x").alias("key"), (F.log(rest("nt", "tt")) - F.log(rest("no", "to"))).alias(name))
    return grams, unseen


def _whole(half: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """Ratios of all keys: ``a`` of the half model (null if unseen there), ``b`` of the full model."""
    return cut(full.select("key", "b").join(half.select("key", "a"), "key", "left").withColumnRenamed("key", key))


class Known:
    """Ratios of the commonest keys: the levels of frequency ``n``, an eighth of a power of two each, that have no more than
    ``TOP`` keys together."""

    def __init__(self, of: DataFrame, key: str):
        level = F.floor(8 * F.log2("n"))
        least, total = 1 << 30, 0
        for at, size in sorted(((r[0], r[1]) for r in of.groupBy(level).count().collect()), reverse=True):
            total += size
            if total > TOP:
                break
            least = at
        got = of.filter(level >= least).select(key, "a", "b").toArrow()
        keys = got[key].to_numpy().astype(np.int64)
        order = np.argsort(keys)
        self.keys, self.a, self.b = keys[order], got["a"].to_numpy()[order], got["b"].to_numpy()[order]

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is known, and its two ratios (0 if not)."""
        if not len(self.keys):
            return np.zeros(len(key), bool), np.zeros(len(key)), np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return known, np.where(known, self.a[at], 0), np.where(known, self.b[at], 0)


def _key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - 2**63


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for pdf in slices(batches, "text"):
        for text in pdf["text"]:
            seen.update(words_of(text.lower()))
        if len(seen) > 400_000:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
            seen = Counter()
    if seen:
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})


def _spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches, "word", 1_000_000):
        _, spelling, context, _, _ = spellings(list(pdf["word"]))
        key, first, n = np.unique(spelling, return_index=True, return_counts=True)
        yield pd.DataFrame({"g": key.view(np.int64), "x": context[first].view(np.int64), "n": n})


def word_ratios(docs: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """``w, n, a, b``: key, occurrences in ``docs`` and log ratios, under the half and the full model, of each distinct word."""
    words = cut(docs.select("text").mapInPandas(_vocabulary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    spelt = words.select("word").mapInPandas(_spelled, "g long, x long, n long").groupBy("g", "x").agg(F.sum("n").alias("n"))
    # a spelling that a model has not seen has the ratio of its context there, and none if that is new too
    seen = spelt.join(grams, "g", "left").join(contexts.select("x", F.col("a").alias("xa"), F.col("b").alias("xb")), "x", "left")
    ratios = cut(seen.select("g", "n", *[F.coalesce(m, f"x{m}", F.lit(0.0)).alias(m) for m in "ab"]))
    common = docs.sparkSession.sparkContext.broadcast(Known(ratios, "g"))

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each word with the ratios of its known spellings added up, and its other spellings, a row each."""
        for pdf in slices(batches, "word", 1_000_000):
            word, spelling, *_ = spellings(list(pdf["word"]))
            known, a, b = common.value.look_up(spelling.view(np.int64))
            w = np.array([_key(x) for x in pdf["word"]], np.int64)
            size = len(w)
            yield pd.DataFrame({"w": w, "n": pdf["n"].to_numpy(), "g": pd.array([None] * size, "Int64"),
                                "a": np.bincount(word, a, size), "b": np.bincount(word, b, size)})
            rest = spelling[~known].view(np.int64)
            if len(rest):
                yield pd.DataFrame({"w": w[word[~known]], "n": 0, "g": pd.array(rest, "Int64"), "a": 0.0, "b": 0.0})

    rows = cut(words.mapInPandas(added, "w long, n long, g long, a double, b double"))
    rare = rows.filter("g IS NOT NULL").select("w", "n", "g").join(ratios.select("g", "a", "b"), "g")
    both = rows.filter("g IS NULL").select("w", "n", "a", "b").union(rare.select("w", "n", "a", "b"))
    return cut(both.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b")]))


def evidence(docs: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """``doc_id, held_out`` and ``FEATURES`` of each row of ``docs`` under the half (``a_``) and the full model (``b_``)."""
    ratios = word_ratios(docs, grams, contexts)
    common = docs.sparkSession.sparkContext.broadcast(Known(ratios, "w"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sum, largest and sum above 2 of the ratios of each text's known words, and its other words."""
        for pdf in slices(batches, "text"):
            index: dict[str, int] = {}
            rows = [np.array([index.setdefault(w, len(index)) for w in words_of(t.lower())], np.int64) for t in pdf["text"]]
            key = np.array([_key(w) for w in index], np.int64)
            known, *llr = common.value.look_up(key)
            size = np.array([len(r) for r in rows])
            made = {"doc_id": pdf["doc_id"].to_numpy(), "held_out": pdf["held_out"].to_numpy(), "size": size}
            full = np.flatnonzero(size)
            flat, start = np.concatenate([*rows, np.zeros(0, np.int64)]), (np.cumsum(size) - size)[full]
            for m, ratio in zip("ab", llr, strict=True):
                total, most, strong = np.zeros(len(rows)), np.full(len(rows), -np.inf), np.zeros(len(rows))
                if len(full):
                    total[full] = np.add.reduceat(ratio[flat], start)
                    most[full] = np.maximum.reduceat(np.where(known, ratio, -np.inf)[flat], start)
                    strong[full] = np.add.reduceat(np.maximum(ratio - 2, 0)[flat], start)
                made |= {f"{m}_total": total, f"{m}_most": most, f"{m}_above": strong}
            other = [np.unique(r[~known[r]], return_counts=True) if len(r) else (r, r) for r in rows]
            made |= {"rest": [key[r] if len(r) else r for r, _ in other], "times": [n for _, n in other]}
            yield pd.DataFrame(made).astype({"doc_id": "Int64"})

    parts = [f"{m}_{c}" for m in "ab" for c in ("total", "most", "above")]
    schema = "doc_id long, held_out boolean, size long, " + ", ".join(f"{c} double" for c in parts) + ", rest array<long>, times array<long>"
    rows = cut(docs.mapInPandas(summed, schema).withColumn("_row", F.monotonically_increasing_id()))
    listed = rows.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("_row", F.col("r.rest").alias("w"), F.col("r.times").alias("k"))
    rare = listed.join(ratios.select("w", "a", "b"), "w").groupBy("_row").agg(*[x for m in "ab" for x in (
        F.sum(F.col("k") * F.col(m)).alias(f"{m}_total2"), F.max(m).alias(f"{m}_most2"), F.sum(F.col("k") * F.greatest(F.col(m) - 2, F.lit(0.0))).alias(f"{m}_above2"),
    )])
    within = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    plus = lambda c: (F.col(c) + F.coalesce(f"{c}2", F.lit(0.0))) / F.col("size")
    of = lambda m: [
        10 * within(plus(f"{m}_total"), -1.0, 1.0), within(F.greatest(f"{m}_most", f"{m}_most2"), -2.0, 12.0) / 4,
        F.log1p("size") / 4, 10 * within(plus(f"{m}_above"), 0.0, 1.0),
    ]
    made = [F.when(F.col("size") > 0, x).otherwise(0.0).alias(f"{m}_{f}") for m in "ab" for f, x in zip(FEATURES, of(m), strict=True)]
    return rows.drop("rest", "times").join(rare, "_row", "left").select("doc_id", "held_out", *made)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last one constant) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id``, ``text``).

    Trained on the rows of ``known`` (``docs`` if not given) that ``labels`` (``doc_id``, ``toxic``) marks, unless held out;
    all of them are counted. Ids, languages and sources are no inputs. A document with several labels is toxic if one
    of them says so; null labels and ids teach nothing. Null and empty texts are scored by their lack of evidence. With
    fewer than two classes in the labels there is nothing to tell apart and all scores are 0. Repeated rows stay,
    other columns are ignored, an empty table gives an empty result.
    """
    rows = texts(docs).withColumn("held_out", held_out())
    marked = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out())
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    marked = cut(marked.withColumn("half", half))
    train = texts(docs if known is None else known).filter(~held_out()).join(marked, "doc_id")
    counts = cut(train.select("text", "toxic", "half").mapInPandas(
        _counted, "g long, x long, s long, c long, n0 long, n1 long, n2 long, n3 long"
    ).groupBy("g", "x", "s", "c").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)]))
    grams_a, contexts_a = _ratios(counts, F.col("n2"), F.col("n0"), "a")
    grams_b, contexts_b = _ratios(counts, F.col("n2") + F.col("n3"), F.col("n0") + F.col("n1"), "b")
    grams, contexts = _whole(grams_a, grams_b, "g"), _whole(contexts_a, contexts_b, "x")
    found = cut(evidence(rows, grams, contexts))
    learnt = found if known is None else cut(evidence(texts(known).withColumn("held_out", held_out()), grams, contexts))
    other = marked.filter(F.col("half") == 1)
    chosen = drawn(other, other.count(), CALIBRATION, "doc_id")
    got = learnt.join(chosen, "doc_id").select("toxic", *[f"a_{f}" for f in FEATURES]).toArrow().to_pandas()
    if got["toxic"].nunique() < 2:
        score = F.lit(0.0)
    else:
        w = logistic(got[[f"a_{f}" for f in FEATURES]].to_numpy(), (got["toxic"] > 0).to_numpy().astype(float))
        at = sum((F.lit(float(k)) * F.col(f"b_{f}") for k, f in zip(w, FEATURES, strict=False)), F.lit(float(w[-1])))
        score = 1 / (1 + F.exp(-at))
    scored = found.select("doc_id", "held_out", F.round(score, 9).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
