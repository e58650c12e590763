"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Every paragraph (line) has a wide vector: ``EXACT`` lanes of 32 bits from its digest, and ``LIKE`` lanes of 32 bits in
which each of its three-word runs adds +1 or -1. A fingerprint is the sum of the vectors, lane by lane modulo 2^32. It does not depend on the order of paragraphs, fingerprints of parts add up, and paragraphs are inserted or
deleted by adding or subtracting their vectors. Equal texts have equal fingerprints; the inner product of the second
group of lanes estimates how many three-word runs two texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import table, texts

EXACT, LIKE = 8, 128

# fixed values: odd multipliers of the run hashes
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


class Sum:
    """A fingerprint: ``exact`` and ``like`` (uint32 lanes)."""

    __slots__ = ("exact", "like")

    def __init__(self, exact: np.ndarray | None = None, like: np.ndarray | None = None):
        self.exact = np.zeros(EXACT, np.uint32) if exact is None else exact
        self.like = np.zeros(LIKE, np.uint32) if like is None else like

    @classmethod
    def of(cls, text: str) -> Sum:
        exact, hashes = np.zeros(EXACT, np.uint32), []
        for line in text.encode().split(b"\n"):
            exact += np.frombuffer(hashlib.blake2b(line, digest_size=4 * EXACT).digest(), "<u4")
            hashes += map(xxhash.xxh3_64_intdigest, line.split())
            hashes += (0, 0)  # runs end with their paragraph
        h = np.array(hashes, np.uint64)
        run = _mixed(h[:-2] + MIX[1] * h[1:-1] + MIX[2] * h[2:])[h[:-2] != 0]
        like = np.zeros(LIKE, np.int64)
        for at in range(0, len(run), 1 << 16):
            part = run[at:at + (1 << 16)]
            bits = np.stack([part, _mixed(part + MIX[2])], axis=1).view(np.uint8)
            like += 2 * np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64) - len(part)
        return cls(exact, like.astype(np.uint32))

    def __add__(self, other: Sum) -> Sum:
        return Sum(self.exact + other.exact, self.like + other.like)

    def __sub__(self, other: Sum) -> Sum:
        return Sum(self.exact - other.exact, self.like - other.like)

    def hex(self) -> str:
        return (self.exact.astype("<u4").tobytes() + self.like.astype("<u4").tobytes()).hex()

    @classmethod
    def from_hex(cls, text: str) -> Sum:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[:4 * EXACT], "<u4").astype(np.uint32), np.frombuffer(raw[4 * EXACT:], "<u4").astype(np.uint32))

    def likeness(self, other: Sum) -> float:
        """1 for equal fingerprints; else 2ab / (aa + bb) of the ``LIKE`` lanes, at least 0."""
        if (self.exact == other.exact).all() and (self.like == other.like).all():
            return 1.0
        a, b = self.like.view(np.int32).astype(np.float64), other.like.view(np.int32).astype(np.float64)
        both = float(a @ a + b @ b)
        return max(0.0, min(1.0, 2.0 * float(a @ b) / both)) if both else 0.0


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for every row (``doc_id``, ``text``; null texts are empty ones)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": [Sum.of(t).hex() for t in pdf["text"]]})

    return texts(docs).mapInPandas(made, "doc_id long, fingerprint string")


def update(fingerprints: DataFrame, changes: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` after ``changes`` (``doc_id``, ``paragraph``, ``sign`` +1 or -1), without the texts.

    Vectors of the changes are summed per document and part of a task first, so many changes of one document spread.
    Changes of unknown documents and with nulls are left out.
    """

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[int, Sum] = {}
            for doc, text, sign in zip(pdf["doc_id"], pdf["paragraph"], pdf["sign"], strict=True):
                was = sums.get(doc, Sum())
                sums[doc] = was + Sum.of(text) if sign > 0 else was - Sum.of(text)
            lanes = [[*s.exact.tolist(), *s.like.tolist()] for s in sums.values()]
            yield pd.DataFrame({"doc_id": list(sums), "lanes": lanes})

    vectors = changes.select("doc_id", "paragraph", "sign").dropna().mapInPandas(signed, "doc_id long, lanes array<long>")
    lanes = [F.sum(F.col("lanes")[i]).alias(f"l{i}") for i in range(EXACT + LIKE)]
    summed = vectors.groupBy("doc_id").agg(*lanes).select("doc_id", F.array(*[f"l{i}" for i in range(EXACT + LIKE)]).alias("lanes"))

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fp, lane in zip(pdf["fingerprint"], pdf["lanes"], strict=True):
                if lane is not None:
                    v = np.asarray(lane, np.int64)
                    fp = (Sum.from_hex(fp) + Sum(v[:EXACT].astype(np.uint32), v[EXACT:].astype(np.uint32))).hex()
                out.append(fp)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": out})

    joined = fingerprints.select("doc_id", "fingerprint").join(summed, "doc_id", "left")
    return joined.mapInPandas(added, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next
    document is the next in ascending (``doc_id``, ``text``), nulls first, and the first one after the last. Ids are
    cut into ranges; the first rows of a range are also sent to the range before, so one shuffle suffices and each
    range streams through its task in order. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("_o", F.coalesce("doc_id", F.lit(-(2**63))))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("_o", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("_o").cast("double"))) if cuts else F.lit(0)
    rows = rows.withColumn("_range", at)
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("_range").agg(F.min("_o")).collect())  # one per range
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    sent = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<long,int>")
    home = F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))
    copy = F.struct(sent[F.col("_o")].alias("r"), F.lit(1).alias("copy"))
    spread = rows.withColumn("_to", F.explode(F.filter(F.array(home, copy), lambda x: x["r"].isNotNull())))
    spread = spread.select("_to.r", "_to.copy", "_o", "doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = spread.repartition(n, "r").sortWithinPartitions("r", "copy", "_o", "text")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (range, doc_id, text, fingerprint, copied)
        for pdf in batches:
            out = []
            for r, copied, doc, text in zip(pdf["r"], pdf["copy"], pdf["doc_id"], pdf["text"], strict=True):
                if last and last[0] == r and last[4] and copied:
                    continue  # only the first copied row follows someone
                own = Sum.of(text)
                if last and last[0] == r and not last[4]:
                    _, doc_was, was, fp, _ = last
                    new = edited(was, text)
                    changed = Sum.of(new)
                    out.append((doc_was, len(was), hashlib.sha256(new.encode()).hexdigest(), fp.hex(), changed.hex(), fp.likeness(changed), fp.likeness(own)))
                last = (r, doc, text, own, copied)
            made = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield made.astype({"doc_id": "Int64"})

    return in_order.mapInPandas(
        pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
