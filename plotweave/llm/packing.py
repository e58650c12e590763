"""Best-fit packing planned on a length histogram.

Documents become pieces of at most ``limit`` tokens. The planner sees only how many pieces there are of each length:
best-fit decreasing runs over whole groups of equally filled sequences, so its work depends on ``limit`` and not on
the number of documents. Its plan says, per length, which sequences its slots 0, 1, 2, ... lie in. Pieces then
take slots by an equality join on (length, block of ranks) with their rank within their length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.llm.common import cut, slices, table, texts
from plotweave.llm.tokens import PATTERN, TOKENIZER

LIMIT = 2048
END = (0).to_bytes(4, "little")
#: Ranks in one block of the join with the plan.
BLOCK = 4096


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file, with ids in the order of its merges: same ids, no objects per token."""
    with open(path) as f:
        listed = json.load(f)
    # byte-level vocabularies show printable bytes as themselves and the others as the characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in listed["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in listed["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: ids of each document and a final 0, cut from the end into
    pieces of ``limit``, so that only the first piece can be shorter. A null text is an empty one: a single 0."""
    path = path or public_tokenizers.path(TOKENIZER)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_to_numpy
        for pdf in slices(batches, "text"):
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                all_ids = encode(text, allowed_special="all").astype("<u4").tobytes() + END
                n = len(all_ids) // 4
                at, piece = 0, 0
                while at < n:
                    to = at + ((n - at - 1) % limit + 1 if piece == 0 else limit)
                    out.append((doc, piece, at, to - at, zlib.crc32(all_ids[4 * at:4 * to])))
                    at, piece = to, piece + 1
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """``(length, first, count, sequence, offset)``: the slots ``first`` .. ``first + count - 1`` of a length lie at
    ``offset`` of as many sequences in a row, starting with ``sequence``.

    Best-fit decreasing. All sequences with the same free room form stacks of consecutive numbers; a stack takes a
    length as a whole or is split once, so each length adds at most one stack for each room it empties.
    """
    stacks: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    total = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if not stacks.get(room):
                insort(rooms, room)
            stacks.setdefault(room, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, used = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = stacks[room].pop()
                if not stacks[room]:
                    del rooms[at]
            else:
                room, first, count = limit, total, max(1, left // (limit // length))
                total += count
            each = min(room // length, left)
            filled = min(count, left // each)
            for i in range(each):
                out.append((length, used, filled, first, limit - room + i * length))
                used += filled
            left -= each * filled
            put(room, first + filled, count - filled)
            put(room - each * length, first, filled)
    return out


def _ranked(pieces: DataFrame, most: int) -> DataFrame:
    """Rank (from 0) of each piece within its length. Ranks are taken inside (length, block) groups and shifted by the
    sizes of the blocks before. With the root of the commonest length's count as the number of blocks, neither the
    groups nor the lists of blocks get long when a third of all pieces have one length."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    blocks = pieces.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(isqrt(most) + 1)))
    sizes = blocks.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    inside = Window.partitionBy("length", "_b").orderBy(*order)
    ranked = blocks.withColumn("_r", F.row_number().over(inside) - 1).join(sizes, ["length", "_b"])
    return ranked.withColumn("_rank", F.col("_at") + F.col("_r")).drop("_b", "_r", "_at")


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Pieces need ``doc_id, piece, start, length, ids_crc32`` and
    lengths from 1 to ``limit``; equal rows take different slots. Empty in, empty out."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``limit`` rows
    slots = plan(histogram, limit)
    frame = spark.createDataFrame(
        pd.DataFrame(slots, columns=["length", "first", "n", "sequence", "offset"]).astype("int64"),
        "length long, first long, n long, sequence long, offset long",
    )
    # a run of slots is listed under every block of ranks it reaches into
    runs = frame.withColumn("_k", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK))))
    ranked = _ranked(pieces, max(histogram.values(), default=1)).withColumn("_k", F.floor(F.col("_rank") / BLOCK))
    hit = (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("n"))
    return ranked.join(runs, ["length", "_k"]).filter(hit).select(
        *pieces.columns, (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Packs whole documents (``doc_id``, ``text``): one row per piece, see ``token_pieces`` and ``pack``.

    Null ``doc_id`` and repeated rows are packed like any other row; other columns are ignored.
    """
    return pack(cut(token_pieces(docs, path, limit)), limit)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
