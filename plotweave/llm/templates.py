"""Line deduplication by log templates: a tree of fixed depth over lines.

A line goes down by its number of tokens and then by its first ``DEPTH`` tokens, where tokens with digits, addresses and
links count as variable. In the node it reaches, a token that enough lines share at its place is constant, all
others are variable fields. The pattern of constants and fields is the line's template. Templates that recur in enough
documents, and are constant for at least half of their tokens, are dropped everywhere.

A template's support counts documents by their surroundings: each line of a document is stamped with the smallest hash of the
document's other lines, and equal stamps count once. Boilerplate recurs under different stamps; a document that was
copied many times has the same stamps and keeps its lines for the near-duplicate operators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import cut, slices, table
from plotweave.llm.routing import bit_table, numbered, passes

DEPTH, SUPPORT, CONSTANT = 4, 10, 0.5
FIELD = "<*>"
variable = re.compile(r"\d|://|@").search


def masked(line: str) -> list[str]:
    """Tokens of a line with evident fields replaced."""
    return [FIELD if variable(t) else t for t in line.split()] if variable(line) else line.split()


def node(tokens: list[str], depth: int) -> int:
    """Hash of the tree node: number of tokens and the first ones."""
    return xxhash.xxh3_64_intdigest(" ".join([str(len(tokens)), *tokens[:depth]]).encode()) - 2**63


def stamped(text: str, depth: int) -> list[tuple[int, int, int, list[str]]]:
    """(line number, node, stamp, tokens) of the lines with tokens."""
    rows = [(i, t) for i, line in enumerate(text.split("\n")) if (t := masked(line))]
    lines = [xxhash.xxh3_64_intdigest(" ".join(t).encode()) - 2**63 for _, t in rows]
    two = sorted(set(lines))[:2]
    other = lambda h: two[0] if h != two[0] else two[1] if len(two) > 1 else 0
    return [(i, node(t, depth), other(h), t) for (i, t), h in zip(rows, lines, strict=True)]


def dropped_lines(docs: DataFrame, depth: int = DEPTH, support: int = SUPPORT, constant: float = CONSTANT) -> DataFrame:
    """``d, r, lines``: numbers of the lines of each document (see ``routing.numbered``) that are dropped."""
    rows = numbered(docs)

    def stamps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "text"):
            yield pd.DataFrame([(n, s) for text in pdf["text"] for _, n, s, _ in stamped(text, depth)], columns=["node", "stamp"])

    seen = rows.select("text").mapInPandas(stamps, "node long, stamp long")
    nodes = cut(seen.groupBy("node").agg(F.countDistinct("stamp").alias("n")).filter(F.col("n") >= support).select("node"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(nodes, "node"))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "text"):
            out = [(d, r, *x[:3], xxhash.xxh3_64_intdigest(own := " ".join(x[3])) - 2**63, own) for d, r, text in zip(pdf["d"], pdf["r"], pdf["text"], strict=True) for x in stamped(text, depth)]
            made = pd.DataFrame(out, columns=["d", "r", "line", "node", "stamp", "kind", "tokens"])
            yield made[passes(bits.value, made["node"].to_numpy().astype("int64").view("uint64"))]

    schema = "d long, r long, line int, node long, stamp long, kind long, tokens string"
    found = cut(rows.mapInPandas(lines, schema))
    # from here on a line is the hash of its tokens, its kind; the tokens themselves move once for each kind
    support_of = found.groupBy("node", "kind").agg(F.countDistinct("stamp").alias("n"))
    listed = found.groupBy("node", "kind").agg(F.first("tokens").alias("tokens"))
    token = F.split("tokens", " ")
    own = lambda t, at: F.when(t == FIELD, F.lit(0)).otherwise(F.xxhash64("node", at, t))
    kinds = cut(support_of.join(listed, ["node", "kind"]).withColumn("keys", F.transform(token, own)))
    parts = kinds.select("node", "n", F.posexplode(token).alias("at", "token")).filter(F.col("token") != FIELD)
    common = parts.groupBy("node", "at", "token").agg(F.sum("n").alias("s")).filter(F.col("s") >= support)
    common = cut(common.select("node", "at", "token", F.xxhash64("node", "at", "token").alias("key")))
    known = docs.sparkSession.sparkContext.broadcast(bit_table(common, "key"))

    def may_be_constant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [np.asarray(own, np.int64).view(np.uint64) for own in pdf["keys"]]
            share = [(passes(known.value, k) & (k != 0)).mean() for k in keys]
            yield pdf.loc[np.array(share, np.float64) >= constant, ["node", "kind", "tokens"]]

    # most lines of a node have few tokens that recur: they are settled before anything is joined
    likely = kinds.select("node", "kind", "tokens", "keys").mapInPandas(may_be_constant, "node long, kind long, tokens string")
    fields = likely.select("node", "kind", F.posexplode(token).alias("at", "token"))
    marked = fields.join(common.select("node", "at", "token", F.lit(1).alias("same")), ["node", "at", "token"], "left")
    shown = F.struct("at", F.when(F.col("same") == 1, F.xxhash64("token")).alias("t"))
    template = marked.groupBy("node", "kind").agg(
        F.sort_array(F.collect_list(shown)).alias("parts"), F.avg(F.coalesce("same", F.lit(0))).alias("share")
    ).select("node", "kind", "share", F.xxhash64("parts").alias("template"))
    template = cut(template.filter(F.col("share") >= constant).drop("share"))
    lines_of = found.select("node", "kind", "stamp").join(template, ["node", "kind"])
    recurring = lines_of.groupBy("node", "template").agg(F.countDistinct("stamp").alias("s")).filter(F.col("s") >= support)
    gone = template.join(recurring, ["node", "template"]).select("node", "kind")
    return cut(found.join(gone, ["node", "kind"]).groupBy("d", "r").agg(F.collect_set("line").alias("lines")))


def drop_lines(docs: DataFrame, depth: int = DEPTH, support: int = SUPPORT, constant: float = CONSTANT) -> DataFrame:
    """All columns of ``docs`` with ``text`` less the dropped lines, and ``n_lines``, ``n_removed``.

    Lines end at line feeds; lines without tokens stay. A null text has one line, stays null and loses none. A text that
    loses all its lines becomes empty. Texts are read whole. Repeated rows share their decisions, ids may be null, all other
    columns are carried along but ``n_lines`` and ``n_removed``, which are made anew. Empty in, empty out.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = dropped_lines(docs, depth, support, constant).select(*[F.col(c).alias(f"_gone_{c}") for c in ("d", "r", "lines")])
    keyed = docs.select(*own, F.coalesce("doc_id", F.lit(-(2**63))).alias("_gone_d"), F.xxhash64(text).alias("_gone_r"))
    touched = docs.sparkSession.sparkContext.broadcast(bit_table(gone.select(F.xxhash64("_gone_d", "_gone_r").alias("key")), "key"))

    @F.pandas_udf("boolean")
    def may_lose(key: pd.Series) -> pd.Series:
        return pd.Series(passes(touched.value, key.to_numpy().astype("int64").view("uint64")))

    # only documents that lose lines are shuffled, and in the same way at every size
    loses = may_lose(F.xxhash64("_gone_d", "_gone_r"))
    joined = keyed.filter(loses).join(gone.hint("merge"), ["_gone_d", "_gone_r"], "left").select(*own, "_gone_lines")
    joined = joined.union(keyed.filter(~loses).select(*own, F.lit(None).cast("array<int>").alias("_gone_lines")))
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda x, i: ~F.array_contains("_gone_lines", i))
    left = F.when(F.col("_gone_lines").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[left.alias("text") if c == "text" else F.col(c) for c in own],
        F.coalesce(F.size(split), F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone_lines"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
