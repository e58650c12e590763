"""SimHash near-duplicates: vantage-point trees over fingerprints.

Two fingerprints within ``k`` bits agree within ``r`` bits on at least one of several bit bands if the (r + 1) add up
to more than ``k``. For every band a tree of vantage points, built from a bounded sample, divides all distinct
fingerprints into shards by their Hamming distance on the band. A fingerprint lives in one shard and visits those the
triangle inequality can't exclude: behind a vantage point at distance d it looks on both sides of the border m where
d - r <= m < d + r. Inside a shard a further tree prunes on the whole fingerprint; what remains is compared exactly.
A shard returns a spanning forest of its links, never all pairs, so large groups of near copies stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import cut, drawn, slices, table, texts
from plotweave.llm.jaccard import Words, identity, shingle_sets, verified, whole_sets
from plotweave.operators.iterative import components

SHINGLE, DISTANCE, BITS = 4, 4, 64
#: Fingerprints in the sample that the trees are built from (in the mean), and those aimed at in a shard.
SAMPLE, SHARD = 65_536, 512
#: Rows of either side of a shard in one task; larger shards are cut into blocks that all meet.
SIDE = 4096


def simhash(text: str, words: int = SHINGLE) -> int:
    """64-bit SimHash of the ``words``-word shingles (ASCII lower-cased), as a signed number; 0 without words."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(words, len(parts)) - 1:] - 1).tolist()
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], ">u8")
    count = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        count += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` for every row; null texts have no words."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "text"):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": [simhash(t, words) for t in pdf["text"]]})

    return texts(docs).mapInPandas(made, "doc_id long, fp long")


def bands(k: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(mask, radius) of disjoint bit bands with the (radius + 1) adding up to ``k + 1``: one wide band of radius 1
    and narrow ones of radius 0."""
    radii = [1] + [0] * (k - 1) if k else [0]
    share = [r + 4 if r else 3 for r in radii]
    edges = np.round(np.cumsum([0, *share]) * bits / sum(share)).astype(int)
    return [(((1 << int(b - a)) - 1) << int(a), r) for a, b, r in zip(edges[:-1], edges[1:], radii, strict=True)]


class Tree:
    """Vantage points over ``sample``; nodes are (vantage, border, near, far), shards negative numbers."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, shards: int):
        self.mask, self.radius, self.nodes, self.shards = np.uint64(mask), radius, [], 0
        self.root = self._grow(sample & self.mask, shards)

    def _leaf(self) -> int:
        self.shards += 1
        return -self.shards

    def _grow(self, points: np.ndarray, shards: float) -> int:
        if shards < 1.5 or len(points) < 8:
            return self._leaf()
        best = None
        for v in points[:: max(1, len(points) // 8)][:8]:
            d = np.bitwise_count(points ^ v)
            m = int(np.median(d))
            for border in (m - 1, m):
                near = float((d <= border).mean())
                # few points near the border, halves of like size
                worth = near * (1 - near) * (1 - float(((d > border - self.radius) & (d <= border + self.radius)).mean()) / 2)
                if best is None or worth > best[0]:
                    best = (worth, v, border, d)
        worth, v, border, d = best
        if not worth:
            return self._leaf()
        at, near = len(self.nodes), float((d <= border).mean())
        self.nodes.append(None)
        self.nodes[at] = (v, border, self._grow(points[d <= border], shards * near), self._grow(points[d > border], shards * (1 - near)))
        return at

    def visits(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, rows that visit it, whether they live there)."""
        open_ = [(self.root, np.arange(len(fps)), np.ones(len(fps), bool))]
        own = fps & self.mask
        while open_:
            node, rows, home = open_.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node, rows, home
                continue
            v, border, near, far = self.nodes[node]
            d = np.bitwise_count(own[rows] ^ v).astype(np.int16)
            a, b = d - self.radius <= border, d + self.radius > border
            open_ += [(near, rows[a], home[a] & (d[a] <= border)), (far, rows[b], home[b] & (d[b] > border))]


def _pairs(home: np.ndarray, visitors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in home, in visitors) within ``k`` bits: a vantage-point tree down to blocks of some hundred."""
    open_ = [(np.arange(len(home)), np.arange(len(visitors)))]
    while open_:
        a, b = open_.pop()
        if not len(a) or not len(b):
            continue
        if len(a) > 256:
            v = home[a[len(a) // 2]]
            da, db = np.bitwise_count(home[a] ^ v).astype(np.int16), np.bitwise_count(visitors[b] ^ v).astype(np.int16)
            m = int(np.median(da))
            m = m if (da <= m).mean() < 0.9 else m - 1
            if 0.1 < (da <= m).mean() < 0.9:
                open_ += [(a[da <= m], b[db <= m + k]), (a[da > m], b[db > m - k])]
                continue
        for at in range(0, len(a), 256):
            part = a[at:at + 256]
            i, j = np.nonzero(np.bitwise_count(home[part][:, None] ^ visitors[b][None, :]) <= k)
            yield part[i], b[j]


def _forest(values: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position in the component of each position."""
    label = np.arange(len(values))
    for i, j in found:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (label[label] != label).any():
                label = label[label]
    return label


def links(points: DataFrame, k: int = DISTANCE) -> DataFrame:
    """``src, dst``: links that connect the same fingerprints as all pairs within ``k`` bits. ``points`` has distinct ``fp``."""
    spark = points.sparkSession
    n = points.count()
    sample = drawn(points, n, SAMPLE, "fp").select("fp").toArrow()["fp"].to_numpy().view(np.uint64)
    shards = min(n / SHARD, len(sample) / 8)
    forest = spark.sparkContext.broadcast([Tree(sample, mask, radius, shards) for mask, radius in bands(k)])

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy().astype(np.int64)
            for band, tree in enumerate(forest.value):
                found = list(tree.visits(fps.view(np.uint64)))
                if found:
                    shard = np.repeat([s for s, _, _ in found], [len(r) for _, r, _ in found]).astype(np.int32)
                    rows = np.concatenate([r for _, r, _ in found])
                    yield pd.DataFrame({"band": np.int32(band), "shard": shard, "fp": fps[rows], "home": np.concatenate([h for _, _, h in found])})

    # few bytes turn into much work, so a handful of files must not become a handful of tasks
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(points.select("fp").repartition(spread, "fp").mapInPandas(routed, "band int, shard int, fp long, home boolean"))
    side = F.lit(SIDE)
    sizes = rows.groupBy("band", "shard").agg(F.count(F.lit(1)).alias("_all"), F.sum(F.col("home").cast("long")).alias("_home"))
    sizes = sizes.filter("_all > 1 AND _home > 0").select(
        "band", "shard", F.ceil(F.col("_home") / side).cast("int").alias("_nh"), F.ceil(F.col("_all") / side).cast("int").alias("_nv")
    )
    block = lambda of: F.pmod(F.xxhash64("fp"), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    sized = rows.join(sizes, ["band", "shard"])
    lives = sized.filter("home").select("band", "shard", "fp", F.lit(True).alias("home"), block("_nh").alias("h"), F.explode(every("_nv")).alias("v"))
    comes = sized.select("band", "shard", "fp", F.lit(False).alias("home"), F.explode(every("_nh")).alias("h"), block("_nv").alias("v"))

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().astype(np.int64)
        values, place = np.unique(fps, return_inverse=True)
        is_home = pdf["home"].to_numpy(bool)
        a, b = np.unique(place[is_home]), np.unique(place[~is_home])
        u = values.view(np.uint64)
        label = _forest(values, ((a[i], b[j]) for i, j in _pairs(u[a], u[b], k)))
        far = label != np.arange(len(values))
        return pd.DataFrame({"src": values[label[far]], "dst": values[far]})

    grouped = lives.union(comes).groupBy("band", "shard", "h", "v")
    return grouped.applyInPandas(joined, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, k: int = DISTANCE, words: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs`` (``doc_id``, ``text``).

    Null and wordless texts have fingerprint zero and are linked like any other. ``component_id`` is the smallest
    ``doc_id`` that is reachable by links (null only if all of the component are null). Repeated rows stay, other
    columns are ignored, an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, words))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = cut(links(points, k))
    linked = edges.select(F.col("src").alias("fp")).union(edges.select("dst")).distinct()
    parts = components(linked, edges, "fp")
    labelled = points.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    found = labelled.select("fp", "component").join(least, "component").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# --- wide fingerprints, for a similarity instead of a distance --------------------------------------
#: Bits of a wide fingerprint, bits of a band, and bands that are searched.
WIDE, BAND, BANDS = 320, 11, 24
#: Bits that all pairs of a shard are compared on first, and standard deviations allowed beyond the expected distance.
FIRST, SLACK = 128, 5.0
#: Texts aimed at in a shard.
WIDE_SHARD = 1024
#: Bins of the shingles' parities.
BINS = 1024


def distance_at(similarity: float, bits: int = WIDE) -> int:
    """Differing bits up to which two texts may have this Jaccard similarity of their shingle sets."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + SLACK * np.sqrt(bits * p * (1 - p))))


def wide_simhash(own: np.ndarray) -> bytes:
    """``WIDE``-bit SimHash of a set of hashes (none: zeros)."""
    count = np.zeros(WIDE, np.int64)
    salts = (np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[None, :]
    for at in range(0, len(own), 1 << 14):
        x = own[at:at + (1 << 14), None] ^ salts
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(31)
        count += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(own)).tobytes()


def parities(own: np.ndarray) -> bytes:
    """``BINS`` bits, each the parity of the hashes in a bin: two sets differ in at least as many hashes as bits."""
    return np.packbits(np.bincount(own >> np.uint64(54), minlength=BINS) & 1 == 1).tobytes()


def _band(sigs: np.ndarray, band: int) -> np.ndarray:
    """Bits of one band of each fingerprint (rows of bytes) as numbers."""
    bits = np.unpackbits(sigs, axis=1)[:, band * BAND:(band + 1) * BAND]
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(BAND, dtype=np.uint64))


class Shards:
    """Vantage-point trees, one a band, and the sizes of their large shards."""

    def __init__(self, points: DataFrame):
        spark = points.sparkSession
        n = points.count()
        known = _rows(drawn(points, n, SAMPLE // 4, "sid").select("sig").toArrow()["sig"].to_pylist())
        shards = min(n / WIDE_SHARD, len(known) / 8)
        self.forest = spark.sparkContext.broadcast([Tree(_band(known, i), (1 << BAND) - 1, 0, shards) for i in range(BANDS)])

    def homes(self, sigs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Shard of each fingerprint, for each band."""
        for i, tree in enumerate(self.forest.value):
            at = np.zeros(len(sigs), np.int32)
            for shard, rows, _ in tree.visits(_band(sigs, i)):
                at[rows] = shard
            yield i, at

    def candidates(self, points: DataFrame, percent: int, nearest: bool) -> DataFrame:
        """``src, dst`` that meet in a shard, differ in ``part`` and may be similar by size, fingerprint and parities.

        ``points``: ``sid, n, part, sig, bits``. ``nearest`` keeps only the likeliest partner of each row in a shard.
        """
        spark, homes = points.sparkSession, self.homes
        most, most_first = distance_at(percent / 100), distance_at(percent / 100, FIRST)
        spread = points.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sid")

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i, at in homes(_rows(pdf["sig"])):
                    shard, size = np.unique(at, return_counts=True)
                    yield pd.DataFrame({"band": np.int32(i), "shard": shard, "n": size})

        sizes = spread.mapInPandas(counted, "band int, shard int, n long").groupBy("band", "shard").agg(F.sum("n").alias("n"))
        large = {(r[0], r[1]): -(-r[2] // SIDE) for r in sizes.filter(F.col("n") > SIDE).collect()}  # at most all shards of all trees

        def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids = pdf["sid"].to_numpy().astype(np.int64)
                for band, shard in homes(_rows(pdf["sig"])):
                    blocks = np.array([large.get((band, s), 1) for s in shard.tolist()])
                    row = np.repeat(np.arange(len(ids)), blocks)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    mine = (ids.view(np.uint64) % blocks.astype(np.uint64)).astype(np.int64)[row]
                    place = {"band": np.int32(band), "shard": shard[row], "a": np.minimum(mine, other).astype(np.int32), "b": np.maximum(mine, other).astype(np.int32)}
                    yield pd.DataFrame({**place, **{c: pdf[c].to_numpy()[row] for c in ("sid", "n", "part", "sig", "bits")}})

        def met(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("n", kind="stable")
            sig, bits = _rows(pdf["sig"]).view(np.uint64), _rows(pdf["bits"], BINS).view(np.uint64)
            ids, n, part = (pdf[c].to_numpy().astype(np.int64) for c in ("sid", "n", "part"))
            out = []
            for at in range(0, len(ids), 128):
                i = np.arange(at, min(at + 128, len(ids)))
                j = np.arange(*np.searchsorted(n, [-(-n[i[0]] * percent // 100), n[i[-1]] * 100 // percent + 1]))
                may = (part[i][:, None] != part[j][None, :]) & (np.minimum(n[i][:, None], n[j]) * 100 >= np.maximum(n[i][:, None], n[j]) * percent)
                apart = np.zeros(may.shape, np.int16)
                for w in range(FIRST // 64):
                    apart += np.bitwise_count(sig[i, w][:, None] ^ sig[j, w][None, :])
                x, y = np.nonzero(may & (apart <= most_first))
                x, y = i[x], j[y]
                ok = np.bitwise_count(sig[x] ^ sig[y]).sum(axis=1, dtype=np.int64) <= most
                x, y = x[ok], y[ok]
                odd = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                ok = odd <= (n[x] + n[y]) * (100 - percent) // (100 + percent)
                x, y, odd = x[ok], y[ok], odd[ok]
                if nearest:
                    order = np.lexsort((odd, x))
                    first = order[np.concatenate([[True], x[order][1:] != x[order][:-1]])] if len(x) else order
                    x, y = x[first], y[first]
                out.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], axis=1))
            return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["src", "dst"])

        schema = "band int, shard int, a int, b int, sid long, n long, part long, sig binary, bits binary"
        rows = spread.mapInPandas(routed, schema)
        return rows.groupBy("band", "shard", "a", "b").applyInPandas(met, "src long, dst long").distinct()


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, component_id`` of every row of ``docs``: groups of texts whose shingle sets have a Jaccard similarity of
    ``percent`` or more, joined by chains.

    No tree can prune at such distances on all bits of a wide fingerprint, so trees divide by one band each, where
    similar texts often agree whole; a pair at the limit misses all ``BANDS`` bands about once in 75, at 0.85 once in
    1,000. In a shard pairs must pass a wide margin on the fingerprints and a bound on the difference (parities of the shingles), and the
    whole shingle sets decide. A first round takes the likeliest partner of each text, which joins large families; a second one
    all pairs between different components, of the texts that had a partner at all. Large shards are cut into blocks that all meet.

    Empty sets (null and wordless texts) are one group, repeated rows and equal texts too; ``component_id`` is null only
    if all ids of the group are. Texts are taken whole, an empty table gives an empty result.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for pdf in slices(batches, "text"):
            sets = list(shingle_sets(pdf["text"].tolist(), words, known))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "sid": [identity(s) for s in sets], "n": [len(s) for s in sets],
                "sig": [wide_simhash(s) for s in sets], "bits": [parities(s) for s in sets],
            })

    prints = cut(texts(docs).mapInPandas(made, "doc_id long, sid long, n long, sig binary, bits binary"))
    points = prints.groupBy("sid").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "sig", "bits")])
    points = cut(points.withColumn("part", F.col("sid")))
    first = cut(Shards(points).candidates(points.filter("n > 0"), percent, True))
    some = cut(first.select(F.col("src").alias("sid")).union(first.select("dst")).distinct())
    sets = cut(whole_sets(docs, some, words, percent))
    found = cut(verified(first, sets, percent))
    parts = _components(found).withColumnRenamed("component", "_part")
    left = points.join(some, "sid", "left_semi").join(parts, "sid", "left").withColumn("part", F.coalesce("_part", "sid")).drop("_part")
    left = cut(left)
    more = Shards(left).candidates(left, percent, False).join(first, ["src", "dst"], "left_anti")
    found = found.union(cut(verified(more, sets, percent)))
    labelled = points.select("sid", "least").join(_components(found), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    labelled = cut(labelled)
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.select("sid", "component").join(least, "component").select("sid", "component_id")
    return prints.select("doc_id", "sid").join(named, "sid").select("doc_id", "component_id")


def _components(found: DataFrame) -> DataFrame:
    return components(found.select(F.col("src").alias("sid")).union(found.select("dst")).distinct(), found, "sid")


def _rows(sigs, bits: int = WIDE) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, sigs)), np.uint8).reshape(-1, bits // 8)
