"""N-gram Jaccard join: exact similarity of shingle sets by partitions of the universe.

Sets are split into bands of size, so that linked sets lie in one band or in neighbouring ones. A band's partition
hashes every shingle into one of ``m`` segments. Two sets that link differ in at most ``H`` shingles, so at most ``H``
segments differ: of any ``H + 1`` segments of a set, its partner has one alike. Every non-empty segment is indexed by
a signature of its subset.

Which ``H + 1`` segments a set probes is decided by cost: the segments with the fewest other sets go first, those
nobody else has cost nothing, and a set whose recurring segments are too few to reach a link drops out. Sets that have
too many empty segments allocate two differences' worth to segments: they index each subset and its one-deletion
neighbourhood too, in a space of their own (a pair with one other set was found by that one's segments).

Each signature first compares its members with one leader, which joins large families in one pass. Only members of
different components meet then, in blocks. All sets list their segments in one order (cheapest first), so a pair meets
where both probe. There the parities of their shingles in some hundred bins bound the difference from below, and
what passes is verified on the whole shingle sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.llm.common import cut, slices, table, texts
from plotweave.operators.iterative import components

WORDS, PERCENT = 5, 80
#: Characters of text whose signatures make one group of the search for recurring ones.
GROUP_CHARS = 8_000_000
#: Members of one signature in a block; the blocks of larger ones all meet.
BLOCK = 2048
#: Members of a group whose pairs are taken by their distance in it, for all such groups at once.
FEW = 24
#: Bits below a signature's hash: band and kind (0: subset, 1: subset or one-deletion subset of a set with few segments).
BAND_BITS, KIND = 8, 1 << 8

# fixed values: odd multipliers of the mixing function
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[2]
    return x ^ (x >> np.uint64(32))


def _next(own: np.ndarray, word: np.ndarray) -> np.ndarray:
    own = (own ^ word) * MIX[0]
    own ^= own >> np.uint64(29)
    return own


class Words(dict):
    """Hashes of words, kept for the common ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(found: list[str], words: int, known: Words) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct ``words``-word shingles of each text (A-Z lowered; fewer words: the whole sequence)."""
    split = [t.encode().lower().split() for t in found]
    size = np.fromiter(map(len, split), np.int64, len(split))
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, int(size.sum()))
    whole = max(0, len(h) - words + 1)
    own = np.full(whole, words, np.uint64)
    for k in range(words):
        own = _next(own, h[k:k + whole])
    at = 0
    for n in size.tolist():
        if n >= words:
            yield np.unique(own[at:at + n - words + 1])
        elif n:
            one = np.array([n], np.uint64)
            for k in range(n):
                one = _next(one, h[at + k:at + k + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)
        at += n


class Bands:
    """Bands of set sizes at a similarity: ``H`` and ``m`` of each. A band serves pairs whose smaller set lies in it."""

    def __init__(self, percent: int):
        starts = [1]
        while starts[-1] < 1 << 36:
            starts.append(starts[-1] * 100 // percent + 1)
        self.starts = starts
        most = [b - 1 for b in starts[1:]]
        self.differ = [(a + a * 100 // percent) * (100 - percent) // (100 + percent) for a in most]
        self.segments = [h + 1 + (-(-15 * (h + 1) // 100) if h >= 4 else 0) for h in self.differ]
        self.places: dict[int, tuple] = {}
        assert len(starts) < 1 << BAND_BITS, "similarity too high for the bits of a band"

    def signatures(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(signatures, non-empty segments) of set ``s`` in its own band and in the one below."""
        own = bisect_right(self.starts, len(s)) - 1
        for band in (own, own - 1):
            if band < 0 or not self.differ[band]:
                continue  # only equal sets link
            h, m = self.differ[band], self.segments[band]
            if band not in self.places:
                salt = mixed(np.array([band + 1], np.uint64) * MIX[0])
                self.places[band] = salt[0], mixed(np.arange(1, m + 1, dtype=np.uint64) * MIX[0] + salt)
            salt, place = self.places[band]
            value = (s ^ salt) * MIX[1]  # the hashes are mixed already
            value ^= value >> np.uint64(32)
            segment = (((value >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            total, count = np.zeros(m, np.uint64), np.bincount(segment, minlength=m)
            np.add.at(total, segment, value)
            full = np.flatnonzero(count)
            subset = total[full] ^ place[full]
            out = [_signature(subset, band)]
            if len(full) <= h:
                out.append(_signature(subset, band | KIND))
                rest = count[segment] > 1
                less = (total[segment[rest]] - value[rest]) ^ place[segment[rest]]
                out.append(np.unique(_signature(less, band | KIND)))
                if int(np.minimum(count[full], 2).sum()) <= h:
                    out.append(_signature(place[:1], band | KIND))  # no allocation suffices: these all meet
            yield np.concatenate(out), len(full)

    def parities(self, s: np.ndarray) -> tuple[bytes, bytes]:
        """Bits of bins with an odd number of shingles, for the set's own band and the one below: two sets differ in
        at least as many shingles as bits. A band has about 8 bins for each shingle that may differ."""
        own = bisect_right(self.starts, len(s)) - 1
        out = []
        for band in (own, own - 1):
            bins = 64 * (1 + max(0, self.differ[max(band, 0)]) // 8)
            at = ((mixed(s) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            out.append(np.packbits((np.bincount(at, minlength=bins) & 1).astype(bool)).tobytes())
        return out[0], out[1]


def _signature(x: np.ndarray, low: int) -> np.ndarray:
    return (mixed(x) & ~np.uint64((1 << (BAND_BITS + 1)) - 1)) | np.uint64(low)


def identity(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


PARTS = "doc_id long, sid long, n long, group long, sig binary, sids binary, sizes binary, full binary"


def _parts(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One pass over the texts. Rows without ``group``: ``doc_id, sid, n``, identity and size of each row's set (an
    empty set has no identity). Rows with it: packed signatures for the search of recurring ones.

    A batch sends a signature on only once, packed with others of its group; those that recur inside the batch are
    known to be shared and need no search. So a signature that a third of all texts have stays small in every group.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, chars // GROUP_CHARS)
    names = [c.split()[0] for c in PARTS.split(", ")]

    def packed(group: int, *columns: np.ndarray) -> tuple:
        return (None, None, None, group, *[c.tobytes() for c in columns])

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bands = Words(), Bands(percent)
        for pdf in slices(batches, "text"):
            sig, row, out, seen = [], [], [], set()
            for doc, s in zip(pdf["doc_id"], shingle_sets(pdf["text"].tolist(), words, known), strict=True):
                sid = identity(s) if len(s) else None
                out.append((doc, sid, len(s), *[None] * 5))
                if sid is not None and sid not in seen:
                    seen.add(sid)
                    for own, full in bands.signatures(s):
                        sig.append(own)
                        row.append((len(own), sid, len(s), full))
            columns = [np.concatenate([np.zeros(0, np.uint64), *sig])]
            columns += [np.repeat(np.array([r[k] for r in row], np.int64), [r[0] for r in row]) for k in (1, 2, 3)]
            _, first, place, times = np.unique(columns[0], return_index=True, return_inverse=True, return_counts=True)
            again = times[place] > 1
            if again.any():
                out.append(packed(-1 - int(columns[1][0] % groups), *[c[again] for c in columns]))
            first.sort()  # by text: repeated numbers pack well
            to = ((columns[0][first] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(groups + 1))
            for g in range(groups):
                if ends[g] < ends[g + 1]:
                    out.append(packed(g, *[c[first[order[ends[g]:ends[g + 1]]]] for c in columns]))
            made = zip(*out, strict=True) if out else [[]] * len(names)
            yield pd.DataFrame({c: pd.array(list(v), "Int64" if k < 4 else object) for k, (c, v) in enumerate(zip(names, made, strict=True))})

    return texts(docs).mapInPandas(searched, PARTS)


def shared_signatures(parts: DataFrame) -> DataFrame:
    """``sig, sid, n, full``: signatures that several different sets have, with each set's size and non-empty segments."""
    kinds = {"sig": np.uint64, "sids": np.int64, "sizes": np.int64, "full": np.int64}

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {c: np.frombuffer(b"".join(pdf[c]), t) for c, t in kinds.items()}
        if pdf["group"].iloc[0] >= 0:
            order = np.lexsort((made["sids"], made["sig"]))
            sig, sid = made["sig"][order], made["sids"][order]
            new = np.ones(len(order), bool)
            new[1:] = sig[1:] != sig[:-1]
            distinct = new.copy()
            distinct[1:] |= sid[1:] != sid[:-1]
            order, group = order[distinct], (np.cumsum(new) - 1)[distinct]
            order = order[np.bincount(group)[group] > 1]
            made = {c: v[order] for c, v in made.items()}
        made["sig"] = made["sig"].view(np.int64)
        return pd.DataFrame(made).rename(columns={"sids": "sid", "sizes": "n"})

    rows = parts.filter("group IS NOT NULL").select("group", *kinds)
    return rows.groupBy("group").applyInPandas(shared, "sig long, sid long, n long, full long").distinct()


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int, percent: int) -> DataFrame:
    """``sid, hashes, own, below`` of the sets in ``wanted``, with their parities; a task sends each set on once a batch."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for pdf in slices(batches, "text"):
            own = {identity(s): s for s in shingle_sets(pdf["text"].tolist(), words, known) if len(s)}
            yield pd.DataFrame({"sid": list(own), "hashes": [s.tobytes() for s in own.values()]})

    def with_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(percent)
        for pdf in batches:
            bits = [bands.parities(np.frombuffer(s, np.uint64)) for s in pdf["hashes"]]
            yield pdf.assign(own=[b[0] for b in bits], below=[b[1] for b in bits])

    rows = texts(docs).mapInPandas(made, "sid long, hashes binary")
    found = rows.join(wanted, "sid", "left_semi").dropDuplicates(["sid"])
    return found.mapInPandas(with_bins, "sid long, hashes binary, own binary, below binary")


def _whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The rows, which come sorted by ``key``, in frames that hold whole groups."""
    held = None
    for pdf in batches:
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        first = int((rows[key] == rows[key].iloc[-1]).all(axis=1).to_numpy().argmax())
        held = rows.iloc[first:]
        if first:
            yield rows.iloc[:first]
    if held is not None:
        yield held


def _differing(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the byte strings ``bits[i]`` and ``bits[j]``, of one length each pair, differ."""
    out = np.zeros(len(i), np.int64)
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    for w in np.unique(width[i]).tolist():
        rows = np.flatnonzero(width == w)
        wide = np.frombuffer(b"".join(bits[rows]), np.uint64).reshape(len(rows), -1)
        place = np.zeros(len(bits), np.int64)
        place[rows] = np.arange(len(rows))
        of = np.flatnonzero(width[i] == w)
        step = max(1, (1 << 22) // w)
        for at in range(0, len(of), step):
            part = of[at:at + step]
            out[part] = np.bitwise_count(wide[place[i[part]]] ^ wide[place[j[part]]]).sum(axis=1)
    return out


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """``src, dst`` of different components that share a signature, are of like size and may be similar by ``bits``.

    ``rows``: ``sig, sid, n, component, size, bits``.
    """
    blocks = F.ceil(F.col("size") / BLOCK)
    mine = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    spread = rows.withColumn("mine", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    spread = spread.select("sig", F.least("mine", "_o").alias("a"), F.greatest("mine", "_o").alias("b"), "mine", "sid", "n", "component", "bits")
    key = ["sig", "a", "b"]

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, key):
            sig, a, b, sid, n, part = (rows[c].to_numpy(np.int64) for c in (*key, "sid", "n", "component"))
            first, bits = rows["mine"].to_numpy() == a, rows["bits"].to_numpy()
            new = np.ones(len(rows), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group, start = np.cumsum(new) - 1, np.flatnonzero(new)
            size = np.diff([*start, len(rows)])

            def may(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                ok = (part[i] != part[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
                i, j = i[ok], j[ok]
                ok = _differing(bits, i, j) <= (n[i] + n[j]) * (100 - percent) // (100 + percent)
                return i[ok], j[ok]

            small = size[group] <= FEW
            met_ = []
            for apart in range(1, int(min(FEW, size.max()))):
                at = np.flatnonzero(small[apart:] & (group[apart:] == group[:-apart]))
                met_.append(may(at, at + apart))
            for g in np.flatnonzero(size > FEW).tolist():
                own = np.arange(start[g], start[g] + size[g])
                one, two = (own[first[own]], own[~first[own]]) if a[own[0]] != b[own[0]] else (own, own)
                order = np.argsort(n[two], kind="stable")
                two = two[order]
                for at in range(0, len(one), 64):
                    i = one[at:at + 64]
                    lo, hi = np.searchsorted(n[two], [-(-n[i].min() * percent // 100), n[i].max() * 100 // percent + 1])
                    met_.append(may(np.repeat(i, hi - lo), np.tile(two[lo:hi], len(i))))
            i, j = (np.concatenate([m[k] for m in met_]) if met_ else np.zeros(0, np.int64) for k in (0, 1))
            yield pd.DataFrame({"src": np.minimum(sid[i], sid[j]), "dst": np.maximum(sid[i], sid[j])}).drop_duplicates()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(parts, *key).sortWithinPartitions(*key).mapInPandas(met, "src long, dst long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``src, dst``: the ``pairs`` whose sets are similar, by their whole sets."""

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pdf.loc[keep, ["src", "dst"]]

    one = pairs.join(sets.select(F.col("sid").alias("src"), F.col("hashes").alias("x")), "src")
    both = one.join(sets.select(F.col("sid").alias("dst"), F.col("hashes").alias("y")), "dst")
    return both.select("src", "dst", "x", "y").mapInPandas(alike, "src long, dst long")


def _fits(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def links(docs: DataFrame, parts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(``src, dst`` of links between identities of sets; ``sid, component`` of linked ones): they connect the same
    sets as all pairs whose similarity is ``percent`` or more."""
    bands = Bands(percent)
    low = (1 << BAND_BITS) - 1
    differ = F.element_at(F.array(*[F.lit(h) for h in bands.differ]), F.col("sig").bitwiseAND(low).cast("int") + 1)
    plain = F.col("sig").bitwiseAND(KIND) == 0
    rows = cut(shared_signatures(parts))
    space = F.col("sig").bitwiseAND(low | KIND).alias("space")
    count = rows.groupBy("sid", space).agg(F.count(F.lit(1)).alias("shared"))
    rows = rows.withColumn("space", space).join(count, ["sid", "space"])
    # at least full - H segments of a set are those of its partner
    rows = rows.filter(~plain | (F.col("shared") >= F.col("full") - differ))
    group = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("shared", "n", "sid")).alias("lead"))
    rows = cut(rows.join(group, "sig"))

    sets = cut(whole_sets(docs, rows.filter("size > 1").select("sid").distinct(), words, percent))
    first = rows.filter("size > 1 AND sid <> lead.sid").select("sid", "n", F.col("lead.sid").alias("other"), F.col("lead.n").alias("m"))
    stars = cut(first.filter(_fits("n", "m", percent)).select(*_pair("sid", "other")).distinct())
    found = cut(verified(stars, sets, percent))
    joined = _components(found)

    # the cheapest H + 1 segments, of which those of no other set need no search
    cheap = Window.partitionBy("sid", "space").orderBy("size", "sig")
    turn = F.row_number().over(cheap)
    rows = rows.withColumn("_t", turn)
    rows = rows.filter(~plain | (F.col("_t") <= differ + 1 - (F.col("full") - F.col("shared"))))
    rows = rows.join(joined, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    open_ = rows.groupBy("sig").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("_n"))
    open_ = open_.filter("_a <> _b").select("sig", F.col("_n").alias("size"))
    rows = rows.select("sig", "sid", "n", "component").join(open_, "sig")
    above = F.element_at(F.array(*[F.lit(x) for x in bands.starts[1:]]), F.col("sig").bitwiseAND(low).cast("int") + 1)
    rows = rows.join(sets.drop("hashes"), "sid").withColumn("bits", F.when(F.col("n") < above, F.col("own")).otherwise(F.col("below")))
    more = candidates(rows.drop("own", "below"), percent).join(stars, ["src", "dst"], "left_anti")
    found = found.union(cut(verified(more, sets, percent)))
    return found, _components(found)


def _components(found: DataFrame) -> DataFrame:
    linked = found.select(F.col("src").alias("sid")).union(found.select("dst")).distinct()
    return components(linked, found, "sid")


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest ``doc_id`` that links reach, the row itself included (null only if all of them are
    null). Null, empty and wordless texts link with nothing. Repeated rows and equal texts are in one component, texts
    are taken whole, other columns are ignored, an empty table gives an empty result. Shingles are told apart by
    hashes of 64 bits.
    """
    parts = cut(_parts(docs, words, percent))
    known = parts.filter("group IS NULL").select("doc_id", "sid", "n")
    points = known.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"))
    _, linked = links(docs, parts, words, percent)
    points = points.join(linked, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    points = cut(points)
    least = points.groupBy("component").agg(F.min("least").alias("component_id"))
    named = points.select("sid", "component").join(least, "component").select("sid", "component_id")
    rows = known.join(named, "sid", "left")
    own = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
