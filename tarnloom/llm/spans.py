"""Problem 10: long exact spans shared between records.

1. Exact copies of whole texts are grouped by SHA-256; one of each goes on.
2. Every text gives anchors: of each ``LEAST - K + 1`` neighbouring K-grams the one
   with the smallest hash.  Two texts that share LEAST characters share an anchor
   inside them, so no span is lost; anchors of one text alone are dropped.
3. Around each shared anchor lies a window that holds every span of LEAST
   characters with that anchor in it.  Equal windows are shared as they are.
4. Different windows of one anchor go to the anchor's shard.  There a compressed
   FM-index (wavelet matrix over the Burrows-Wheeler transform, bits packed with
   block counts) is built, the windows are streamed through backward search, and
   intervals of more than one occurrence that reach LEAST characters are reported.
   An anchor with very many different windows is split into blocks, block against
   block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnloom.plans.lineage import cut

LEAST = 200
#: Length of an anchor; a power of 2 below LEAST.
K = 128
#: Different windows of one anchor that a task indexes or streams at once.
BLOCK = 250
#: Windows per shard, about: 150 KB of text.
SHARD = 500


def anchors(text: str, k: int = K, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the anchors of ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < least:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    h = (codes.astype(np.uint64) + np.uint64(0x51ED)) * np.uint64(0xD6E8FEB86659FD93)
    power, n = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while n < k:
            h = h[:-n] * power + h[n:]
            power, n = power * power, n * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    low, n, window = h, 1, least - k + 1
    while 2 * n <= window:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if window > n:
        low = np.minimum(low[: len(low) - (window - n)], low[window - n :])
    # a position is an anchor if it holds the minimum of a window that covers it
    edge = np.full(window - 1, 0, np.uint64)
    reach = np.concatenate((edge, low, edge))
    n = 1
    while 2 * n <= window:
        reach = np.maximum(reach[:-n], reach[n:])
        n *= 2
    if window > n:
        reach = np.maximum(reach[: len(reach) - (window - n)], reach[window - n :])
    at = _thinned(h, np.flatnonzero(h == reach), window)
    return h[at].view(np.int64), at.astype(np.int32)


def _thinned(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Of anchors with one hash in one text only so many that every window which has
    that hash as its minimum still holds one: runs of one character would else make
    every position an anchor."""
    order = np.lexsort((at, h[at]))
    pos, key = at[order], h[at][order]
    close = (key[1:] == key[:-1]) & (np.diff(pos) <= window)
    if not close.any():
        return at
    keep, last, n = [], None, len(pos)
    for i in range(n):
        fresh = i == 0 or key[i] != key[i - 1]
        follows = i + 1 < n and key[i + 1] == key[i] and not fresh and pos[i + 1] - last <= window
        if fresh or not follows:
            keep.append(pos[i])
            last = pos[i]
    return np.sort(np.array(keep))


class FMIndex:
    """A compressed full-text index of windows."""

    def __init__(self, texts: list[str]) -> None:
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.alphabet = np.unique(np.concatenate(codes))
        stop = np.zeros(1, np.int64)
        parts = [x for c in codes for x in (np.searchsorted(self.alphabet, c) + 1, stop)]
        sym = np.concatenate(parts)
        sizes = np.array([len(c) + 1 for c in codes])
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.order = self._suffixes(sym, int(sizes.max()))
        bwt = sym[self.order - 1]
        sigma = len(self.alphabet) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(sym, minlength=sigma))))[:sigma]
        self._wavelet(bwt, sigma)

    @staticmethod
    def _suffixes(sym: np.ndarray, longest: int) -> np.ndarray:
        """Suffix order as far as the longest window, by prefix doubling."""
        n = len(sym)
        key, width = sym, 1
        rank = np.empty(n, np.int64)
        while True:
            order = np.argsort(key)
            s = key[order]
            rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
            if width >= longest or rank[order[-1]] == n - 1:
                return order
            key = rank * (n + 1) + np.concatenate((rank[width:] + 1, np.zeros(min(width, n), np.int64)))[:n]
            width *= 2

    def _wavelet(self, bwt: np.ndarray, sigma: int) -> None:
        self.n, self.levels = len(bwt), []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            b = ((bwt >> bit) & 1).astype(bool)
            words = np.zeros(self.n // 64 + 2, np.uint64)
            packed = np.packbits(b, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words))))[:-1].astype(np.int32)
            zeros = int(self.n - b.sum())
            self.levels.append((bit, words, counts, zeros))
            bwt = np.concatenate((bwt[~b], bwt[b]))
        first = np.arange(sigma)
        at = np.zeros(sigma, np.int64)
        self.shift = self.before - self._down(first, at)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, words, counts, zeros in self.levels:
            block, rest = i >> 6, (i & 63).astype(np.uint64)
            ones = counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << rest) - np.uint64(1)))
            i = np.where((c >> bit) & 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``c`` put before the patterns of [lo, hi)."""
        return self.shift[c] + self._down(c, lo), self.shift[c] + self._down(c, hi)

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text; 0, which matches no text, for unknown characters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def matches(self, queries: list[tuple[str, int]], least: int, alone: int) -> Iterator[tuple[int, int, int, int]]:
        """``(query, end, window, start)``: for each query text, each end at which
        the ``least`` characters before it also stand in a window, the window and
        their place in it.  Queries come with the first end to be looked at.  Ends are
        searched in strides, the statistics of one carried to those after it; an
        interval of ``alone`` occurrences or fewer is given up (1 if the queries
        themselves are indexed, else 0)."""
        sym = [self.symbols(t) for t, _ in queries]
        base = np.concatenate(([0], np.cumsum([len(s) for s in sym])))
        flat = np.concatenate(sym)
        many = np.array([max(0, len(s) - e + 1) for s, (_, e) in zip(sym, queries)])
        q = np.repeat(np.arange(len(queries)), many)
        first = np.cumsum(many) - many
        nth = np.arange(len(q)) - first[q]
        end, last = nth + np.array([e for _, e in queries])[q], (first + many - 1)[q]
        done = np.zeros(len(q), bool)
        for stride in (16, 4, 1):
            at = np.flatnonzero(~done & (nth % stride == 0))
            steps, lo, hi = self._search(flat, base[q[at]] + end[at], least, alone)
            done[at] = True
            # what occurs nowhere else ends later searches that hold it: a search that gave
            # up after k characters rules out the next ``least`` - k ends
            lost = steps <= least
            ruled = np.zeros(len(q) + 1, np.int64)
            np.add.at(ruled, at[lost], 1)
            np.add.at(ruled, np.minimum(at[lost] + least - steps[lost], last[at[lost]]) + 1, -1)
            done |= np.cumsum(ruled[:-1]) > 0
            at, lo, count = at[~lost], lo[~lost], (hi - lo)[~lost]
            entry = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = self.order[entry]
            window = np.searchsorted(self.starts, place, "right") - 1
            yield from zip(np.repeat(q[at], count).tolist(), np.repeat(end[at], count).tolist(), window.tolist(), (place - self.starts[window]).tolist())

    def _search(self, flat: np.ndarray, end: np.ndarray, least: int, alone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward searches from the places ``end`` of ``flat``: after how many characters
        ``alone`` or fewer occurrences were left (``least`` + 1: never), and the intervals."""
        steps = np.full(len(end), least + 1)
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        live = np.arange(len(end))
        for step in range(1, least + 1):
            c = flat[end[live] - step]
            lo[live], hi[live] = self.extend(c, lo[live], hi[live])
            keep = (hi[live] - lo[live] > alone) & (c > 0)
            if not keep.all():
                steps[live[~keep]] = step
                live = live[keep]
            if not len(live):
                break
        return steps, lo, hi


def _shard(table: pa.Table) -> pa.Table:
    """Shared spans between different windows of a shard: the first and the last
    place of the pair in either window."""
    rows = table.to_pylist()
    index = [r for r in rows if r["indexed"]]
    stream = [r for r in rows if r["streamed"]]
    found: dict[tuple[int, int], list[int]] = {}
    if index and stream:
        fm = FMIndex([r["win"] for r in index])
        both = len(index) == len(rows) == len(stream)
        for at in range(0, len(stream), 1000):
            part = stream[at : at + 1000]
            queries = [(r["win"], LEAST) for r in part]
            for q, end, w, start in fm.matches(queries, LEAST, 1 if both else 0):
                a, b = part[q]["wid"], index[w]["wid"]
                if a == b:
                    continue
                a_lo = end - LEAST
                got = found.get((a, b))
                if got is None:
                    found[a, b] = [a_lo, end, start, start + LEAST]
                else:
                    got[0], got[1] = min(got[0], a_lo), max(got[1], end)
                    got[2], got[3] = min(got[2], start), max(got[3], start + LEAST)
    cols = list(zip(*[(a, b, *x) for (a, b), x in found.items()])) or [[]] * 6
    names = ["a", "b", "a_lo", "a_hi", "b_lo", "b_hi"]
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 4)], names=names)


def _windows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``copies(rep, doc)`` of texts long enough, the windows around shared anchors
    ``held(wid, doc, lo, width)``, and the different windows ``(wid, h, win)``.  A
    window's ``wid`` is unique to its anchor and text."""
    long = docs.select(F.col("doc_id").alias("doc"), "text").where(F.col("doc").isNotNull() & (F.length("text") >= LEAST))
    sums = long.select("doc", F.sha2("text", 256).alias("sum"))
    reps = sums.groupBy("sum").agg(F.min("doc").alias("rep"), F.count("*").alias("n"))
    several = reps.where("n > 1").select("sum", "rep")
    copies = cut(sums.join(several, "sum").select("rep", "doc"), "copies")
    unique = long.join(copies.where(F.col("doc") != F.col("rep")).select("doc"), "doc", "left_anti")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ds, ps = [], [], []
            for d, t in zip(b["doc"].to_pylist(), b["text"].to_pylist()):
                h, at = anchors(t)
                hs.append(h)
                ps.append(at)
                ds.append(np.full(len(h), d, np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ds, ps)], names=["h", "doc", "at"])

    marks = cut(unique.select("doc", "text").mapInArrow(find, "h long, doc long, at int"), "anchors")
    shared = marks.groupBy("h").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("h")
    shared = cut(marks.join(shared, "h"), "shared")
    lo = F.greatest(F.col("at") - (LEAST - K), F.lit(0))
    text = long.join(shared.select("doc").distinct(), "doc", "left_semi")
    cutout = F.substr(F.col("text"), F.col("lo") + 1, F.col("at") + LEAST - F.col("lo"))
    held = shared.withColumn("lo", lo).join(text, "doc").select("h", "doc", "lo", cutout.alias("win"))
    held = cut(held, "windows")
    kinds = held.select("h", "win").distinct()
    kinds = cut(kinds.select(F.monotonically_increasing_id().alias("wid"), "h", "win"), "kinds")
    placed = held.join(kinds, ["h", "win"]).select("wid", "doc", "lo", F.length("win").alias("width"))
    return copies, cut(placed, "placed"), kinds


def _between(kinds: DataFrame) -> DataFrame:
    """Spans shared by different windows, found in the shards' FM-indexes."""
    n = kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    several = kinds.join(n, "h").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("win"), F.col("blocks")).cast("int"))
    shards = max(1, -(-n.agg(F.sum("m")).first()[0] // SHARD)) if not n.isEmpty() else 1
    home = F.pmod("h", F.lit(shards))
    small = several.where("blocks = 1").select("wid", "win", home.alias("s"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("indexed"), F.lit(True).alias("streamed"))
    big = several.where("blocks > 1")
    # block i is indexed for every j >= i, block j streamed through every i <= j
    index = big.withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1))).select("wid", "win", F.col("h").alias("s"), (F.col("block") + 1).alias("i"), (F.col("j") + 1).alias("j"), F.lit(True).alias("indexed"), (F.col("j") == F.col("block")).alias("streamed"))
    stream = big.where("block > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block") - 1))).select("wid", "win", F.col("h").alias("s"), (F.col("i") + 1).alias("i"), (F.col("block") + 1).alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("streamed"))
    # about one shard a partition; their number grows with the shards
    tasks = small.union(index).union(stream).repartition(4 * shards, "s", "i", "j")
    return tasks.groupBy("s", "i", "j").applyInArrow(_shard, "a long, b long, a_lo int, a_hi int, b_lo int, b_hi int")


def shared_pairs(docs: DataFrame) -> DataFrame:
    """``(doc_a, doc_b)``: documents that share a span of LEAST characters or more
    verbatim.  Null texts and shorter ones share nothing; spans repeated within
    one document do not count."""
    copies, held, kinds = _windows(docs)
    at = held.select("wid", "doc").distinct()
    other = cut(_between(kinds).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "between")
    x, y = at.select("wid", F.col("doc").alias("x")), at.select("wid", F.col("doc").alias("y"))
    # windows of the same documents give the same pairs: one of them is enough
    sums = [F.sum(F.xxhash64(F.lit(k), "doc").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    owners = at.groupBy("wid").agg(F.count("*").alias("n"), *sums).where("n > 1")
    one = owners.groupBy("n", "s1", "s2").agg(F.min("wid").alias("wid")).select("wid")
    equal = x.join(one, "wid").join(y, "wid").where("x < y").select("x", "y")
    near = other.join(x.withColumnRenamed("wid", "a"), "a").join(y.withColumnRenamed("wid", "b"), "b").select("x", "y")
    pairs = equal.union(near).where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    # every copy of a text shares what its first copy shares, and the whole with the others
    a, b = copies.select(F.col("rep").alias("x"), F.col("doc").alias("xd")), copies.select(F.col("rep").alias("y"), F.col("doc").alias("yd"))
    spread = pairs.join(a, "x", "left").join(b, "y", "left").select(F.coalesce("xd", "x").alias("p"), F.coalesce("yd", "y").alias("q"))
    within = a.join(b, F.col("x") == F.col("y")).where(F.col("xd") < F.col("yd")).select(F.col("xd").alias("p"), F.col("yd").alias("q"))
    return spread.union(within).select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b"))


def _merged(places):
    """Length of the union of an array of structs (lo, hi)."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    step = lambda acc, p: F.struct(
        (acc["sum"] + F.greatest(p["hi"] - F.greatest(p["lo"], acc["end"]), F.lit(0))).alias("sum"),
        F.greatest(acc["end"], p["hi"]).alias("end"),
    )
    return F.aggregate(F.array_sort(places), start, step, lambda acc: acc["sum"])


def coverage(docs: DataFrame) -> DataFrame:
    """``(doc_id, chars, shared_chars, share)`` for every document with a span of
    LEAST characters that stands in another one too: how many of its characters
    lie in such spans."""
    copies, held, kinds = _windows(docs)
    many = held.groupBy("wid").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("wid")
    whole = held.join(many, "wid").select("doc", "lo", (F.col("lo") + F.col("width")).alias("hi"))
    b = _between(kinds)
    sides = b.select(F.col("a").alias("wid"), F.col("a_lo").alias("f"), F.col("a_hi").alias("t"), F.col("b").alias("other")).union(b.select("b", "b_lo", "b_hi", "a"))
    # a window of the same document does not make a span shared
    owner = held.groupBy("wid").agg(F.min("doc").alias("x"), F.max("doc").alias("y"))
    parts = sides.join(owner.withColumnRenamed("wid", "other"), "other").join(held, "wid")
    parts = parts.where((F.col("x") != F.col("doc")) | (F.col("y") != F.col("doc"))).select("doc", (F.col("lo") + F.col("f")).alias("lo"), (F.col("lo") + F.col("t")).alias("hi"))
    per = whole.union(parts).distinct().groupBy("doc").agg(_merged(F.collect_list(F.struct("lo", "hi"))).alias("shared_chars"))
    length = docs.select(F.col("doc_id").alias("doc"), F.length("text").alias("chars"))
    out = per.join(copies.where(F.col("doc") == F.col("rep")).select("doc"), "doc", "left_anti").join(length, "doc")
    full = copies.select("doc").join(length, "doc").select("doc", F.col("chars").alias("shared_chars"), "chars")
    out = out.select("doc", "shared_chars", "chars").union(full)
    return out.select(F.col("doc").alias("doc_id"), "chars", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 4).alias("share"))
