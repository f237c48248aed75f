"""Problem 4: near-duplicate records with small edits, and the similarity join
that problem 5 shares.

A record is a vector of bytes over 2^20 positions: each of its words falls on a
position by hash, and the byte there tells how often it has occurred.  Two
records with n and m words and a similarity of 0.8 or more share at least
ceil(0.4 (n + m)) positional bytes.  So of the rarest ones, as many as a record can
lack and k more, they share k.  An inverted index over these proposes pairs: rare
positional bytes are posted alone, frequent ones in pairs, but only pairs within one
of k - 1 groups (by hash), since of k shared ones two fall into one group.  k grows
with the length, so a record of n words has in the order of n postings.  The shared
positional bytes of each proposed pair are tallied (a 128-bit sketch bounds the tally
in the join already), pairs that reach the guaranteed minimum are retained, and
these are verified on the words themselves.  The index loses no pair.

Rarity is counted over all records in a table of 2^20 counters, whatever their
number.  Records with the same words and content are joined as one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnloom.llm.groups import group_pairs
from tarnloom.llm.norm import captions, key_spelled, spelled, words_spelled
from tarnloom.plans.lineage import cut, drop

POSITIONS = 1 << 20
#: A positional byte of at most so many records is indexed on its own, others in pairs.
RARE = 24
#: Rows of a class that one join key holds when pairs of rows are written out.
CHUNK = 1000

_INDEX = "key long, rid long, meta int, s0 long, s1 long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _positional(hashes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and words per row of a list array of word hashes."""
    n = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    h = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if len(row) else np.empty(0, np.uint64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    starts = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    times = np.minimum(np.arange(len(h)) - starts, 255).astype(np.uint64)
    return row, (_mix(h + times * np.uint64(0xD1B54A32D192ED03)) & np.uint64(POSITIONS - 1)).astype(np.int64), n


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, any_rows = np.zeros(POSITIONS, np.int64), False
    for b in batches:
        counts += np.bincount(_positional(b.column(0))[1], minlength=POSITIONS)
        any_rows = True
    if any_rows:
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])


def _level(n: np.ndarray) -> np.ndarray:
    """Groups of frequent positional bytes, as a power of 2, for records of n words:
    about an eighth of what two such records share."""
    return np.floor(np.log2(np.maximum(n // 12, 1))).astype(np.int64)


def _index_rows(rid: np.ndarray, side: np.ndarray, hashes: pa.Array, freq: np.ndarray) -> list[np.ndarray]:
    row, pos, n = _positional(hashes)
    order = np.lexsort((pos, freq[pos], row))
    row, pos = row[order], pos[order]
    start = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else np.empty(0, np.int64)
    rank = np.arange(len(pos)) - start[row]
    # 128-bit tally
    bit = _mix(pos.astype(np.uint64) + np.uint64(77)) & np.uint64(127)
    halves = [np.where((bit >> np.uint64(6)) == np.uint64(i), np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)) for i in (0, 1)]
    full = n > 0
    sig = [np.zeros(len(n), np.uint64) for _ in halves]
    for s, x in zip(sig, halves):
        if len(x):
            s[full] = np.bitwise_or.reduceat(x, start[full])
    f, lost, top = freq[pos], n // 3, _level(n)
    low = _level(-(-2 * n // 3))  # of the shortest partner
    alone = (rank < (lost + 2**top + 1)[row]) & (f <= RARE) & (f > 1)
    keys, rows = [pos[alone] | (1 << 40)], [row[alone]]
    for level in range(int(top.max(initial=-1)) + 1):  # a pair meets at the lower level of the two
        hot = np.flatnonzero((f > RARE) & ((low <= level) & (level <= top))[row] & (rank < (lost + 2**level + 1)[row]))
        hr, hp = row[hot], pos[hot]
        group = (_mix(hp.astype(np.uint64) + np.uint64(9)) & np.uint64((1 << level) - 1)).astype(np.int64)
        close = np.argsort((hr << level) + group, kind="stable")
        hr, hp, group = hr[close], hp[close], group[close]
        step = 1
        while len(hr) > step:
            same = (hr[step:] == hr[:-step]) & (group[step:] == group[:-step])
            if not same.any():
                break
            keys.append((level << 41) | (hp[:-step][same] << 20) | hp[step:][same])
            rows.append(hr[step:][same])
            step += 1
    key, at = np.concatenate(keys), np.concatenate(rows)
    return [key, rid[at], (n[at] * 4 + side[at]).astype(np.int32), sig[0][at].view(np.int64), sig[1][at].view(np.int64)]


def _least_shared(n):
    """The fewest words that two records of n words together share at 0.8."""
    return F.floor((n * 2 + 4) / 5)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = re.compile("[ :|]")
    for b in batches:
        ok = []
        for x, y in zip(b["spelled_a"].to_pylist(), b["spelled_b"].to_pylist()):
            u, v = Counter(cutter.split(x)), Counter(cutter.split(y))
            ok.append(5 * sum(min(k, v[w]) for w, k in u.items() if w in v) >= 2 * (u.total() + v.total()))
        yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def candidates(classes: DataFrame, across: bool = False) -> DataFrame:
    """``(a, b)``, a < b: pairs of ``classes(rid, spelled, side)`` that the index
    proposes and the tally lets pass; all pairs of 0.8 or more are among them.
    ``across``: only pairs whose ``side`` bits (1 and 2) lie on both sides."""
    spark = classes.sparkSession
    hashed = classes.select("rid", "side", F.transform(words_spelled(F.col("spelled")), lambda w: F.xxhash64(w)).alias("h"))
    counted = hashed.select("h").mapInArrow(_tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    freq = np.zeros(POSITIONS, np.int64)
    got = counted.toPandas()  # at most 2^20 rows
    freq[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(freq.clip(max=2**31 - 1).astype(np.int32))
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                p = b.slice(at, 4000)
                cols = _index_rows(p["rid"].to_numpy(), p["side"].to_numpy(), p["h"], freq)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    index_rows = hashed.mapInArrow(index, _INDEX)
    a, b = index_rows.alias("x"), index_rows.alias("y")
    words = F.shiftright("x.meta", 2) + F.shiftright("y.meta", 2)
    apart = F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
    cond = (F.col("x.key") == F.col("y.key")) & (F.col("x.rid") < F.col("y.rid")) & (apart <= words - 2 * _least_shared(words))
    if across:
        sides = lambda p, q: (F.col("x.meta").bitwiseAND(p) > 0) & (F.col("y.meta").bitwiseAND(q) > 0)
        cond = cond & (sides(1, 2) | sides(2, 1))
    # the index is larger than its input, which the planner does not know: no broadcast
    return a.join(b.hint("merge"), cond).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, pos, n = _positional(b["h"])
        at = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(pos, pa.int32()))
        yield pa.RecordBatch.from_arrays([b["rid"], b["spelled"], at], names=["rid", "spelled", "places"])


def placed(few: DataFrame) -> DataFrame:
    """``few(rid, spelled)`` with the positional bytes of each record."""
    hashed = few.select("rid", "spelled", F.transform(words_spelled(F.col("spelled")), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.mapInArrow(_places, "rid long, spelled string, places array<int>")


def looked_up(pairs: DataFrame, few: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the other columns of ``few(rid, ...)`` for either side."""
    side = lambda s: few.select(F.col("rid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in few.columns if c != "rid"])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame, *keep: str) -> DataFrame:
    """``(p, q, *keep)``: the rows of either class of ``pairs(a, b, *keep)``, from
    ``left(rid, p)`` and ``right(rid, q)``.  Classes are cut into chunks of ``CHUNK``
    rows and the pairs written out per chunk, so that no key holds a large class."""

    def chunks(rows: DataFrame, s: str, value: str) -> tuple[DataFrame, DataFrame]:
        size = rows.groupBy(F.col("rid").alias(s)).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(f"parts_{s}"))
        held = rows.withColumnRenamed("rid", s).join(size, s).select(s, F.pmod(F.xxhash64(value), F.col(f"parts_{s}")).cast("int").alias(f"part_{s}"), value)
        return size, held

    (na, la), (nb, lb) = chunks(left, "a", "p"), chunks(right, "b", "q")
    cut_up = pairs.select("a", "b", *keep).join(na, "a").join(nb, "b")
    each = lambda s: F.explode(F.sequence(F.lit(0), F.col(f"parts_{s}") - 1)).alias(f"part_{s}")
    cut_up = cut_up.select("a", "b", *keep, "parts_b", each("a")).select("a", "part_a", "b", *keep, each("b"))
    return cut_up.join(la, ["a", "part_a"]).join(lb, ["b", "part_b"]).select("p", "q", *keep)


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()


def verified(pairs: DataFrame, few: DataFrame) -> DataFrame:
    """The pairs of different content whose words are similar enough: their shared
    positional bytes are tallied, those that reach the minimum compared word by word."""
    met = looked_up(pairs, placed(few))
    both = F.size("places_a") + F.size("places_b")
    again = F.least(*[F.size(f"places_{s}") - F.size(F.array_distinct(f"places_{s}")) for s in "ab"])  # places taken twice may be shared twice
    met = met.where(F.size(F.array_intersect("places_a", "places_b")) + again >= _least_shared(both))
    met = met.where(key_spelled(F.col("spelled_a")) != key_spelled(F.col("spelled_b")))
    return met.select("a", "b", "spelled_a", "spelled_b").mapInArrow(_verify, "a long, b long")


def spelled_rows(manifest: DataFrame) -> DataFrame:
    """``(pos, spelled)`` of the captions of six or more words."""
    return captions(manifest).select("pos", spelled(F.col("shown")).alias("spelled"))


def classes_of(rows: DataFrame, *extra) -> DataFrame:
    """``(spelled, rid, n, ...)``: rows of one spelling as one class, named by its
    smallest position."""
    return rows.groupBy("spelled").agg(F.min("pos").alias("rid"), F.count("*").alias("n"), *extra)


def members(rows: DataFrame, few: DataFrame) -> DataFrame:
    """``(rid, pos, ...)``: the rows of the classes in ``few(rid, spelled)``."""
    return rows.join(few.select("spelled", "rid"), "spelled").drop("spelled")


def near_pairs(manifest: DataFrame) -> DataFrame:
    """``(pos_a, pos_b)``: rows with a similarity of 0.8 or more that are not of
    the same content.  Nulls, blanks and captions under six words pair with
    nothing."""
    rows = cut(spelled_rows(manifest), "rows")
    classes = cut(classes_of(rows).withColumn("side", F.lit(0)), "classes")
    found = cut(candidates(classes), "found")
    few = cut(classes.select("rid", "spelled").join(ends_of(found), "rid", "left_semi"), "few")
    drop(classes)
    pairs = cut(verified(found, few), "near")
    few = few.join(ends_of(pairs), "rid", "left_semi")
    rows_of = cut(members(rows, few), "members")
    out = expanded(pairs, rows_of.withColumnRenamed("pos", "p"), rows_of.withColumnRenamed("pos", "q"))
    return out.select(F.least("p", "q").alias("pos_a"), F.greatest("p", "q").alias("pos_b"))


def near_groups(manifest: DataFrame) -> DataFrame:
    """``(pos, class_pos, group_pos, links)``: for every caption of six or more
    words its class of equal words in equal order, the group of near-duplicates it
    belongs to, directly or through others, and the number of classes that its
    class is linked to."""
    rows = cut(spelled_rows(manifest), "rows")
    classes = cut(classes_of(rows).withColumn("side", F.lit(0)), "classes")
    found = cut(candidates(classes), "found")
    pairs = cut(verified(found, classes.join(ends_of(found), "rid", "left_semi").select("rid", "spelled")), "near")
    group = group_pairs(pairs, "a", "b", "group_pos", "rid")
    links = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).groupBy("rid").agg(F.count("*").alias("links"))
    named = classes.join(group, "rid", "left").join(links, "rid", "left")
    named = named.select("spelled", F.col("rid").alias("class_pos"), F.coalesce("group_pos", "rid").alias("group_pos"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(named, "spelled").drop("spelled")
