"""Problem 9: evaluation texts leaking into training text.

Filtering by the q-gram lemma: a stretch of L characters that matches an item
with at most k edits shares at least L + 1 - q (1 + k) of its q-grams with it, all
on diagonals (position in the document less position in the item) at most k
apart.  Shared q-grams are counted per document and item in overlapping bands of
diagonals; bands that reach the bound are retained and verified by an alignment
within the band.  q is the largest power of 2 up to 16 for which the bound of an item
is at least 1.

Documents are scanned once, however many the items: their q-grams that a bit table of
fixed size lets pass are joined with the items' q-grams, and texts are looked up for
the retained bands only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnloom.plans.lineage import cut

Q = 16
#: Bits of the table that document q-grams must pass: bounds what is broadcast.
BITS = 1 << 22


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram of an array of code points; q a power of 2."""
    h = (codes.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0xD6E8FEB86659FD93)
    power, n = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while n < q:
            if len(h) <= n:
                return np.empty(0, np.uint64)
            h = h[:-n] * power + h[n:]
            power, n = power * power, n * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _shortest(words: list[str], least_words: int) -> int:
    """Characters of the shortest stretch of enough words, with a blank at either end."""
    lengths = np.cumsum([0, *(len(w) + 1 for w in words)])
    return int((lengths[least_words:] - lengths[:-least_words]).min()) + 1


def gram_size(words: list[str], least_words: int, edits: int, most: int = Q) -> tuple[int, int]:
    """q and the fewest shared q-grams of a stretch with so many edits."""
    q, chars = most, _shortest(words, least_words)
    while q > 1 and chars + 1 - q * (1 + edits) < 1:
        q //= 2
    return q, max(1, chars + 1 - q * (1 + edits))


def stretch(text: str, item: str, bands: list[tuple[int, int]], least_words: int, edits: int) -> int:
    """The most words of ``item`` in one stretch that ``text`` holds with at most
    the allowed edits on the diagonals of a band; less than wanted counts as 0."""
    words, doc, best = item.split(" "), f" {text} ", 0
    at = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    for lo, hi in bands:
        for s in range(len(words)):
            n = max(least_words, best + 1)
            while s + n <= len(words):
                pattern = f" {' '.join(words[s : s + n])} "
                start, end = at[s] + lo - edits, at[s + n] + 1 + hi + edits
                region = " " * max(0, -start) + doc[max(0, start) : max(0, end)]
                region += "\0" * (end - start - len(region))
                if not within_band(pattern, region, edits):
                    break
                best, n = n, n + 1
    return best


def within_band(pattern: str, region: str, edits: int) -> bool:
    """Whether ``pattern`` matches a part of ``region`` with at most ``edits`` character
    edits; the alignment starts at any offset up to the difference of their lengths
    and stays in that band."""
    if not edits and len(region) == len(pattern):  # a band of one diagonal and no edit
        return region == pattern
    last = len(region) - len(pattern)
    row = [0] * (last + 1)
    for i, x in enumerate(pattern):
        new: list[int] = []
        for b in range(last + 1):
            cost = row[b] + (region[i + b] != x)
            if b < last:
                cost = min(cost, row[b + 1] + 1)
            if b:
                cost = min(cost, new[b - 1] + 1)
            new.append(cost)
        row = new
        if min(row) > edits:
            return False
    return True


def normalised(c):
    """Runs of letters and digits in lower case, joined by blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def find_leaks(
    docs: DataFrame, items: DataFrame, least_words: int = 10, edits: int = 0,
    doc_key: str = "doc_id", item_key: str = "item_id", column: str = "text",
) -> DataFrame:
    """``(doc_key, item_key, words)``: the documents that hold ``least_words`` or
    more consecutive words of an item, with at most ``edits`` edited characters in
    them, and the most words of one stretch.  Null, empty and too short texts hold nothing and
    are held by nothing.  Document keys are integers or strings, items' integers."""
    spark = docs.sparkSession
    kind = docs.schema[doc_key].dataType.simpleString()
    slim = items.select(F.col(item_key).cast("long").alias("i"), normalised(F.col(column)).alias("item"))
    slim = slim.where(F.size(F.split("item", " ")) >= least_words)
    texts = docs.where(F.length(column) > 0).select(F.col(doc_key).alias("d"), normalised(F.col(column)).alias("t"))
    texts = texts.where(F.length("t") > 0)

    def item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b["i"].to_pylist(), b["item"].to_pylist()):
                q, bound = gram_size(t.split(" "), least_words, edits)
                g = _grams(_codes(f" {t} "), q).view(np.int64)
                rows.append((g, np.full(len(g), i), np.arange(len(g), dtype=np.int32), np.full(len(g), q, np.int32), np.full(len(g), bound, np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["g", "i", "at", "q", "bound"])

    asked = cut(slim.mapInArrow(item_grams, "g long, i long, at int, q int, bound int"), "grams")
    bits, seen = np.zeros(BITS, bool), asked.select("q", F.col("g").bitwiseAND(BITS - 1).alias("bit")).distinct().toPandas()  # at most BITS rows for each q
    bits[seen["bit"].to_numpy(np.int64)] = True
    sizes = seen["q"].unique().tolist()
    shared = spark.sparkContext.broadcast((np.packbits(bits), sorted(sizes)))

    def doc_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, qs = shared.value
        table = np.unpackbits(packed).astype(bool)
        for b in batches:
            ds, gs, ps = [], [], []
            for k, t in enumerate(b["t"].to_pylist()):
                codes = _codes(f" {t} ")
                for q in qs:
                    g = _grams(codes, q)
                    at = np.flatnonzero(table[(g & np.uint64(BITS - 1)).astype(np.int64)])
                    gs.append(g[at].view(np.int64))
                    ps.append(at.astype(np.int32))
                    ds.append(np.full(len(at), k))
            if gs:
                yield pa.RecordBatch.from_arrays([b["d"].take(pa.array(np.concatenate(ds))), pa.array(np.concatenate(gs)), pa.array(np.concatenate(ps))], names=["d", "g", "p"])

    met = texts.mapInArrow(doc_grams, f"d {kind}, g long, p int").join(asked, "g")
    # bands are wide enough that one of two overlapping ones holds all diagonals that are
    # at most ``edits`` apart
    width, shifts = (2 * (edits + 1), (0, edits + 1)) if edits else (1, (0,))
    lows = F.array(*[F.floor((F.col("p") - F.col("at") + s) / width) * width - s for s in shifts])
    banded = met.select("d", "i", "bound", F.explode(lows).alias("lo")).groupBy("d", "i", "lo").agg(F.count("*").alias("n"), F.max("bound").alias("bound"))
    kept = banded.where("n >= bound").groupBy("d", "i").agg(F.collect_list("lo").alias("lows"))  # no more than the document's diagonals
    # a document's items together, so that its text is looked up once
    asked_of = cut(kept.join(slim, "i").groupBy("d").agg(F.collect_list(F.struct("i", "item", "lows")).alias("asked")), "bands")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ids, most = [], [], []
            for k, (t, asked) in enumerate(zip(b["t"].to_pylist(), b["asked"].to_pylist())):
                for a in asked:
                    n = stretch(t, a["item"], [(lo, lo + width - 1) for lo in sorted(a["lows"])], least_words, edits)
                    if n >= least_words:
                        at.append(k)
                        ids.append(a["i"])
                        most.append(n)
            yield pa.RecordBatch.from_arrays([b["d"].take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(most, pa.int32())], names=["d", "i", "words"])

    found = texts.join(asked_of, "d").select("d", "t", "asked").mapInArrow(align, f"d {kind}, i long, words int")
    return found.groupBy(F.col("d").alias(doc_key), F.col("i").alias(item_key)).agg(F.max("words").alias("words"))


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, documents, most_words)``: the items that leaked, in how many
    documents, and the longest stretch."""
    return find_leaks(docs, items).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("most_words"))
