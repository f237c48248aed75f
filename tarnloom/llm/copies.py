"""Problem 2: records identical but for white space, letter case, punctuation
or field order, collapsed into one record with its number of copies.

Canonical bytes are split by radix: a bucket is the keys with a common prefix,
and a bucket of more than ``BUCKET_ROWS`` is split by further bytes until each
fits one task.  Within a bucket a byte trie with terminal counters counts the
keys.  Equal keys are summed up inside each batch before anything is shuffled,
so a key that makes up a third of all rows reaches its bucket as few partial
counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnloom.llm.norm import captions, content_key
from tarnloom.plans.lineage import cut

#: Partial counts that one trie may hold: at most about 100 MB of Python.
BUCKET_ROWS = 100_000
#: Bytes by which a prefix grows at a split.
STEP = 2

_PARTIAL = pa.schema([("key", pa.binary()), ("first_pos", pa.int64()), ("n", pa.int64())])


class Trie:
    """A path-compressed byte trie; ``slots[i]`` is the terminal counter
    ``[count, smallest position]`` of the i-th distinct key."""

    __slots__ = ("root", "slots", "keys")

    def __init__(self) -> None:
        self.root: dict = {}  # first byte -> [label, children, slot or -1]
        self.slots: list[list[int]] = []
        self.keys: list[bytes] = []

    def _terminal(self, key: bytes, n: int, pos: int) -> int:
        self.slots.append([n, pos])
        self.keys.append(key)
        return len(self.slots) - 1

    def add(self, key: bytes, n: int, pos: int) -> None:
        kids, at, end = self.root, 0, len(key)
        if not end:
            key, end = b"\0", 1  # the empty key has a node of its own; canonical text holds no NUL
        while True:
            node = kids.get(key[at])
            if node is None:
                kids[key[at]] = [key[at:], {}, self._terminal(key, n, pos)]
                return
            label = node[0]
            if key.startswith(label, at):
                at += len(label)
                if at == end:
                    if node[2] < 0:
                        node[2] = self._terminal(key, n, pos)
                    else:
                        slot = self.slots[node[2]]
                        slot[0] += n
                        if pos < slot[1]:
                            slot[1] = pos
                    return
                kids = node[1]
                continue
            same, most = 1, min(len(label), end - at)
            while same < most and label[same] == key[at + same]:
                same += 1
            lower = [label[same:], node[1], node[2]]
            node[0], node[1], node[2] = label[:same], {label[same]: lower}, -1
            if at + same == end:
                node[2] = self._terminal(key, n, pos)
            else:
                node[1][key[at + same]] = [key[at + same :], {}, self._terminal(key, n, pos)]
            return


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal keys of some batches become one partial count."""

    def summed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by("key").aggregate([("first_pos", "min"), ("n", "sum")])
        return t.select(["key", "first_pos_min", "n_sum"]).rename_columns(["key", "first_pos", "n"]).cast(_PARTIAL).combine_chunks().to_batches()

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 60_000:
            yield from summed(held)
            held, rows = [], 0
    if rows:
        yield from summed(held)


def _count(table: pa.Table) -> pa.Table:
    trie = Trie()
    add = trie.add
    for k, p, n in zip(table["key"].to_pylist(), table["first_pos"].to_pylist(), table["n"].to_pylist()):
        add(k, n, p)
    return pa.table({"key": trie.keys, "first_pos": [s[1] for s in trie.slots], "n": [s[0] for s in trie.slots]}, schema=_PARTIAL)


def _prefix(length: int):
    return F.substring("key", 1, length)


def radix_count(keys: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(key, first_pos, n)`` for every distinct ``key`` (binary) of
    ``keys(key, pos)``: its smallest position and its number of rows.

    Null keys are left out.  A bucket that no further byte can split (partial
    counts of one key) is cut into chunks, which are counted apart and then
    summed."""
    ddl = "key binary, first_pos long, n long"
    parts = keys.where(F.col("key").isNotNull()).select("key", F.col("pos").alias("first_pos"), F.lit(1).cast("long").alias("n"))
    parts = cut(parts.mapInArrow(_combine, ddl), "partials")
    length, step, levels, any_stuck, before = STEP, STEP, [], False, None
    live = parts
    while True:
        sizes = live.groupBy(_prefix(length).alias("big")).agg(F.count("*").alias("n"), F.max(F.length("key")).alias("longest"))
        big = cut(sizes.where((F.col("n") > bucket_rows)), "oversized")
        deep = F.col("longest") > length
        buckets, rows, stuck = big.agg(F.count("*"), F.sum("n"), F.count_if(~deep)).first()
        if not buckets:
            break
        # where the last bytes split nothing (a long common prefix), more are taken
        step = 2 * step if (buckets, rows) == before else STEP
        before, any_stuck = (buckets, rows), any_stuck or stuck > 0
        levels.append((length, length + step, big))
        if stuck == buckets:
            break
        live = live.join(big.where(deep).select("big"), _prefix(length) == F.col("big"), "left_semi")
        length += step
    placed, bucket = parts, _prefix(STEP)
    for i, (at, further, big) in enumerate(levels):
        mark = big.select(F.col("big").alias(f"p{i}"), F.ceil(F.col("n") / bucket_rows).alias(f"c{i}"), (F.col("longest") > at).alias(f"deep{i}"))
        placed = placed.join(mark, _prefix(at) == F.col(f"p{i}"), "left")
        bucket = F.when(F.col(f"p{i}").isNotNull() & F.col(f"deep{i}"), _prefix(further)).otherwise(bucket)
    chunk = F.lit(0).cast("long")
    for i in range(len(levels)):
        stuck = F.col(f"p{i}").isNotNull() & ~F.col(f"deep{i}")
        chunk = F.when(stuck, F.pmod(F.col("first_pos"), F.col(f"c{i}"))).otherwise(chunk)
    placed = placed.select("key", "first_pos", "n", bucket.alias("bucket"), chunk.alias("chunk"))
    counted = placed.groupBy("bucket", "chunk").applyInArrow(_count, ddl)
    if not any_stuck:
        return counted
    return counted.groupBy("key").agg(F.min("first_pos").alias("first_pos"), F.sum("n").alias("n"))


def canonical_rows(manifest: DataFrame) -> DataFrame:
    """``(pos, key)``: canonical bytes of the captions of six or more words."""
    return captions(manifest).select("pos", content_key(F.col("shown")).cast("binary").alias("key"))


def collapse(manifest: DataFrame) -> DataFrame:
    """``(first_pos, n, text)``: one record per content with its number of rows;
    ``text`` is that of the row delivered first."""
    counted = radix_count(canonical_rows(manifest))
    return counted.join(manifest.select(F.col("pos").alias("first_pos"), "text"), "first_pos").select("first_pos", "n", "text")


def copy_pairs(manifest: DataFrame) -> DataFrame:
    """``(first_pos, copy_pos)``: the first row of each content with every other
    row of it.  Nulls, blanks and captions under six words give no row."""
    rows = cut(canonical_rows(manifest), "canonical")
    groups = radix_count(rows).where(F.col("n") > 1).select("key", "first_pos")
    return rows.join(groups, "key").where(F.col("pos") != F.col("first_pos")).select("first_pos", F.col("pos").alias("copy_pos"))
