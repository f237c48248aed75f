"""Problem 1: splits that keep related records together.

Records that share any link value (a recording, a clip, an author) form one
component.  Components come from parallel hooking and shortcutting over a
parent table; whole components are then dealt to the splits so that the totals
come closest to the wanted shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tarnloom.functions.ids import canonical_source, canonical_split, canonical_vid, recording
from tarnloom.operators import graph
from tarnloom.plans.lineage import cut

#: Rows that are first left to subset sums after the largest sizes are taken; where
#: that misses the target, all rows are.
WINDOW_ROWS = 1 << 20
_MIRRORED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), axis=1, bitorder="little")[:, 0]


def components(edges: DataFrame) -> DataFrame:
    """``(node, parent)`` for every node of ``edges(u, v)``: its component's
    smallest node, by parallel hooking and shortcutting over a parent table."""
    return graph.components(edges, "u", "v").withColumnRenamed("component", "parent")


def _parcels(sizes: dict[int, int], top: int) -> list[tuple[int, int]]:
    """``(size, copies)``: multiplicities split binarily, so that any number of copies
    up to the multiplicity is a sum of some; no more than fit into ``top``."""
    out = []
    for s, m in sorted(sizes.items()):
        m, part = min(m, top // s), 1
        while m > 0:
            out.append((s, min(part, m)))
            m -= part
            part *= 2
    return out


def _reach(parcels: list[tuple[int, int]], top: int) -> int:
    """Bit t: t rows, at most ``top``, are the sum of some parcels."""
    bits, mask = 1, (1 << (top + 1)) - 1
    for s, k in parcels:
        bits |= (bits << (s * k)) & mask
    return bits


def _nearest(bits: int, target: int) -> int:
    """The set bit nearest to ``target``, of two the lower."""
    below = (bits & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = bits >> (target + 1)
    over = (above & -above).bit_length() if above else None
    return target + over if over is not None and over < target - below else below


def _taken(parcels: list[tuple[int, int]], total: int, taken: dict[int, int]) -> None:
    """Adds to ``taken`` parcels of exactly ``total`` rows.  Both halves of the parcels
    are summed up, a total of the first is chosen that the second completes, and each
    half is solved alone: never more than three bitsets of ``total`` bits are held."""
    if not total:
        return
    if len(parcels) == 1:
        taken[parcels[0][0]] = taken.get(parcels[0][0], 0) + parcels[0][1]
        return
    half = len(parcels) // 2
    second = _reach(parcels[half:], total).to_bytes(total // 8 + 1, "little")
    mirrored = _MIRRORED[np.frombuffer(second, np.uint8)[::-1]].tobytes()
    both = _reach(parcels[:half], total) & (int.from_bytes(mirrored, "little") >> (8 * len(second) - 1 - total))
    first = (both & -both).bit_length() - 1
    del second, mirrored, both
    _taken(parcels[:half], first, taken)
    _taken(parcels[half:], total - first, taken)


def closest_counts(sizes: dict[int, int], target: int, window: int = WINDOW_ROWS) -> dict[int, int]:
    """How many components of each size to take so that their rows come closest
    to ``target`` (of two equally close totals the smaller).

    ``sizes`` maps a size to its multiplicity.  Subset sums, where bit t of an integer
    says that t rows can be had.  First the largest sizes are taken down to ``window``
    rows and only the rest is summed: if that meets the target, nothing is closer.
    Else all sizes are, up to as far beyond the target as the first way misses it;
    the result is exact either way.  A bitset has ``target`` bits then, an eighth of
    its rows in bytes, and three of them are held."""
    unit = math.gcd(*sizes) if sizes else 1
    left, taken, rest = {s // unit: n for s, n in sizes.items()}, {}, max(0, target) // unit
    for s in sorted(left, reverse=True):
        k = min(left[s], max(0, (rest - window) // s))
        if k:
            taken[s], left[s], rest = k, left[s] - k, rest - k * s

    def miss(total: int) -> tuple[int, int]:
        return abs(total * unit - target), total

    def nearest(parcels: list[tuple[int, int]], top: int, at: int, before: int) -> int:
        bits = _reach(parcels, top)
        return min((_nearest(bits, at), _nearest(bits, min(at + 1, top))), key=lambda t: miss(before + t))

    before = max(0, target) // unit - rest
    parcels = _parcels(left, 2 * rest + 1)
    total = nearest(parcels, 2 * rest + 1, rest, before)
    whole = max(0, target) // unit
    if before and miss(before + total) > min(miss(whole), miss(whole + 1)):
        top = whole + miss(before + total)[0] // unit + 1
        taken, parcels = {}, _parcels({s // unit: n for s, n in sizes.items()}, top)
        total = nearest(parcels, top, whole, 0)
    _taken(parcels, total, taken)
    return {s * unit: k for s, k in taken.items() if k}


def plan_quotas(sizes: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(stratum, size, split, k)`` from ``(stratum, size, n)``: one task per
    stratum.  A stratum has at most about sqrt(2 x rows) different sizes."""
    rest, small = next(iter(shares)), list(shares)[1:]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        free = {int(s): int(n) for s, n in zip(group["size"], group["n"])}
        rows, out = sum(s * n for s, n in free.items()), []
        for split in small:
            got = closest_counts(free, math.floor(rows * shares[split] + 0.5))
            for s, k in got.items():
                free[s] -= k
                out.append((group["stratum"].iloc[0], s, split, k))
        out += [(group["stratum"].iloc[0], s, rest, k) for s, k in free.items() if k]
        return pd.DataFrame(out, columns=["stratum", "size", "split", "k"])

    return sizes.groupBy("stratum").applyInPandas(one, "stratum string, size long, split string, k long")


def _ranked(df: DataFrame, keys: list[str], order: str, per_block: int = 50_000) -> DataFrame:
    """A rank from 0 within ``keys`` by the hash of ``order``, in two levels, so
    that no group is sorted in one task: blocks of the hash range, then rows."""
    n = df.groupBy(*keys).agg(F.ceil(F.count("*") / per_block).alias("blocks"))
    h = F.xxhash64(order)
    df = df.join(n, keys).withColumn("block", F.pmod(h, F.col("blocks")))
    offset = df.groupBy(*keys, "block").agg(F.count("*").alias("in_block")).withColumn(
        "offset", F.sum("in_block").over(W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    )
    rank = F.row_number().over(W.partitionBy(*keys, "block").orderBy(h, order)) - 1
    return df.withColumn("in_rank", rank).join(offset.drop("in_block"), [*keys, "block"]).select(
        *[c for c in df.columns if c not in ("blocks", "block")], (F.col("in_rank") + F.coalesce("offset", F.lit(0))).alias("rank")
    )


def deal(members: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(component, split)`` from ``(component, stratum, size)``, one row per
    component.  The first split of ``shares`` takes what the others leave."""
    quotas = plan_quotas(members.groupBy("stratum", "size").agg(F.count("*").alias("n")), shares)
    order = F.create_map(*[x for i, s in enumerate([*list(shares)[1:], next(iter(shares))]) for x in (F.lit(s), F.lit(i))])
    w = W.partitionBy("stratum", "size").orderBy(order[F.col("split")])
    bounds = quotas.withColumn("upto", F.sum("k").over(w)).withColumn("from", F.col("upto") - F.col("k"))
    ranked = _ranked(members, ["stratum", "size"], "component")
    return (
        ranked.join(bounds, ["stratum", "size"])
        .where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto")))
        .select("component", "split")
    )


def linked(df: DataFrame, links: Iterable[Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``key`` (its first link value that is not null), and the
    components of the link values.  A row without any link value has a null key
    and belongs to no component."""
    links = [F.when(c.isNotNull(), F.concat(F.lit(f"{i}:"), c.cast("string"))) for i, c in enumerate(links)]
    keyed = df.withColumn("links", F.array_compact(F.array(*links))).withColumn("key", F.get("links", F.lit(0)))
    edges = keyed.where(F.size("links") > 1).select("links").distinct().select(F.col("links")[0].alias("u"), F.explode(F.slice("links", 2, 1 << 20)).alias("v"))
    return keyed.drop("links"), components(edges)


def clips_linked(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest rows, summed up per clip, with their components: a row belongs
    with all rows of its recording and of its own vid."""
    rec = recording(F.col("vid"))
    slim = manifest.select("vid", "source", "split").select(
        canonical_vid(F.col("vid")).alias("vid"), rec.alias("recording"),
        canonical_source(F.col("source")).alias("source"), canonical_split(F.col("split")).alias("split"),
    )
    clips = slim.groupBy("vid", "recording", "source", "split").agg(F.count("*").alias("rows"))
    keyed, parents = linked(cut(clips, "clips"), [F.col("recording"), F.col("vid")])
    comp = F.coalesce("parent", "key")
    return keyed.join(parents, keyed.key == parents.node, "left").select("vid", "recording", "source", "split", "rows", comp.alias("component")), parents


def mixed_recordings(manifest: DataFrame) -> DataFrame:
    """``(recording)``: the recordings whose component has two or more splits by
    manifest's own column.  Null and unknown splits do not count."""
    clips, _ = clips_linked(manifest)
    seen = clips.where(F.col("split").isNotNull() & F.col("component").isNotNull())
    return (
        seen.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.min("recording").alias("recording"))
        .where((F.col("lo") != F.col("hi")) & F.col("recording").isNotNull())
        .select("recording")
    )


def resplit(manifest: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """``(pos, recording, new_split)`` for every manifest row.

    Whole recordings go to one split, close to ``shares`` (90/5/5) overall and
    within each source; a recording of several sources counts for the one with
    most of its rows (ties: the later name in the alphabet).  A row without a usable vid stands
    for itself and goes to the first split."""
    shares = shares or {"train": 0.90, "val": 0.05, "test": 0.05}
    clips, _ = clips_linked(manifest)
    by_source = clips.where(F.col("component").isNotNull()).groupBy("component", F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("rows").alias("rows"))
    comps = by_source.groupBy("component").agg(
        F.sum("rows").alias("size"), F.max_by("source", F.struct("rows", F.col("source"))).alias("stratum")
    )
    dealt = deal(cut(comps, "comps"), shares)
    home = clips.where(F.col("component").isNotNull()).select("recording", "component").where(F.col("recording").isNotNull()).distinct()
    to = home.join(dealt, "component").select("recording", F.col("split").alias("new_split"))
    rows = manifest.select("pos", recording(F.col("vid")).alias("recording"))
    return rows.join(to, "recording", "left").select("pos", "recording", F.coalesce("new_split", F.lit(next(iter(shares)))).alias("new_split"))
