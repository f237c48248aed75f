"""Problem 7: one group id for all records linked directly or indirectly.

Edges are rewritten by alternating large-star and small-star steps until they
no longer change; then every record hangs on the smallest id of its component.
Each step is a map-side combined ``min`` per node and one join, so no node's
neighbours are ever gathered in one place, and a hub is only a skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnloom.functions.ids import canonical_vid
from tarnloom.plans.lineage import cut, drop

MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # a < b always holds here: the smaller neighbours of b are the a's of its edges
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(low, "b").where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return hung.union(low.select(F.col("m").alias("a"), "b")).distinct()


def group_pairs(pairs: DataFrame, left: str, right: str, group: str = "group_id", member: str = "id") -> DataFrame:
    """``(group, member)`` for every id of ``pairs``; the group is named by its
    smallest id and lists that id too.

    Self-pairs, pairs with a null side, and repeated or reversed pairs change
    nothing.  An empty table gives an empty result."""
    a, b = F.col(left), F.col(right)
    edges = (
        pairs.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )
    edges = cut(edges, "edges")
    before = _fingerprint(edges)
    for _ in range(MAX_ROUNDS):
        after = cut(_small_star(_large_star(edges)), "edges")
        drop(edges)
        edges, now = after, _fingerprint(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"edges still change after {MAX_ROUNDS} rounds")
    heads = edges.select(F.col("a").alias(group), F.col("a").alias(member)).distinct()
    return edges.select(F.col("a").alias(group), F.col("b").alias(member)).unionByName(heads)


def clip_links(match_pairs: DataFrame, manifest: DataFrame, least_score: float = 90.0) -> DataFrame:
    """The pairs of match_pairs that link two clips: score of at least
    ``least_score``, both ids given, different and in manifest.  Null and NaN
    scores link nothing."""
    ids = manifest.select(canonical_vid(F.col("vid")).alias("v"))
    scored = F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= least_score)
    pairs = (
        match_pairs.where(scored)
        .select(canonical_vid(F.col("vid_a")).alias("vid_a"), canonical_vid(F.col("vid_b")).alias("vid_b"))
        .where(F.col("vid_a") != F.col("vid_b"))
        .distinct()
    )
    return pairs.join(ids, pairs.vid_a == ids.v, "left_semi").join(ids.withColumnRenamed("v", "w"), pairs.vid_b == F.col("w"), "left_semi")
