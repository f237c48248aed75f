"""Connected components by parallel hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnloom.plans.lineage import cut

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node that each node of ``edges`` is
    linked to.  Nulls and self-links are ignored; an empty table gives none.

    A round hooks each root to its smallest neighbouring root, shortcuts the
    hooks until they point at roots, and rewrites the edges between roots; edges
    inside one tree vanish, so the rounds shrink quickly.  Each table is written
    once, which cuts the lineage."""
    x, y = F.col(a), F.col(b)
    live = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    live = cut(live.distinct(), "edges")
    parents = None
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        hooks = live.groupBy("u").agg(F.min("v").alias("p"))
        while True:  # shortcut: point at the parent's parent until nothing moves
            hooks = cut(hooks, "hooks")
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = hooks.join(up, "p", "left")
            if jumped.where(F.col("pp").isNotNull()).isEmpty():
                break
            hooks = jumped.select("u", F.coalesce("pp", "p").alias("p"))
        fresh = hooks.select(F.col("u").alias("node"), F.col("p").alias("component"))
        if parents is not None:
            # a root that is hooked now was no hooked node before
            moved = parents.join(hooks, parents.component == hooks.u, "left").select("node", F.coalesce("p", "component").alias("component"))
            fresh = moved.unionByName(fresh)
        parents = cut(fresh, "parents") if parents is not None else fresh
        hop = lambda side: hooks.select(F.col("u").alias(side), F.col("p").alias(f"{side}_p"))
        live = live.join(hop("u"), "u", "left").join(hop("v"), "v", "left").select(F.coalesce("u_p", "u").alias("x"), F.coalesce("v_p", "v").alias("y"))
        live = live.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        live = cut(live.distinct(), "edges")
    else:
        raise RuntimeError(f"trees still merge after {MAX_ROUNDS} rounds")
    if parents is None:
        parents = live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return parents.unionByName(parents.select(F.col("component").alias("node"), "component").distinct())
