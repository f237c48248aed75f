"""The pN_ queries over the test tables.  Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnloom.llm import copies, garble, groups, leaks, lookalikes, near, overlap, spans, splits, tokens
from tarnloom.plans.lineage import table


def _on(*names: str):
    def wrap(f):
        return lambda spark, d: f(*(table(spark, d, n) for n in names))

    return wrap


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _on("manifest")(splits.mixed_recordings),
    "p1_splits": _on("manifest")(splits.resplit),
    "p2_found": _on("manifest")(copies.copy_pairs),
    "p2_collapsed": _on("manifest")(copies.collapse),
    "p3_found": _on("manifest")(garble.garbled_rows),
    "p3_restored": _on("manifest")(garble.repair),
    "p4_found": _on("manifest")(near.near_pairs),
    "p4_groups": _on("manifest")(near.near_groups),
    "p5_found": _on("manifest", "clip_jobs")(overlap.overlap_pairs),
    "p5_counts": _on("manifest", "clip_jobs")(overlap.overlap_counts),
    "p6_found": _on("manifest")(lookalikes.look_alike_pairs),
    "p6_canonical": _on("manifest")(lambda m: lookalikes.unify(m.select("pos", "text"))),
    "p7_found": _on("match_pairs", "manifest")(
        lambda pairs, m: groups.group_pairs(groups.clip_links(pairs, m), "vid_a", "vid_b", "group_vid", "vid")
    ),
    "p8_ids": _on("documents")(tokens.encode),
    "p9_found": _on("documents", "eval_items")(lambda d, e: leaks.find_leaks(d, e).select("doc_id", "item_id")),
    "p9_leaked": _on("documents", "eval_items")(leaks.leaked_items),
    "p10_found": _on("documents")(spans.shared_pairs),
    "p10_coverage": _on("documents")(spans.coverage),
}
