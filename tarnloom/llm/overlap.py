"""Problem 5: the same or nearly the same records on both sides of a split.

Canonicalised records are hashed; hashes of evaluation rows are joined with
those of training rows, and the matches counted by split and source.  Hashes
find what is the same after normalisation; records that are only nearly the same
come from the positional index of ``near``, restricted to pairs across sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnloom.functions.ids import canonical_source, canonical_split, canonical_vid
from tarnloom.llm.near import candidates, classes_of, ends_of, expanded, looked_up, members, spelled_rows, verified
from tarnloom.llm.norm import key_spelled
from tarnloom.plans.lineage import cut, drop

TRAIN, EVAL = 1, 2


def effective_split(manifest: DataFrame, clip_jobs: DataFrame) -> DataFrame:
    """``(pos, split)`` of the rows that have one: manifest's own, else that of
    clip_jobs for the same vid (of several that differ, the first by name)."""
    own = manifest.select("pos", "vid", canonical_split(F.col("split")).alias("split"))
    bare = own.where(F.col("split").isNull()).select("pos", canonical_vid(F.col("vid")).alias("v"))
    jobs = clip_jobs.select(canonical_vid(F.col("vid")).alias("v"), canonical_split(F.col("split")).alias("s")).where(F.col("s").isNotNull())
    jobs = jobs.join(bare.select("v").distinct(), "v", "left_semi").groupBy("v").agg(F.min("s").alias("split"))
    return own.where(F.col("split").isNotNull()).select("pos", "split").union(bare.join(jobs, "v").select("pos", "split"))


def sided_rows(manifest: DataFrame, clip_jobs: DataFrame) -> DataFrame:
    """``(pos, spelled, split, side)`` of the captions that have a split."""
    split = effective_split(manifest, clip_jobs)
    return spelled_rows(manifest).join(split, "pos").withColumn("side", F.when(F.col("split") == "train", TRAIN).otherwise(EVAL))


def cross_pairs(rows: DataFrame) -> DataFrame:
    """``(train_pos, eval_pos, exact)`` over ``sided_rows``.

    Classes of equal words are joined, not rows; rows come in at the end."""
    classes = cut(classes_of(rows, F.bit_or("side").alias("side")), "classes")
    hashed = classes.select(F.xxhash64(key_spelled(F.col("spelled"))).alias("h"), "rid", "side")
    train = hashed.where(F.col("side").bitwiseAND(TRAIN) > 0).select("h", F.col("rid").alias("t"))
    held = hashed.where(F.col("side").bitwiseAND(EVAL) > 0).select("h", F.col("rid").alias("e"))
    same = cut(train.join(held, "h").select(F.col("t").alias("a"), F.col("e").alias("b")), "same")
    found = cut(candidates(classes, across=True), "found")
    few = cut(classes.select("rid", "spelled").join(ends_of(found.union(same)), "rid", "left_semi"), "few")
    drop(classes)
    equal = key_spelled(F.col("spelled_a")) == key_spelled(F.col("spelled_b"))  # hashes can collide
    same = looked_up(same, few).where(equal).select("a", "b", F.lit(True).alias("exact"))
    near = cut(verified(found, few), "near")
    both = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("exact", F.lit(False))
    links = cut(same.union(both), "links")
    member = cut(members(rows, few.join(ends_of(links), "rid", "left_semi")).select("rid", "pos", "side"), "members")
    t = member.where(F.col("side") == TRAIN).select("rid", F.col("pos").alias("p"))
    e = member.where(F.col("side") == EVAL).select("rid", F.col("pos").alias("q"))
    return expanded(links, t, e, "exact").select(F.col("p").alias("train_pos"), F.col("q").alias("eval_pos"), "exact")


def overlap_pairs(manifest: DataFrame, clip_jobs: DataFrame) -> DataFrame:
    """``(pos_a, pos_b)``: a train row and a val or test row of the same content
    or a similarity of 0.8 or more.  Rows without any split, and captions under
    six words, are left out."""
    pairs = cross_pairs(cut(sided_rows(manifest, clip_jobs), "sided"))
    return pairs.select(F.least("train_pos", "eval_pos").alias("pos_a"), F.greatest("train_pos", "eval_pos").alias("pos_b"))


def overlap_counts(manifest: DataFrame, clip_jobs: DataFrame) -> DataFrame:
    """``(split, source, eval_rows, same_pairs, near_pairs)``: evaluation rows
    with a match in train, and the matching pairs, by their split and source
    (lower case, trimmed; null stays a group of its own)."""
    rows = cut(sided_rows(manifest, clip_jobs), "sided")
    pairs = cross_pairs(rows).groupBy("eval_pos").agg(
        F.sum(F.col("exact").cast("long")).alias("same"), F.sum((~F.col("exact")).cast("long")).alias("near")
    )
    held = rows.where(F.col("side") == EVAL).select(F.col("pos").alias("eval_pos"), "split")
    source = manifest.select(F.col("pos").alias("eval_pos"), canonical_source(F.col("source")).alias("source"))
    return (
        pairs.join(held, "eval_pos").join(source, "eval_pos")
        .groupBy("split", "source")
        .agg(F.count("*").alias("eval_rows"), F.sum("same").alias("same_pairs"), F.sum("near").alias("near_pairs"))
    )
