"""Clip ids, split names and source names in their canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Spellings of a split, by canonical name (fixed values).
SPLIT_NAMES = {
    "train": ["train", "training"],
    "val": ["val", "valid", "validation", "dev"],
    "test": ["test"],
}


def strip(c: Column) -> Column:
    """Edge white space of any kind removed (Spark's ``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canonical_vid(c: Column) -> Column:
    """Blanks around and ``.mp4`` behind removed, dots in the times made colons.
    Values of no known form stay as they are after trimming; null stays null."""
    bare = F.regexp_replace(strip(c), r"\.mp4$", "")
    return F.regexp_replace(
        bare,
        r"^(.{11})-(\d\d)[.:](\d\d)[.:](\d\d\.\d{3})-(\d\d)[.:](\d\d)[.:](\d\d\.\d{3})$",
        "$1-$2:$3:$4-$5:$6:$7",
    )


def recording(vid: Column) -> Column:
    """The 11 characters of a vid that name its recording; null if the vid is
    null or too short to hold one."""
    bare = strip(vid)
    return F.when(F.length(bare) >= 11, F.substring(bare, 1, 11))


def canonical_split(c: Column) -> Column:
    """train, val or test; null for null and unknown names."""
    low = F.lower(strip(c))
    out = F.lit(None).cast("string")
    for name, spellings in SPLIT_NAMES.items():
        out = F.when(low.isin(spellings), F.lit(name)).otherwise(out)
    return out


def canonical_source(c: Column) -> Column:
    return F.lower(strip(c))
