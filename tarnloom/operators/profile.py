"""Profiling operators: histograms, buckets, duplicates, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bucketed(df: DataFrame, x: Column, edges: list[tuple[float, float, str]], extra: list[Column] | None = None) -> DataFrame:
    """``(bucket, n)`` for half-open buckets [lo, hi); empty buckets come with 0.
    NaN, infinity and null are in none."""
    label = F.lit(None).cast("string")
    for lo, hi, name in edges:
        label = F.when((x >= lo) & (x < hi) & ~F.isnan(x), F.lit(name)).otherwise(label)
    got = df.select(label.alias("bucket")).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"))
    spine = df.sparkSession.createDataFrame([(name,) for _, _, name in edges], "bucket string")
    return spine.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``(bin, lo, n)``: equal widths between the least and the greatest value; the
    last bin is closed.  One value only: all in bin 0.  Null and NaN are left out."""
    x = F.col(column).cast("double")
    ok = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    ends = ok.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    ok = ok.select("x", ends["lo"].alias("lo"), ends["hi"].alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    return ok.select(place.cast("int").alias("bin"), (F.col("lo") + place * width).alias("edge")).groupBy("bin").agg(F.min("edge").alias("lo"), F.count("*").alias("n"))


def duplicate_summary(df: DataFrame, key: list[str]) -> DataFrame:
    """``(keys, rows_in_groups, extra_copies)`` of the keys that occur twice or
    more; null keys are equal to each other."""
    g = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_copies"))


def top_k(df: DataFrame, key: str, pos: str, k: int, least: int = 1) -> DataFrame:
    """The k most frequent keys; at equal counts the one met first by ``pos``."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos")).where(F.col("n") >= least)
    return g.orderBy(F.desc("n"), "first_pos").limit(k).select(key, "n")
