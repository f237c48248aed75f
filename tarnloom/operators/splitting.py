"""Stratified splitting by hash, sampling and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tarnloom.plans.lineage import cut


def hash_key(seed: int, key: str) -> Column:
    """The order of a seeded draw: MD5 of seed and key, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _ranges(df: DataFrame, by: list[Column | str], per_block: int) -> DataFrame:
    """``df`` in sorted range partitions with their number ``_p``, written once, since
    the numbers must not change between their uses."""
    n = max(1, -(-df.count() // per_block))
    return cut(df.repartitionByRange(n, *by).withColumn("_p", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, keys: list[str], by: list[str], value: str, out: str, per_block: int = 200_000) -> DataFrame:
    """``out``: the sum of ``value`` up to the row within ``keys`` in the order ``by``.
    Range partitions are summed apart and offset by what lies before them, so that a
    key of any number of rows is spread over tasks.  Null keys are a group."""
    parts = _ranges(df, [*keys, *by], per_block)
    total = parts.groupBy(*keys, "_p").agg(F.sum(value).alias("_t"))
    before = F.sum("_t").over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    offset = total.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.sum(value).over(W.partitionBy(*keys, "_p").orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    cond = F.col("_p") == F.col("_q")
    for k, n in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    return parts.withColumn("_i", inside).join(offset, cond).withColumn(out, F.col("_i") + F.col("_o")).drop("_p", "_q", "_i", "_o", *names.values())


def ranked(df: DataFrame, by: list[Column | str], out: str = "rank", per_block: int = 200_000) -> DataFrame:
    """``out``: a global rank from 0 in the order ``by``, without sorting all rows in
    one task: range partitions are sorted apart and offset by their sizes."""
    parts = _ranges(df, by, per_block)
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    offset = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(W.partitionBy("_p").orderBy(*by)) - 1
    return parts.withColumn("_r", rank).join(offset, "_p").withColumn(out, F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")


def stratified(df: DataFrame, key: str, stratum: Column, seed: int = 42, val: float = 0.05, test: float = 0.05, per_block: int = 200_000) -> DataFrame:
    """``df`` with ``new_split``: per stratum the shares rounded half to even, train
    the rest, dealt in order train, val, test of the seeded hash.  A stratum of any
    size is ranked over range partitions."""
    d = df.withColumn("_s", stratum).withColumn("_h", hash_key(seed, key))
    placed = ranked(d, ["_s", "_h", key], "_g", per_block)
    n = placed.groupBy(F.col("_s").alias("_k")).agg(F.count("*").alias("_n"), F.min("_g").alias("_f"))
    n = n.withColumn("_v", F.bround(F.col("_n") * val)).withColumn("_t", F.bround(F.col("_n") * test))
    joined = placed.join(n, F.col("_s").eqNullSafe(F.col("_k"))).withColumn("_r", F.col("_g") - F.col("_f") + 1)
    train = F.col("_n") - F.col("_v") - F.col("_t")
    split = F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + F.col("_v"), "val").otherwise("test")
    return joined.withColumn("new_split", split).drop("_s", "_k", "_h", "_g", "_f", "_n", "_v", "_t", "_r")


def batches(df: DataFrame, by: list[Column | str], size: int, out: str = "batch") -> DataFrame:
    """Batches of ``size`` rows in the order ``by``; the last may be smaller."""
    return ranked(df, by, "_rank").withColumn(out, F.floor(F.col("_rank") / size)).drop("_rank")
