"""Ordered series: de-orphaning, smoothing, gap filling, spikes, early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def deorphaned(df: DataFrame, key: list[str], order: list[str], step: Column) -> DataFrame:
    """The rows of a run log that a later rewind did not replace: a row stays if its
    step is below every later step up to the next row whose step cannot be parsed.
    Such rows always stay and stop the rewind."""
    w = W.partitionBy(*key).orderBy(*order)
    g = df.withColumn("_s", step).withColumn("_g", F.count_if(F.col("_s").isNull()).over(w.rowsBetween(W.unboundedPreceding, 0)))
    later = F.min("_s").over(W.partitionBy(*key, "_g").orderBy(*order).rowsBetween(1, W.unboundedFollowing))
    kept = g.withColumn("_m", later).where(F.col("_s").isNull() | F.col("_m").isNull() | (F.col("_s") < F.col("_m")))
    return kept.drop("_s", "_g", "_m")


def moving_average(value: str, key: list[str], order: list[str], window: int) -> Column:
    """Centred; the window shrinks at the edges.  Half of it lies on either side, so
    an even width counts one more; up to 1 the value itself."""
    half = window // 2
    return F.col(value) if window <= 1 else F.avg(value).over(W.partitionBy(*key).orderBy(*order).rowsBetween(-half, half))


def despiked(df: DataFrame, value: str, key: list[str], order: list[str], most: float) -> DataFrame:
    """Values farther than ``most`` from the middle of their two neighbours made
    missing.  Only original values are read; ends and rows beside a gap stay."""
    w = W.partitionBy(*key).orderBy(*order)
    mid = (F.lag(value).over(w) + F.lead(value).over(w)) / 2
    return df.withColumn("_d", F.abs(F.col(value) - mid)).withColumn(value, F.when(F.coalesce(F.col("_d") <= most, F.lit(True)), F.col(value))).drop("_d")


def filled(df: DataFrame, value: str, key: list[str], order: list[str], most: int) -> DataFrame:
    """Gaps of at most ``most`` missing values take the last value before them, if a
    value comes before and after.  Leading and trailing gaps stay missing."""
    w = W.partitionBy(*key).orderBy(*order)
    g = df.withColumn("_g", F.count(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = F.max(F.col("_g")).over(W.partitionBy(*key))
    size = F.count_if(F.col(value).isNull()).over(W.partitionBy(*key, "_g"))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    g = g.withColumn("_l", last).withColumn("_n", size).withColumn("_b", before)
    ok = (F.col("_g") > 0) & (F.col("_g") < F.col("_l")) & (F.col("_n") <= most)
    return g.withColumn(value, F.when(F.col(value).isNull() & ok, F.col("_b")).otherwise(F.col(value))).drop("_g", "_l", "_n", "_b")


def smoothed(df: DataFrame, values: list[str], key: list[str], order: list[str]) -> DataFrame:
    """Three taps (1, 2, 1) / 4 on every value of a row, but only where none of the
    values is missing in the row and both neighbours."""
    w = W.partitionBy(*key).orderBy(*order)
    whole = F.lit(True)
    for v in values:
        whole = whole & F.lag(v).over(w).isNotNull() & F.col(v).isNotNull() & F.lead(v).over(w).isNotNull()
    out = df.withColumn("_w", whole).withColumns({f"_{v}": F.lag(v).over(w) * 0.25 + F.col(v) * 0.5 + F.lead(v).over(w) * 0.25 for v in values})
    out = out.withColumns({v: F.when(F.col("_w"), F.col(f"_{v}")).otherwise(F.col(v)) for v in values})
    return out.drop("_w", *[f"_{v}" for v in values])


def patience(df: DataFrame, value: str, key: list[str], order: list[str]) -> DataFrame:
    """``best_before`` (the least value so far, before the row), ``improved`` (strictly
    below it) and ``waited`` (rows since the last improvement)."""
    w = W.partitionBy(*key).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, -1)
    g = df.withColumn("best_before", F.min(value).over(upto))
    g = g.withColumn("improved", F.col("best_before").isNull() | (F.col(value) < F.col("best_before")))
    g = g.withColumn("_i", F.count_if("improved").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.withColumn("waited", F.row_number().over(W.partitionBy(*key, "_i").orderBy(*order)) - 1).drop("_i")
