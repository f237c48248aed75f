"""Incremental forms: resume, idempotent batches, logs, completion, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def pending(tasks: DataFrame, done: DataFrame, key: str, failed: Column | None = None) -> DataFrame:
    """Tasks without a good result; failed ones are tried again."""
    good = done.where(~F.coalesce(failed, F.lit(False))) if failed is not None else done
    return tasks.join(good.select(key).distinct(), key, "left_anti")


def stream_files(spark: SparkSession, path: str, schema: str, form: str = "parquet", per_trigger: int = 100, **options) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", per_trigger).options(**options).load(path)


def run_available(df: DataFrame, target: str, checkpoint: str, form: str = "parquet", mode: str = "append") -> None:
    """What is there is processed once and appended; a later call goes on from the
    checkpoint."""
    df.writeStream.format(form).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(target).awaitTermination()


def upsert_new(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows whose key is not in the target yet are appended, one
    per key; a batch that is run twice adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            have = spark.read.parquet(target).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(have, key, "left_anti")
        new.write.mode("append").parquet(target)

    return write


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def completion(df: DataFrame, key: str, total: Column, done: Column) -> DataFrame:
    """Progress per key, batch or stream (update or complete mode)."""
    return df.groupBy(key).agg(F.max(total).alias("total"), F.count_if(done).alias("done"), (F.count_if(done) >= F.max(total)).alias("complete"))


def windowed(df: DataFrame, at: str, size: str, late: str, key: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window and key; rows later than ``late`` behind
    the newest are dropped in a stream.  An extension: the batch chain has no
    event time."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = df.withWatermark(at, late).groupBy(w.alias("w"), *key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *key, "n", "total")


def sessions(df: DataFrame, at: str, gap: str, late: str, key: list[str]) -> DataFrame:
    g = df.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *key, "n")
