"""Incremental queries: each is run as a stream over files and gives the answer that
one batch over the same rows gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnloom.functions.ids import canonical_vid
from tarnloom.plans.lineage import scratch, table
from tarnloom.plans.registry import query, vid_sql
from tarnloom.plans.scans import with_session
from tarnloom.streaming import incremental as I


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


@with_session("x01_resumed_stream", sql=f"SELECT {vid_sql()} AS vid, count(*) AS jobs FROM clip_jobs GROUP BY 1")
def resumed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Jobs processed by a file stream in two runs; the second goes on where the
    first ended."""
    jobs = table(spark, d, "clip_jobs").select(canonical_vid(F.col("vid")).alias("vid"), "source_file")
    src, out, check = scratch(spark, "jobs"), scratch(spark, "done"), scratch(spark, "check")
    odd = F.pmod(F.xxhash64("vid"), F.lit(2)) == 1
    for part in (jobs.where(odd), jobs.where(~odd)):
        part.write.mode("append").parquet(src)
        I.run_available(I.stream_files(spark, src, _ddl(jobs)), out, check)
    return spark.read.parquet(out).groupBy("vid").agg(F.count("*").alias("jobs"))


@with_session("x02_idempotent_batches", sql=f"SELECT DISTINCT {vid_sql()} AS vid FROM manifest")
def idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Outputs that exist are skipped: the same files twice add nothing."""
    m = table(spark, d, "manifest").select(canonical_vid(F.col("vid")).alias("vid"))
    src, out = scratch(spark, "src"), scratch(spark, "out")
    m.repartition(4).write.parquet(src)
    for _ in range(2):
        I.run_batches(I.stream_files(spark, src, "vid string", per_trigger=2), I.upsert_new(out, "vid"), scratch(spark, "check"))
    return spark.read.parquet(out)


@with_session("x03_log_stream", sql="SELECT global_step, source FROM gen_samples")
def log_stream(spark: SparkSession, d: str) -> DataFrame:
    """A log of CSV files read as a stream and appended to a table."""
    g = table(spark, d, "gen_samples").select("global_step", "source")
    src, out = scratch(spark, "log"), scratch(spark, "table")
    g.repartition(3).write.csv(src, header=True)
    I.run_available(I.stream_files(spark, src, "global_step long, source string", "csv", header="true"), out, scratch(spark, "check"))
    return spark.read.schema("global_step long, source string").parquet(out)


@with_session(
    "x05_completion", sql="SELECT user_id, count(*) AS done FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def completion_stream(spark: SparkSession, d: str) -> DataFrame:
    """Progress per key in complete mode, as of the last batch."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    src, out = scratch(spark, "events"), scratch(spark, "progress")
    e.repartitionByRange(4, "event_id").write.parquet(src)
    stream = I.stream_files(spark, src, _ddl(e), per_trigger=2)
    progress = I.completion(stream, "user_id", F.lit(1), F.col("event_type") != "error")
    I.run_batches(progress, lambda b, _: b.write.mode("overwrite").parquet(out), scratch(spark, "check"), "complete")
    return spark.read.parquet(out).where("done > 0").select("user_id", "done")


@query("x06_staged_commit", "documents", sql="SELECT doc_kind, count(*) AS n FROM documents GROUP BY 1")
def staged_commit(docs: DataFrame) -> DataFrame:
    """A stage's result is kept until the final one is committed."""
    from tarnloom.plans.lineage import cut
    from tarnloom.sources import writers as K

    spark = docs.sparkSession
    stage = cut(docs.select("doc_kind", "doc_id"), "stage")
    root = scratch(spark, "final")
    K.commit_version(stage.groupBy("doc_kind").agg(F.count("*").alias("n")), root)
    return K.read_current(spark, root)


@query("x07_skip_batches", "manifest", sql="SELECT pos, batch FROM (SELECT pos, (row_number() OVER (ORDER BY duration_sec, pos) - 1) // 32 AS batch FROM manifest WHERE duration_sec IS NOT NULL) WHERE batch >= 10")
def skip_batches(m: DataFrame, first: int = 10) -> DataFrame:
    from tarnloom.plans.windows import batches

    return batches(m).where(F.col("batch") >= first)


@with_session(
    "x08_tumbling_stream",
    sql="SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    """An extension: hourly windows over event time with a watermark, files in order
    of time."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    src, out = scratch(spark, "events"), scratch(spark, "hours")
    e.repartitionByRange(4, "ts").write.parquet(src)
    w = I.windowed(I.stream_files(spark, src, _ddl(e), per_trigger=4), "ts", "1 hour", "30 days", ["event_type"], "value")
    I.run_batches(w, lambda b, _: b.write.mode("overwrite").parquet(out), scratch(spark, "check"), "complete")
    return spark.read.parquet(out).select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "x09_sessions", "events",
    sql="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_windows(e: DataFrame) -> DataFrame:
    """An extension: session windows with a gap of six hours."""
    t = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return I.sessions(t, "ts", "6 hours", "1 day", ["user_id"]).select("user_id", F.unix_micros("start").alias("start"), "n")
