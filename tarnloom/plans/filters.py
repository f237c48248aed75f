"""Filters, predicates and gates over the clip tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnloom.functions import scalars as S, text as T
from tarnloom.functions.ids import canonical_source, canonical_split, canonical_vid
from tarnloom.plans.registry import SOURCE_SQL, SPLIT_SQL, query, vid_sql

WPS_SQL = (
    "CASE WHEN word_count IS NULL OR duration_sec IS NULL THEN NULL"
    " WHEN duration_sec = 0 AND word_count > 0 THEN 'inf'::DOUBLE WHEN duration_sec = 0 AND word_count < 0 THEN '-inf'::DOUBLE"
    " WHEN duration_sec = 0 THEN 'nan'::DOUBLE ELSE word_count::DOUBLE / duration_sec END"
)


@query("f01_source_trimmed", "manifest", sql="SELECT pos, vid FROM manifest WHERE lower(trim(source)) = 'openasl'")
def source_trimmed(m: DataFrame, source: str = "openasl") -> DataFrame:
    """Rows of a source, whatever its spelling."""
    return m.where(canonical_source(F.col("source")) == source).select("pos", "vid")


@query("f02_source_exact", "manifest", sql="SELECT pos, vid FROM manifest WHERE source = 'openasl'")
def source_exact(m: DataFrame, source: str = "openasl") -> DataFrame:
    """Rows whose source is spelt exactly so."""
    return m.where(F.col("source") == source).select("pos", "vid")


@query("f03_duration_gate", "manifest", sql="SELECT pos, duration_sec FROM manifest WHERE duration_sec BETWEEN 1.3 AND 8.0")
def duration_gate(m: DataFrame, lo: float = 1.3, hi: float = 8.0) -> DataFrame:
    """Durations within the limits, both included; null and NaN are out."""
    return m.where(F.col("duration_sec").between(lo, hi)).select("pos", "duration_sec")


@query(
    "f04_duration_outliers", "clip_jobs",
    sql=f"""SELECT {SPLIT_SQL} AS split, count(*) AS clips,
      count(*) FILTER (WHERE duration_sec IS NULL OR duration_sec::VARCHAR = 'nan' OR duration_sec NOT BETWEEN 1.3 AND 8.0) AS outliers,
      count(*) FILTER (WHERE duration_sec < 1.3) AS too_short,
      count(*) FILTER (WHERE duration_sec::VARCHAR <> 'nan' AND duration_sec > 8.0) AS too_long
      FROM clip_jobs GROUP BY 1""",
)
def duration_outliers(jobs: DataFrame, lo: float = 1.3, hi: float = 8.0) -> DataFrame:
    """Outliers per split; what cannot be parsed is one, but neither short nor long."""
    d, bad = F.col("duration_sec"), F.col("duration_sec").isNull() | F.isnan("duration_sec")
    return jobs.groupBy(canonical_split(F.col("split")).alias("split")).agg(
        F.count("*").alias("clips"),
        F.count_if(bad | ~d.between(lo, hi)).alias("outliers"),
        F.count_if(d < lo).alias("too_short"),
        F.count_if(~F.isnan(d) & (d > hi)).alias("too_long"),
    )


SECONDS_SQL = (
    "CASE WHEN {c} LIKE '%:%' THEN TRY_CAST(string_split(trim({c}), ':')[1] AS DOUBLE) * 3600"
    " + TRY_CAST(string_split(trim({c}), ':')[2] AS DOUBLE) * 60 + TRY_CAST(string_split(trim({c}), ':')[3] AS DOUBLE)"
    " ELSE TRY_CAST(trim({c}) AS DOUBLE) END"
)


@query(
    "f05_bad_timing", "clip_jobs",
    sql=f"""WITH j AS (SELECT vid, {SECONDS_SQL.format(c='clip_start')} AS s, {SECONDS_SQL.format(c='clip_end')} AS e FROM clip_jobs)
      SELECT vid, round(s, 6) AS start_sec, round(e, 6) AS end_sec FROM j WHERE s IS NULL OR e IS NULL OR e - s <= 0""",
)
def bad_timing(jobs: DataFrame) -> DataFrame:
    """Jobs whose times cannot be parsed or do not run forward."""
    s, e = S.hms_seconds(F.col("clip_start")), S.hms_seconds(F.col("clip_end"))
    j = jobs.select("vid", s.alias("s"), e.alias("e"))
    j = j.where(F.col("s").isNull() | F.col("e").isNull() | (F.col("e") - F.col("s") <= 0))
    return j.select("vid", F.round("s", 6).alias("start_sec"), F.round("e", 6).alias("end_sec"))


@query(
    "f06_fast_speech_removed", "manifest",
    sql=f"""WITH w AS (SELECT pos, {WPS_SQL} AS wps FROM manifest)
      SELECT pos, CASE WHEN isinf(wps) THEN NULL ELSE round(wps, 6) END AS wps,
        coalesce(wps > 5.0 AND NOT isnan(wps), false) AS removed FROM w""",
)
def fast_speech(m: DataFrame, most: float = 5.0) -> DataFrame:
    """Every row with whether its words per second exceed ``most``.  NaN and null
    are kept, infinity is removed (shown as null)."""
    w = m.select("pos", S.wps(F.col("word_count"), F.col("duration_sec")).alias("wps"))
    removed = F.coalesce((F.col("wps") > most) & ~F.isnan("wps"), F.lit(False))
    shown = F.when(F.abs("wps") != float("inf"), F.round("wps", 6))
    return w.select("pos", shown.alias("wps"), removed.alias("removed"))


@query(
    "f07_speech_outliers", "manifest",
    sql=f"""WITH w AS (SELECT pos, {WPS_SQL} AS wps FROM manifest)
      SELECT pos, CASE WHEN wps < 0.5 THEN 'slow' ELSE 'fast' END AS kind FROM w
      WHERE NOT isnan(wps) AND (wps < 0.5 OR wps > 6.0)""",
)
def speech_outliers(m: DataFrame, lo: float = 0.5, hi: float = 6.0) -> DataFrame:
    w = m.select("pos", S.wps(F.col("word_count"), F.col("duration_sec")).alias("wps"))
    w = w.where(~F.isnan("wps") & ((F.col("wps") < lo) | (F.col("wps") > hi)))
    return w.select("pos", F.when(F.col("wps") < lo, "slow").otherwise("fast").alias("kind"))


@query(
    "f08_invalid_rate", "manifest",
    sql=f"""SELECT count(*) FILTER (WHERE w IS NULL OR isnan(w)) AS no_rate, count(*) FILTER (WHERE duration_sec = 0) AS zero_duration,
      count(*) FILTER (WHERE word_count = 0) AS zero_words FROM (SELECT *, {WPS_SQL} AS w FROM manifest)""",
)
def invalid_rate(m: DataFrame) -> DataFrame:
    w = S.wps(F.col("word_count"), F.col("duration_sec"))
    return m.agg(
        F.count_if(w.isNull() | F.isnan(w)).alias("no_rate"),
        F.count_if(F.col("duration_sec") == 0).alias("zero_duration"),
        F.count_if(F.col("word_count") == 0).alias("zero_words"),
    )


@query("f09_short_text", "manifest", sql="SELECT pos, word_count FROM manifest WHERE word_count <= 3")
def short_text(m: DataFrame, most: int = 3) -> DataFrame:
    return m.where(F.col("word_count") <= most).select("pos", "word_count")


@query(
    "f10_short_clip", "manifest",
    sql="SELECT pos FROM manifest WHERE coalesce(word_count, 0) <= 2 OR coalesce(duration_sec, 0.0) < 0.5",
)
def short_clip(m: DataFrame) -> DataFrame:
    """Few words or a short clip; what is missing counts as zero."""
    return m.where((F.coalesce("word_count", F.lit(0)) <= 2) | (F.coalesce("duration_sec", F.lit(0.0)) < 0.5)).select("pos")


_AUDITED = ["vid", "text", "duration_sec", "word_count", "file_path", "source", "split"]


@query(
    "f11_null_audit", "manifest",
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE {c}::VARCHAR = '') AS empties FROM manifest"
        for c in _AUDITED
    ),
)
def null_audit(m: DataFrame, columns: list[str] = _AUDITED) -> DataFrame:
    """Nulls and empty strings per column, in one pass."""
    counts = m.agg(*[x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.count_if(F.col(c).cast("string") == "").alias(f"e_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("nulls"), F.col(f"e_{c}").alias("empties")) for c in columns])
    return counts.select(F.inline(rows))


@query(
    "f12_file_exists", "manifest", "clip_jobs",
    sql=f"""WITH f AS (SELECT DISTINCT {vid_sql()} AS v FROM clip_jobs)
      SELECT m.pos FROM manifest m WHERE {vid_sql('m.vid')} IN (SELECT v FROM f)""",
)
def file_exists(m: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose clip is in the listing (here: has a job)."""
    have = listing.select(canonical_vid(F.col("vid")).alias("v")).distinct()
    return m.select("pos", canonical_vid(F.col("vid")).alias("v")).join(have, "v", "left_semi").select("pos")


@query("f13_failed_gate", "bbox", sql="SELECT vid, detection_rate FROM bbox WHERE NOT coalesce(failed, true)")
def failed_gate(b: DataFrame) -> DataFrame:
    """Records that did not fail; an unknown state counts as failed."""
    return b.where(~F.coalesce("failed", F.lit(True))).select("vid", "detection_rate")


@query("f14_no_letters", "manifest", sql=r"SELECT pos FROM manifest WHERE text IS NOT NULL AND NOT regexp_matches(text, '\p{L}')")
def no_letters(m: DataFrame) -> DataFrame:
    return m.where(~T.has_letters(F.col("text"))).select("pos")


_METRICS = ["detection_rate", "num_sampled_frames", "num_detected_frames"]


@query(
    "f15_zero_is_missing", "bbox",
    sql=" UNION ALL ".join(f"SELECT vid, '{m}' AS metric, {m}::DOUBLE AS value FROM bbox WHERE {m} > 0" for m in _METRICS),
)
def zero_is_missing(b: DataFrame, metrics: list[str] = _METRICS) -> DataFrame:
    """Metrics as long rows; zero means not evaluated and goes."""
    long = b.select("vid", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["vid"], metrics, "metric", "value")
    return long.where(F.col("value") > 0)


@query(
    "f16_unparsable_pairs", "clip_jobs",
    sql="""SELECT vid, TRY_CAST(clip_start AS DOUBLE) AS x, TRY_CAST(clip_end AS DOUBLE) AS y FROM clip_jobs
      WHERE TRY_CAST(clip_start AS DOUBLE) IS NOT NULL AND TRY_CAST(clip_end AS DOUBLE) IS NOT NULL""",
)
def parsable_pairs(jobs: DataFrame) -> DataFrame:
    """Pairs of which both sides are numbers."""
    x, y = F.col("clip_start").try_cast("double"), F.col("clip_end").try_cast("double")
    return jobs.select("vid", x.alias("x"), y.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())


@query(
    "f17_duration_delta", "manifest", "clip_jobs",
    sql=f"""WITH j AS (SELECT {vid_sql()} AS v, min(duration_sec) AS planned FROM clip_jobs WHERE duration_sec::VARCHAR <> 'nan' GROUP BY 1)
      SELECT {SOURCE_SQL} AS source, count(*) AS clips, count(*) FILTER (WHERE abs(m.duration_sec - planned) > 1.0) AS off
      FROM manifest m JOIN j ON j.v = {vid_sql('m.vid')} GROUP BY 1""",
)
def duration_delta(m: DataFrame, jobs: DataFrame, most: float = 1.0) -> DataFrame:
    """Clips whose duration differs from the planned one by more than ``most``."""
    j = jobs.where(F.col("duration_sec").isNotNull() & ~F.isnan("duration_sec")).groupBy(canonical_vid(F.col("vid")).alias("v")).agg(F.min("duration_sec").alias("planned"))
    both = m.select(canonical_vid(F.col("vid")).alias("v"), "duration_sec", canonical_source(F.col("source")).alias("source")).join(j, "v")
    return both.groupBy("source").agg(F.count("*").alias("clips"), F.count_if(F.abs(F.col("duration_sec") - F.col("planned")) > most).alias("off"))


@query("f18_output_size", "documents", sql="SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500")
def output_size(d: DataFrame, least: int = 500) -> DataFrame:
    """Outputs of a sane size (here: stated characters of a document)."""
    return d.where(F.col("n_chars") >= least).select("doc_id", "n_chars")


@query(
    "f19_coordinate_range", "bbox",
    sql="""WITH c AS (SELECT vid, unnest([x1::DOUBLE / frame_width, x2::DOUBLE / frame_width, y1::DOUBLE / frame_height, y2::DOUBLE / frame_height]) AS v
        FROM bbox WHERE frame_width > 0 AND frame_height > 0)
      SELECT vid, round(min(v), 9) AS lo, round(max(v), 9) AS hi FROM c WHERE v IS NOT NULL GROUP BY vid HAVING min(v) < -0.01 OR max(v) > 1.01""",
)
def coordinate_range(b: DataFrame, lo: float = -0.01, hi: float = 1.01) -> DataFrame:
    """Clips with a box coordinate, as a share of the frame, outside the limits."""
    ok = b.where((F.col("frame_width") > 0) & (F.col("frame_height") > 0))
    parts = F.array_compact(F.array(F.col("x1") / F.col("frame_width"), F.col("x2") / F.col("frame_width"), F.col("y1") / F.col("frame_height"), F.col("y2") / F.col("frame_height")))
    per = ok.select("vid", parts.alias("c")).groupBy("vid").agg(F.min(F.array_min("c")).alias("lo"), F.max(F.array_max("c")).alias("hi"))
    return per.where((F.col("lo") < lo) | (F.col("hi") > hi)).select("vid", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query(
    "f20_monotonic_steps", "gen_samples",
    sql="""WITH s AS (SELECT source, global_step, lag(global_step) OVER (PARTITION BY source ORDER BY logged_at, reference, hypothesis) AS before FROM gen_samples)
      SELECT source, count(*) FILTER (WHERE global_step <= before) AS not_rising, bool_and(before IS NULL OR global_step > before) AS rising
      FROM s GROUP BY source""",
)
def monotonic_steps(g: DataFrame) -> DataFrame:
    """Whether steps strictly rise in order of logging, per source."""
    from pyspark.sql import Window as W

    before = F.lag("global_step").over(W.partitionBy("source").orderBy("logged_at", "reference", "hypothesis"))
    s = g.select("source", "global_step", before.alias("before"))
    rises = F.col("before").isNull() | (F.col("global_step") > F.col("before"))
    return s.groupBy("source").agg(F.count_if(F.col("global_step") <= F.col("before")).alias("not_rising"), F.bool_and(rises).alias("rising"))


@query(
    "f20_monotonic_arrays", "embeddings",
    sql="""SELECT vec_id, list_aggregate(list_transform(generate_series(1, len(embedding) - 1), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 0 ELSE 1 END), 'sum') = 0 AS rising,
      embedding[1] = 0 AS from_zero FROM embeddings""",
)
def monotonic_arrays(e: DataFrame) -> DataFrame:
    """The same within an array: strictly rising, and from zero."""
    v, n = F.col("embedding"), F.size("embedding")
    steps = F.zip_with(F.slice(v, F.lit(1), n - 1), F.slice(v, F.lit(2), n - 1), lambda a, b: b > a)
    return e.select("vec_id", F.forall(steps, lambda ok: ok).alias("rising"), (F.get(v, F.lit(0)) == 0).alias("from_zero"))


@query(
    "f21_fail_rate_alerts", "bbox",
    sql=f"""SELECT {SOURCE_SQL} AS source, count(*) AS records, round(avg(CASE WHEN coalesce(failed, true) THEN 1.0 ELSE 0.0 END), 6) AS fail_rate,
      CASE WHEN avg(CASE WHEN coalesce(failed, true) THEN 1.0 ELSE 0.0 END) > 0.2 THEN 'critical' ELSE 'warning' END AS level
      FROM bbox GROUP BY 1 HAVING avg(CASE WHEN coalesce(failed, true) THEN 1.0 ELSE 0.0 END) > 0.05""",
)
def fail_rate_alerts(b: DataFrame, warn: float = 0.05, critical: float = 0.2) -> DataFrame:
    rate = F.avg(F.coalesce("failed", F.lit(True)).cast("double"))
    per = b.groupBy(canonical_source(F.col("source")).alias("source")).agg(F.count("*").alias("records"), rate.alias("r")).where(F.col("r") > warn)
    return per.select("source", "records", F.round("r", 6).alias("fail_rate"), F.when(F.col("r") > critical, "critical").otherwise("warning").alias("level"))


@query(
    "f22_clip_report", "lineitem",
    sql=" UNION ALL ".join(
        f"""SELECT l_orderkey, l_linenumber, '{c}' AS tier, round({c} / {k}, 8) AS ratio, {c} / {k} > 2 AS loud FROM lineitem WHERE {c} > 1.1 * {k}"""
        for c, k in (("l_quantity", 20.0), ("l_extendedprice", 40000.0), ("l_tax", 0.05))
    ),
)
def clip_report(t: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Values of several tiers that exceed their limit by a tenth; loud at twice."""
    limits = limits or {"l_quantity": 20.0, "l_extendedprice": 40000.0, "l_tax": 0.05}
    long = t.select("l_orderkey", "l_linenumber", *limits).unpivot(["l_orderkey", "l_linenumber"], list(limits), "tier", "value")
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("tier")]
    over = long.withColumn("limit", limit).where(F.col("value") > 1.1 * F.col("limit"))
    ratio = F.col("value") / F.col("limit")
    return over.select("l_orderkey", "l_linenumber", "tier", F.round(ratio, 8).alias("ratio"), (ratio > 2).alias("loud"))
