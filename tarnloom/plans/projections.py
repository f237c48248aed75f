"""Projections: paths, boxes, indices, schedules, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnloom.functions import scalars as S
from tarnloom.functions.ids import canonical_source, canonical_split, canonical_vid
from tarnloom.plans.filters import SECONDS_SQL, WPS_SQL
from tarnloom.plans.registry import SOURCE_SQL, SPLIT_SQL, query, vid_sql


@query(
    "p01_wps", "manifest",
    sql=f"""WITH w AS (SELECT pos, {WPS_SQL} AS w FROM manifest)
      SELECT pos, CASE WHEN isinf(w) OR isnan(w) THEN NULL ELSE round(w, 6) END AS wps, coalesce(isinf(w), false) AS infinite, coalesce(isnan(w), false) AS undefined FROM w""",
)
def words_per_second(m: DataFrame) -> DataFrame:
    w = m.select("pos", S.wps(F.col("word_count"), F.col("duration_sec")).alias("w"))
    inf, nan = F.coalesce(F.abs("w") == float("inf"), F.lit(False)), F.coalesce(F.isnan("w"), F.lit(False))
    return w.select("pos", F.when(~inf & ~nan, F.round("w", 6)).alias("wps"), inf.alias("infinite"), nan.alias("undefined"))


@query("p02_guarded_wps", "manifest", sql="SELECT pos, round(word_count / duration_sec, 6) AS wps FROM manifest WHERE word_count > 0 AND duration_sec > 0")
def guarded(m: DataFrame) -> DataFrame:
    w = m.select("pos", S.guarded_wps(F.col("word_count"), F.col("duration_sec")).alias("wps"))
    return w.where(F.col("wps").isNotNull()).select("pos", F.round("wps", 6).alias("wps"))


@query(
    "p03_seconds", "clip_jobs",
    sql=f"SELECT vid, clip_start, round({SECONDS_SQL.format(c='clip_start')}, 6) AS seconds FROM clip_jobs",
)
def seconds(jobs: DataFrame) -> DataFrame:
    return jobs.select("vid", "clip_start", F.round(S.hms_seconds(F.col("clip_start")), 6).alias("seconds"))


@query(
    "p04_clip_length", "clip_jobs",
    sql=f"""WITH j AS (SELECT vid, {SECONDS_SQL.format(c='clip_start')} AS s, {SECONDS_SQL.format(c='clip_end')} AS e FROM clip_jobs)
      SELECT vid, round(greatest(e - s, 0.1), 6) AS seconds FROM j WHERE e - s IS NOT NULL""",
)
def clip_length(jobs: DataFrame) -> DataFrame:
    s, e = S.hms_seconds(F.col("clip_start")), S.hms_seconds(F.col("clip_end"))
    return jobs.select("vid", s.alias("s"), e.alias("e")).where(F.col("s").isNotNull() & F.col("e").isNotNull()).select("vid", F.round(S.clip_length(F.col("s"), F.col("e")), 6).alias("seconds"))


@query(
    "p05_safe_names", "manifest",
    sql="SELECT pos, replace(vid, ':', '.') AS dots, replace(vid, ':', '-') AS dashes, replace(vid, ':', '_') AS underscores FROM manifest",
)
def safe_names(m: DataFrame) -> DataFrame:
    v = F.col("vid")
    return m.select("pos", S.safe_name(v).alias("dots"), S.safe_name(v, "-").alias("dashes"), S.safe_name(v, "_").alias("underscores"))


@query(
    "p06_clip_paths", "manifest",
    sql=f"""SELECT pos, CASE WHEN {SOURCE_SQL} = 'how2sign' THEN 'clips/how2sign' ELSE 'clips/openasl' END
        || coalesce('/' || {SPLIT_SQL}, '') || '/' || CASE WHEN {SOURCE_SQL} = 'how2sign' THEN {vid_sql()} ELSE replace({vid_sql()}, ':', '.') END || '.mp4' AS path FROM manifest""",
)
def clip_paths(m: DataFrame) -> DataFrame:
    path = S.clip_path(canonical_source(F.col("source")), canonical_vid(F.col("vid")), canonical_split(F.col("split")))
    return m.select("pos", path.alias("path"))


@query(
    "p07_remapped_paths", "clip_jobs",
    sql=f"""WITH p AS (SELECT vid, 'D:' || chr(92) || 'set' || chr(92) || replace(source_file, '/', chr(92)) AS old FROM clip_jobs)
      SELECT vid, old, 'mnt/' || string_split(old, chr(92))[3] || '/' || string_split(old, chr(92))[3] || '/' || string_split(old, chr(92))[4] || '/' || string_split(old, chr(92))[5] AS new FROM p""",
)
def remapped_paths(jobs: DataFrame) -> DataFrame:
    old = F.concat(F.lit("D:\\set\\"), F.replace("source_file", F.lit("/"), F.lit("\\")))
    return jobs.select("vid", old.alias("old")).select("vid", "old", S.remapped_path(F.col("old"), "mnt").alias("new"))


@query(
    "p08_stems", "clip_jobs",
    sql=r"""SELECT vid, coalesce(nullif(regexp_extract(source_file, '([^/\\]+?)(\.[^./\\]*)?$', 1), ''), substring(vid, 1, 11)) AS stem FROM clip_jobs""",
)
def stems(jobs: DataFrame) -> DataFrame:
    return jobs.select("vid", S.stem(F.col("source_file"), F.col("vid")).alias("stem"))


@query(
    "p09_padded_boxes", "bbox",
    sql="""WITH b AS (SELECT vid, x1::DOUBLE / frame_width AS a, x2::DOUBLE / frame_width AS b FROM bbox WHERE frame_width > 0 AND x1 IS NOT NULL AND x2 IS NOT NULL)
      SELECT vid, round(greatest(a - (b - a) * 0.03, 0.0), 11) AS left_edge, round(least(b + (b - a) * 0.03, 1.0), 11) AS right_edge FROM b""",
)
def padded_boxes(b: DataFrame) -> DataFrame:
    ok = b.where((F.col("frame_width") > 0) & F.col("x1").isNotNull() & F.col("x2").isNotNull())
    lo, hi = S.padded_box(F.col("x1") / F.col("frame_width"), F.col("x2") / F.col("frame_width"))
    return ok.select("vid", F.round(lo, 11).alias("left_edge"), F.round(hi, 11).alias("right_edge"))


@query(
    "p10_box_of_points", "bbox",
    sql="""WITH p AS (SELECT vid, unnest([x1, x2]) AS x, unnest([y1, y2]) AS y, frame_width AS fw, frame_height AS fh FROM bbox WHERE x1 IS NOT NULL AND frame_width > 0),
      g AS (SELECT vid, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, max(fw) AS fw, max(fh) AS fh FROM p GROUP BY vid)
      SELECT vid, round_even(greatest(a - (b - a) * 0.25, 0.0), 0)::INT AS x1, round_even(greatest(c - (d - c) * 0.25, 0.0), 0)::INT AS y1,
        round_even(least(b + (b - a) * 0.25, fw), 0)::INT AS x2, round_even(least(d + (d - c) * 0.25, fh), 0)::INT AS y2 FROM g""",
)
def box_of_points(b: DataFrame, pad: float = 0.25) -> DataFrame:
    """The box around all points of a clip, padded, kept in the frame, rounded
    half to even."""
    pts = b.where(F.col("x1").isNotNull() & (F.col("frame_width") > 0)).select(
        "vid", "frame_width", "frame_height", F.inline(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    )
    g = pts.groupBy("vid").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"), F.max("frame_width").alias("fw"), F.max("frame_height").alias("fh"))
    lo = lambda p, q: F.bround(F.greatest(F.col(p) - (F.col(q) - F.col(p)) * pad, F.lit(0.0))).cast("int")
    hi = lambda p, q, top: F.bround(F.least(F.col(q) + (F.col(q) - F.col(p)) * pad, F.col(top).cast("double"))).cast("int")
    return g.select("vid", lo("a", "b").alias("x1"), lo("c", "d").alias("y1"), hi("a", "b", "fw").alias("x2"), hi("c", "d", "fh").alias("y2"))


@query(
    "p11_rescaled_boxes", "bbox",
    sql="""SELECT vid, x1, frame_width, round_even(x1 * 640.0 / greatest(frame_width, 1), 0)::INT AS new_x1, round_even(x2 * 640.0 / greatest(frame_width, 1), 0)::INT AS new_x2
      FROM bbox WHERE x1 IS NOT NULL AND (x2 - x1) >= 32 AND (y2 - y1) >= 32""",
)
def rescaled_boxes(b: DataFrame, width: int = 640) -> DataFrame:
    """Boxes of at least 32 pixels at another frame width."""
    ok = b.where((F.col("x2") - F.col("x1") >= 32) & (F.col("y2") - F.col("y1") >= 32))
    at = lambda c: S.rescaled(F.col(c), F.col("frame_width"), F.lit(float(width))).alias(f"new_{c}")
    return ok.select("vid", "x1", "frame_width", at("x1"), at("x2"))


@query(
    "p12_snapped_boxes", "bbox",
    sql="""WITH b AS (SELECT vid, x1, x2, greatest((x2 - x1) // 32 * 32, 32) AS w FROM bbox WHERE x1 IS NOT NULL)
      SELECT vid, (x1 + floor((x2 - x1 - w) / 2))::INT AS lo, (x1 + floor((x2 - x1 - w) / 2) + w)::INT AS hi FROM b""",
)
def snapped_boxes(b: DataFrame) -> DataFrame:
    lo, hi = S.snapped(F.col("x1"), F.col("x2"))
    return b.where(F.col("x1").isNotNull()).select("vid", lo.alias("lo"), hi.alias("hi"))


@query(
    "p13_sample_indices", "bbox",
    sql="""SELECT vid, CASE WHEN num_sampled_frames < 1 THEN [] WHEN (num_sampled_frames - 1) % 4 = 0 THEN range(0, num_sampled_frames, 4)
        ELSE list_append(range(0, num_sampled_frames, 4), num_sampled_frames - 1) END AS indices FROM bbox WHERE num_sampled_frames IS NOT NULL""",
)
def sample_indices(b: DataFrame) -> DataFrame:
    ok = b.where(F.col("num_sampled_frames").isNotNull())
    return ok.select("vid", S.sample_indices(F.col("num_sampled_frames"), F.lit(4)).alias("indices"))


@query(
    "p14_aspect", "bbox",
    sql="""SELECT DISTINCT frame_width, frame_height, (frame_width // gcd(frame_width, frame_height))::VARCHAR || ':' || (frame_height // gcd(frame_width, frame_height))::VARCHAR AS aspect
      FROM bbox WHERE frame_width > 0 AND frame_height > 0""",
)
def aspects(b: DataFrame) -> DataFrame:
    sizes = b.where((F.col("frame_width") > 0) & (F.col("frame_height") > 0)).select("frame_width", "frame_height").distinct()
    return sizes.select("frame_width", "frame_height", S.aspect(F.col("frame_width"), F.col("frame_height")).alias("aspect"))


@query(
    "p15_rational_rate", "bbox",
    sql="SELECT vid, num_sampled_frames, num_detected_frames, round(num_sampled_frames::DOUBLE / nullif(num_detected_frames, 0), 4) AS rate FROM bbox WHERE num_sampled_frames IS NOT NULL",
)
def rational_rate(b: DataFrame) -> DataFrame:
    """``n/m`` texts read as numbers; a zero denominator gives null."""
    text = F.concat_ws("/", F.col("num_sampled_frames").cast("string"), F.coalesce(F.col("num_detected_frames").cast("string"), F.lit("0")))
    return b.where(F.col("num_sampled_frames").isNotNull()).select("vid", "num_sampled_frames", "num_detected_frames", S.rational(text).alias("rate"))


@query(
    "p16_trim_status", "manifest", "clip_jobs",
    sql=f"""WITH j AS (SELECT {vid_sql()} AS v, min(CASE WHEN duration_sec::VARCHAR = 'nan' THEN NULL ELSE duration_sec END) AS planned FROM clip_jobs GROUP BY 1),
      a AS (SELECT pos, planned, duration_sec AS actual, j.v IS NOT NULL AS found FROM manifest m LEFT JOIN j ON j.v = {vid_sql('m.vid')})
      SELECT pos, CASE WHEN NOT found THEN 'MISSING' WHEN actual IS NULL THEN 'FFPROBE_ERROR' WHEN planned IS NULL THEN 'BAD_TSV_TIMING'
        WHEN abs(actual - planned) <= 2.0 THEN 'ALREADY_TRIMMED' WHEN actual - planned > 2.0 THEN 'NEEDS_TRIM' ELSE 'CLIP_TOO_SHORT' END AS status FROM a""",
)
def trim_status(m: DataFrame, jobs: DataFrame) -> DataFrame:
    planned = F.min(F.when(~F.isnan("duration_sec"), F.col("duration_sec")))
    j = jobs.groupBy(canonical_vid(F.col("vid")).alias("v")).agg(planned.alias("planned"), F.lit(True).alias("found"))
    a = m.select("pos", canonical_vid(F.col("vid")).alias("v"), "duration_sec").join(j, "v", "left")
    return a.select("pos", S.trim_status(F.coalesce("found", F.lit(False)), F.col("planned"), F.col("duration_sec")).alias("status"))


@query(
    "p17_in_range", "clip_jobs",
    sql="SELECT vid, CASE WHEN duration_sec::VARCHAR <> 'nan' THEN duration_sec END AS duration_sec, CASE WHEN duration_sec IS NULL OR duration_sec::VARCHAR = 'nan' THEN '' WHEN duration_sec BETWEEN 1.3 AND 8.0 THEN 'YES' ELSE 'NO' END AS flag FROM clip_jobs",
)
def in_range(jobs: DataFrame) -> DataFrame:
    """Whether a duration lies in the wanted range; NaN durations come out as null."""
    return jobs.select("vid", F.when(~F.isnan("duration_sec"), F.col("duration_sec")).alias("duration_sec"), S.in_range(F.col("duration_sec")).alias("flag"))


@query(
    "p18_percent", "bbox",
    sql=f"SELECT {SOURCE_SQL} AS source, round(100.0 * count(*) FILTER (WHERE failed) / greatest(count(*), 1), 6) AS failed_percent FROM bbox GROUP BY 1",
)
def percent(b: DataFrame) -> DataFrame:
    pct = S.percent(F.count_if(F.col("failed")), F.count("*"))
    return b.groupBy(canonical_source(F.col("source")).alias("source")).agg(F.round(pct, 6).alias("failed_percent"))


@query(
    "p19_spoken_duration", "events",
    sql="""WITH s AS (SELECT event_id, (value * 1000)::BIGINT AS s FROM events)
      SELECT event_id, CASE WHEN s >= 86400 THEN format('{}d {}h {}m {}s', s // 86400, s % 86400 // 3600, s % 3600 // 60, s % 60)
        WHEN s >= 3600 THEN format('{}h {}m {}s', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN format('{}m {}s', s // 60, s % 60) ELSE format('{}s', s) END AS spoken FROM s""",
)
def spoken_duration(e: DataFrame) -> DataFrame:
    return e.select("event_id", S.spoken_duration(F.bround(F.col("value") * 1000).cast("long")).alias("spoken"))


@query("p20_perplexity", "events", sql="SELECT event_id, round(exp(least(value / 5.0, 10.0)), 4) AS ppl FROM events")
def perplexity(e: DataFrame) -> DataFrame:
    return e.select("event_id", F.round(S.perplexity(F.col("value") / 5.0), 4).alias("ppl"))


@query(
    "p21_schedule", "gen_samples",
    sql="""WITH s AS (SELECT DISTINCT global_step AS step FROM gen_samples)
      SELECT step, round(CASE WHEN step < 300 THEN greatest((step + 1) / 300.0, 1e-8)
        ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((step - 300) / 2700.0, 0.0), 1.0))) END, 6) AS factor FROM s""",
)
def schedule(g: DataFrame, total: int = 3000) -> DataFrame:
    steps = g.select(F.col("global_step").alias("step")).distinct()
    return steps.select("step", F.round(S.warmup_cosine(F.col("step"), total, 0.1, 0.1), 6).alias("factor"))


@query(
    "p22_phase", "gen_samples",
    sql="SELECT DISTINCT epoch, CASE WHEN epoch <= 2 THEN 'openasl' ELSE 'how2sign' END AS phase, CASE WHEN epoch <= 2 THEN epoch ELSE epoch - 2 END AS epoch_in_phase FROM gen_samples",
)
def phases(g: DataFrame) -> DataFrame:
    return g.select("epoch").distinct().select("epoch", S.phase(F.col("epoch"), 2).alias("p")).select("epoch", "p.*")


@query(
    "p23_resample", "bbox",
    sql="""SELECT vid, num_sampled_frames AS n, CASE WHEN num_sampled_frames >= 1 THEN list_transform(range(0, 8), lambda i: floor(i * (num_sampled_frames - 1) / 7)::INT) ELSE [] END AS indices
      FROM bbox WHERE num_sampled_frames IS NOT NULL""",
)
def resample(b: DataFrame, new: int = 8) -> DataFrame:
    n = F.col("num_sampled_frames")
    return b.where(n.isNotNull()).select("vid", n.alias("n"), S.resample_indices(n, F.lit(new)).alias("indices"))


@query(
    "p24_shifted", "embeddings",
    sql="""SELECT vec_id, [embedding[1]::DOUBLE, embedding[1]::DOUBLE] || embedding[1:len(embedding) - 2]::DOUBLE[] AS edge,
      embedding[3:]::DOUBLE[] || [0.0, 0.0]::DOUBLE[] AS zero FROM embeddings""",
)
def shifted(e: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return e.select("vec_id", S.shifted(v, 2).alias("edge"), S.shifted(v, -2, edge=False).alias("zero"))


@query(
    "p25_scaled_about_mean", "embeddings",
    sql="""WITH c AS (SELECT vec_id, list_avg(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) AS m, embedding::DOUBLE[] AS e FROM embeddings)
      SELECT vec_id, list_transform(e, lambda x: CASE WHEN x = 0 THEN 0 ELSE round(m + 1.5 * (x - m), 4) + 0.0 END) AS scaled FROM c""",
)
def scaled_about_mean(e: DataFrame, by: float = 1.5) -> DataFrame:
    """Scaled about the mean of the values that are not masked (zero)."""
    v = F.col("embedding").cast("array<double>")
    kept = F.filter(v, lambda x: x != 0)
    mean = F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept).cast("double"))
    c = e.select("vec_id", v.alias("v"), mean.alias("m"))
    return c.select("vec_id", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(F.round(F.col("m") + by * (x - F.col("m")), 4) + 0.0)).alias("scaled"))


@query(
    "p26_truncated", "manifest",
    sql=r"SELECT pos, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '')[1:8] AS words FROM manifest WHERE text IS NOT NULL",
)
def truncated(m: DataFrame, most: int = 8) -> DataFrame:
    """The first words only; the tokenizer is a slot."""
    words = F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")
    return m.where(F.col("text").isNotNull()).select("pos", F.slice(words, 1, most).alias("words"))


@query(
    "p27_last_index", "manifest",
    sql=r"""WITH w AS (SELECT pos, list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda w: w <> '') AS w FROM manifest WHERE text IS NOT NULL),
      i AS (SELECT pos, w, coalesce(list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] = 'the' THEN i - 1 ELSE -1 END)), -1) AS place FROM w)
      SELECT pos, place::INT AS place, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i - 1 < place THEN '_' ELSE w[i] END) AS masked FROM i""",
)
def last_index(m: DataFrame, word: str = "the") -> DataFrame:
    """Where a word stands last, and everything before it masked."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\r\n]+"), lambda w: w != "")
    w = m.where(F.col("text").isNotNull()).select("pos", words.alias("w")).withColumn("place", S.last_index(F.col("w"), word))
    return w.select("pos", "place", S.masked_before(F.col("w"), F.col("place"), "_").alias("masked"))


@query("p28_zero_to_missing", "bbox", sql="SELECT vid, CASE WHEN detection_rate > 0 THEN round(detection_rate * 100, 4) END AS percent FROM bbox")
def zero_to_missing(b: DataFrame) -> DataFrame:
    return b.select("vid", F.round(S.missing_if_not_positive(F.col("detection_rate"), 100.0), 4).alias("percent"))
