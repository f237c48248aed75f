"""Joins over the clip tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from tarnloom.functions.ids import canonical_source, canonical_split, canonical_vid
from tarnloom.functions.kernels import indel_ratio_udf
from tarnloom.functions.text import normalised
from tarnloom.operators import fuzzy
from tarnloom.plans.registry import SOURCE_SQL, SPLIT_SQL, norm_sql, query, vid_sql
from tarnloom.plans.texts import lcs_sql

_BEST_SQL = f"""best AS (SELECT * FROM (SELECT *, {vid_sql()} AS v, row_number() OVER (PARTITION BY {vid_sql()}
  ORDER BY coalesce(failed, true), detection_rate DESC NULLS LAST, x1, y1, x2, y2, num_sampled_frames, source) AS rn FROM bbox) WHERE rn = 1)"""


def best_boxes(b: DataFrame) -> DataFrame:
    """One record per clip: not failed first, then the highest detection rate; ties
    by the box itself, so that the choice does not depend on row order."""
    order = [F.coalesce("failed", F.lit(True)), F.col("detection_rate").desc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in ("x1", "y1", "x2", "y2", "num_sampled_frames", "source")]
    v = b.withColumn("v", canonical_vid(F.col("vid")))
    return v.withColumn("rn", F.row_number().over(W.partitionBy("v").orderBy(*order))).where("rn = 1").drop("rn")


@query(
    "j01_clips_with_box", "manifest", "bbox",
    sql=f"WITH {_BEST_SQL} SELECT m.pos, b.x1, b.x2 FROM manifest m JOIN best b ON b.v = {vid_sql('m.vid')} WHERE NOT coalesce(b.failed, true)",
)
def clips_with_box(m: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join with the usable box of each clip."""
    ok = best_boxes(b).where(~F.coalesce("failed", F.lit(True))).select("v", "x1", "x2")
    return m.select("pos", canonical_vid(F.col("vid")).alias("v")).join(ok, "v").select("pos", "x1", "x2")


@query(
    "j02_clips_box_and_job", "manifest", "bbox", "clip_jobs",
    sql=f"""WITH {_BEST_SQL}, j AS (SELECT {vid_sql()} AS v, min(source_file) AS source_file FROM clip_jobs GROUP BY 1)
      SELECT m.pos, b.detection_rate, j.source_file FROM manifest m JOIN best b ON b.v = {vid_sql('m.vid')} LEFT JOIN j ON j.v = b.v""",
)
def clips_box_and_job(m: DataFrame, b: DataFrame, jobs: DataFrame) -> DataFrame:
    """Inner join on boxes, then left join on jobs."""
    j = jobs.groupBy(canonical_vid(F.col("vid")).alias("v")).agg(F.min("source_file").alias("source_file"))
    base = m.select("pos", canonical_vid(F.col("vid")).alias("v")).join(best_boxes(b).select("v", "detection_rate"), "v")
    return base.join(j, "v", "left").select("pos", "detection_rate", "source_file")


@query(
    "j03_lookup_misses", "manifest", "bbox",
    sql=f"""WITH {_BEST_SQL} SELECT {SOURCE_SQL.replace('source', 'm.source')} AS source, count(*) AS clips, count(*) FILTER (WHERE b.v IS NULL) AS no_box
      FROM manifest m LEFT JOIN best b ON b.v = {vid_sql('m.vid')} GROUP BY 1""",
)
def lookup_misses(m: DataFrame, b: DataFrame) -> DataFrame:
    base = m.select(canonical_vid(F.col("vid")).alias("v"), canonical_source(F.col("source")).alias("source"))
    hit = base.join(best_boxes(b).select("v", F.lit(True).alias("hit")), "v", "left")
    return hit.groupBy("source").agg(F.count("*").alias("clips"), F.count_if(F.col("hit").isNull()).alias("no_box"))


@query(
    "j04_results_to_jobs", "manifest", "clip_jobs",
    sql=f"""WITH r AS (SELECT {vid_sql()} AS v, max(duration_sec) AS probed FROM manifest GROUP BY 1),
      j AS (SELECT {vid_sql()} AS v, source_file, CASE WHEN duration_sec::VARCHAR = 'nan' THEN NULL ELSE duration_sec END AS planned FROM clip_jobs)
      SELECT j.v AS vid, j.source_file, coalesce(r.probed, j.planned) AS duration_sec FROM j JOIN r ON r.v = j.v""",
)
def results_to_jobs(m: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results joined back to their jobs; the probed duration wins."""
    r = m.groupBy(canonical_vid(F.col("vid")).alias("vid")).agg(F.max("duration_sec").alias("probed"))
    j = jobs.select(canonical_vid(F.col("vid")).alias("vid"), "source_file", F.when(~F.isnan("duration_sec"), F.col("duration_sec")).alias("planned"))
    return j.join(r, "vid").select("vid", "source_file", F.coalesce("probed", "planned").alias("duration_sec"))


@query(
    "j05_leakage_anti", "manifest",
    sql=f"""WITH t AS (SELECT pos, text, {SPLIT_SQL} AS split FROM manifest)
      SELECT pos, split, EXISTS (SELECT 1 FROM t tr WHERE tr.split = 'train' AND tr.text IS NOT DISTINCT FROM t.text) AS leaked
      FROM t WHERE split IN ('val', 'test')""",
)
def leakage(m: DataFrame) -> DataFrame:
    """Evaluation rows with whether their text stands in train; null equals null.
    Overlap between val and test is not looked at."""
    t = m.select("pos", "text", canonical_split(F.col("split")).alias("split"))
    train = t.where("split = 'train'").select(F.col("text").alias("seen")).distinct().withColumn("hit", F.lit(True))
    return t.where("split IN ('val', 'test')").join(train, F.col("text").eqNullSafe(F.col("seen")), "left").select("pos", "split", F.coalesce("hit", F.lit(False)).alias("leaked"))


def fuzzy_rows(m: DataFrame) -> DataFrame:
    return fuzzy.prepared(m, F.col("pos"), F.col("text"), F.col("word_count"), canonical_split(F.col("split"))).where(F.length("norm") > 0)


_LETTERS = "etaoinsrhldcumgpbw"
_COUNTS_SQL = ", ".join(f"len - length(replace(norm, '{c}', '')) AS n_{c}" for c in _LETTERS)
_CLASS_SQL = f"""rows AS (SELECT pos, {norm_sql("coalesce(text, '')")} AS norm, coalesce(word_count, 0) AS wc, {SPLIT_SQL} AS side FROM manifest),
  classes AS (SELECT side, wc, norm, min(pos) AS rid, length(norm) AS len, {_COUNTS_SQL}, array_position(['train', 'val', 'test'], side) AS rank FROM rows WHERE norm <> '' AND side IS NOT NULL GROUP BY ALL)"""


def _fuzzy_sql(sides: str, steps: tuple[int, ...], more: str = "TRUE") -> str:
    """All pairs of classes of a block, sifted by what an insertion or a deletion can
    change: a letter's count by one, and the Levenshtein distance by one (in bytes, up
    to four a character)."""
    counts = " + ".join(f"abs(a.n_{c} - b.n_{c})" for c in _LETTERS)
    met = " UNION ALL ".join(
        f"""SELECT a.side AS side_a, b.side AS side_b, a.rid AS rid_a, b.rid AS rid_b, a.norm AS x, b.norm AS y, a.len + b.len AS n FROM classes a JOIN classes b ON b.wc = a.wc + {k} AND {sides}
        WHERE {more if k == 0 else 'TRUE'} AND abs(a.len - b.len) * 10 <= a.len + b.len AND ({counts}) * 10 <= a.len + b.len""" for k in steps)  # fmt: skip
    codes = lambda c: f"list_transform(string_split({c}, ''), lambda c: unicode(c))"
    return f"""{_CLASS_SQL}, sifted AS MATERIALIZED ({met}),
      met AS MATERIALIZED (SELECT * FROM sifted WHERE levenshtein(x, y) * 10 <= n * CASE WHEN regexp_matches(x || y, '[^\\x00-\\x7F]') THEN 4 ELSE 1 END),
      apart AS MATERIALIZED (SELECT *, {codes('x')} AS a, {codes('y')} AS b FROM met WHERE x <> y),
      scored AS (SELECT side_a, side_b, rid_a, rid_b, 200.0 * ({lcs_sql('a', 'b')}) / n AS score FROM apart UNION ALL SELECT side_a, side_b, rid_a, rid_b, 100.0 FROM met WHERE x = y)"""


_RANK_SQL = "array_position(['train', 'val', 'test'], {c})"
#: ``gone(pos, split, reason)``: clusters within a side keep their first row; what is
#: left goes if it matches a side before its own
REMOVALS_SQL = f"""RECURSIVE {_fuzzy_sql('TRUE', (0, 1), 'a.rid < b.rid')}, pairs AS MATERIALIZED (SELECT * FROM scored WHERE score >= 90),
  links AS (SELECT rid_a AS a, rid_b AS b FROM pairs WHERE side_a = side_b UNION SELECT rid_b, rid_a FROM pairs WHERE side_a = side_b),
  reached AS (SELECT a AS node, a AS seen FROM links UNION SELECT reached.node, links.b FROM reached JOIN links ON links.a = reached.seen),
  keepers AS (SELECT node AS rid, min(seen) AS keep FROM reached GROUP BY node),
  within AS MATERIALIZED (SELECT pos, side FROM rows JOIN classes USING (side, wc, norm) LEFT JOIN keepers USING (rid) WHERE pos <> coalesce(keep, rid)),
  across AS (SELECT CASE WHEN {_RANK_SQL.replace('{c}', 'side_a')} < {_RANK_SQL.replace('{c}', 'side_b')} THEN rid_b ELSE rid_a END AS pos FROM pairs
    WHERE side_a <> side_b AND rid_a NOT IN (SELECT pos FROM within) AND rid_b NOT IN (SELECT pos FROM within)),
  gone AS (SELECT pos, side AS split, 'within' AS reason FROM within UNION ALL SELECT DISTINCT pos, side, 'across' FROM across JOIN rows USING (pos))"""


@query(
    "j06_fuzzy_within", "manifest",
    sql=f"WITH {_fuzzy_sql('a.side = b.side', (0, 1), 'a.rid < b.rid')} SELECT side_a, side_b, least(rid_a, rid_b) AS rid_a, greatest(rid_a, rid_b) AS rid_b, round(score, 4) AS score FROM scored WHERE score >= 90",
)
def fuzzy_within(m: DataFrame) -> DataFrame:
    """``(side_a, side_b, rid_a, rid_b, score)``: similar classes of a split, each named
    by its smallest position; ``j06_members`` has their rows."""
    return fuzzy.scored_pairs(fuzzy_rows(m), across=False).withColumn("score", F.round("score", 4))


@query("j06_members", "manifest", sql=f"WITH {_CLASS_SQL} SELECT pos, rid FROM rows JOIN classes USING (side, wc, norm)")
def fuzzy_members(m: DataFrame) -> DataFrame:
    """``(pos, rid)``: the class of every row in ``j06`` and ``j07``."""
    return fuzzy.members(fuzzy_rows(m))


@query("j07_fuzzy_across", "manifest", sql=f"WITH {_fuzzy_sql('a.rank < b.rank', (0, 1))} SELECT side_a, side_b, rid_a, rid_b, round(score, 4) AS score FROM scored WHERE score >= 90")
def fuzzy_across(m: DataFrame) -> DataFrame:
    """As ``j06_fuzzy_within``, between splits; the earlier split first."""
    return fuzzy.scored_pairs(fuzzy_rows(m), across=True).withColumn("score", F.round("score", 4))


@query("j08_first_unique_pairs", "manifest")
def first_unique_pairs(m: DataFrame, first: int = 500, least: float = 90.0) -> DataFrame:
    """All pairs among the first ``first`` distinct texts (a sampling operator):
    the pairs of a fixed number of rows, paired by position."""
    norm = normalised(F.col("text"))
    uniq = m.where(F.col("text").isNotNull()).select("pos", norm.alias("norm")).where("norm <> ''").groupBy("norm").agg(F.min("pos").alias("pos")).orderBy("pos").limit(first)
    held = uniq.agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("all"))
    pairs = held.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.slice("all", F.col("i") + 2, F.lit(first))).alias("b"))
    score = indel_ratio_udf("a.norm", "b.norm")
    return pairs.select(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.round(score, 4).alias("score")).where(F.col("score") >= least)


@query(
    "j09_failed_only", "bbox",
    sql=f"SELECT {vid_sql()} AS vid FROM bbox GROUP BY 1 HAVING bool_and(coalesce(failed, true))",
)
def failed_only(b: DataFrame) -> DataFrame:
    """Clips without a single usable record, by anti-join."""
    v = b.select(canonical_vid(F.col("vid")).alias("vid"), F.coalesce("failed", F.lit(True)).alias("failed"))
    return v.select("vid").distinct().join(v.where(~F.col("failed")), "vid", "left_anti")


@query(
    "j10_removal_by_vid", "manifest", "match_pairs",
    sql=f"""WITH r AS (SELECT {vid_sql('vid_b')} AS v FROM match_pairs WHERE score >= 99)
      SELECT pos FROM manifest WHERE vid IS NULL OR {vid_sql()} NOT IN (SELECT v FROM r WHERE v IS NOT NULL)""",
)
def removal_by_vid(m: DataFrame, pairs: DataFrame, least: float = 99.0) -> DataFrame:
    """All rows of a removed vid go, repeated deliveries too."""
    gone = pairs.where(F.col("score") >= least).select(canonical_vid(F.col("vid_b")).alias("v")).distinct()
    return m.select("pos", canonical_vid(F.col("vid")).alias("v")).join(gone, "v", "left_anti").select("pos")


@query(
    "j11_resume", "clip_jobs", "bbox",
    sql=f"""WITH done AS (SELECT DISTINCT {vid_sql()} AS v FROM bbox WHERE NOT coalesce(failed, true))
      SELECT DISTINCT {vid_sql()} AS vid FROM clip_jobs WHERE {vid_sql()} NOT IN (SELECT v FROM done)""",
)
def resume(jobs: DataFrame, b: DataFrame) -> DataFrame:
    """Jobs still to be done; failed results are tried again."""
    done = b.where(~F.coalesce("failed", F.lit(True))).select(canonical_vid(F.col("vid")).alias("vid")).distinct()
    return jobs.select(canonical_vid(F.col("vid")).alias("vid")).distinct().join(done, "vid", "left_anti")


@query(
    "j12_coverage", "manifest", "bbox",
    sql=f"""WITH a AS (SELECT DISTINCT {vid_sql()} AS v FROM manifest), b AS (SELECT DISTINCT {vid_sql()} AS v FROM bbox)
      SELECT CASE WHEN a.v IS NULL THEN 'extra' WHEN b.v IS NULL THEN 'missing' ELSE 'covered' END AS state, count(*) AS clips
      FROM a FULL JOIN b ON a.v = b.v GROUP BY 1""",
)
def coverage(m: DataFrame, b: DataFrame) -> DataFrame:
    left = m.select(canonical_vid(F.col("vid")).alias("v")).distinct().withColumn("l", F.lit(1))
    right = b.select(canonical_vid(F.col("vid")).alias("v")).distinct().withColumn("r", F.lit(1))
    state = F.when(F.col("l").isNull(), "extra").when(F.col("r").isNull(), "missing").otherwise("covered")
    return left.join(right, "v", "full").groupBy(state.alias("state")).agg(F.count("*").alias("clips"))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the ``value`` of the right row of its key that is nearest
    in ``at``; of two equally near the earlier one.  One sort per key and no range
    join: both sides are merged, and the neighbours carried along."""
    r = right.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.min(value).alias(value))
    merged = left.withColumn("_left", F.lit(True)).unionByName(r.select(key, at, F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("_r")), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(at)
    before = F.last("_r", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0))
    after = F.first("_r", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing))
    m = merged.withColumn("_b", before).withColumn("_a", after).where("_left")
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col(at) - F.col("_b.t") <= F.col("_a.t") - F.col(at), F.col("_b")).otherwise(F.col("_a"))
    return m.withColumn(value, near["v"]).drop("_left", "_r", "_a", "_b")


@query(
    "j13_nearest_event", "events",
    sql="""WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
      p AS (SELECT user_id, epoch_us(ts) AS t, min(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)
      SELECT event_id, (SELECT p.v FROM p WHERE p.user_id = c.user_id ORDER BY abs(p.t - c.t), p.t LIMIT 1) AS value FROM c""",
)
def nearest_event(e: DataFrame) -> DataFrame:
    t = e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    left = t.where("event_type = 'click'").select("event_id", "user_id", "t")
    return nearest(left, t.where("event_type = 'purchase'").select("user_id", "t", "value"), "user_id", "t", "value").select("event_id", "value")


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, value: str, default=None) -> DataFrame:
    """Each left row with the last ``value`` of its key at or before ``at``."""
    r = right.groupBy(key, at).agg(F.max(value).alias("_v"))
    merged = left.withColumn("_left", F.lit(True)).unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(at).rangeBetween(W.unboundedPreceding, 0)
    got = F.last("_v", ignorenulls=True).over(w)
    return merged.withColumn(value, F.coalesce(got, F.lit(default)) if default is not None else got).where("_left").drop("_left", "_v")


@query(
    "j14_asof_backward", "events",
    sql="""WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
      p AS (SELECT user_id, epoch_us(ts) AS t, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)
      SELECT c.event_id, coalesce(p.v, 1.0) AS value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t""",
)
def asof_event(e: DataFrame) -> DataFrame:
    t = e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    left = t.where("event_type = 'click'").select("event_id", "user_id", "t")
    return asof_backward(left, t.where("event_type = 'purchase'").select("user_id", "t", "value"), "user_id", "t", "value", 1.0).select("event_id", "value")


@query(
    "j15_nearest_to_target", "manifest", "clip_jobs",
    sql=f"""SELECT pos, duration_sec FROM manifest WHERE duration_sec IS NOT NULL AND {vid_sql()} IN (SELECT {vid_sql()} FROM clip_jobs)
      ORDER BY abs(duration_sec - 6.0), pos LIMIT 1""",
)
def nearest_to_target(m: DataFrame, jobs: DataFrame, target: float = 6.0) -> DataFrame:
    """The row nearest to a target duration whose clip is there."""
    have = jobs.select(canonical_vid(F.col("vid")).alias("v")).distinct()
    ok = m.where(F.col("duration_sec").isNotNull()).withColumn("v", canonical_vid(F.col("vid"))).join(have, "v", "left_semi")
    return ok.orderBy(F.abs(F.col("duration_sec") - target), "pos").limit(1).select("pos", "duration_sec")


@query(
    "j16_absent_steps", "gen_samples",
    sql="""SELECT DISTINCT global_step FROM gen_samples WHERE source = 'how2sign' AND global_step NOT IN (SELECT global_step FROM gen_samples WHERE source = 'openasl' AND global_step IS NOT NULL)""",
)
def absent_steps(g: DataFrame) -> DataFrame:
    """Steps of one source at which the other has none."""
    step = lambda s: g.where(F.col("source") == s).select("global_step").distinct()
    return step("how2sign").join(step("openasl"), "global_step", "left_anti")


@query(
    "j17_zip_words", "gen_samples",
    sql=r"""WITH z AS (SELECT logged_at, reference, hypothesis, string_split(reference, ' ') AS r, string_split(hypothesis, ' ') AS h FROM gen_samples WHERE reference IS NOT NULL AND hypothesis IS NOT NULL)
      SELECT epoch_us(logged_at) AS t, i AS place, r[i + 1] AS ref_word, h[i + 1] AS hyp_word FROM z, unnest(range(0, least(len(r), len(h)))) AS u(i) WHERE r[i + 1] <> h[i + 1]""",
)
def zip_words(g: DataFrame) -> DataFrame:
    """Words of reference and hypothesis paired by place, where they differ."""
    ok = g.where(F.col("reference").isNotNull() & F.col("hypothesis").isNotNull())
    zipped = ok.select(F.unix_micros(F.col("logged_at").cast("timestamp")).alias("t"), F.posexplode(F.arrays_zip(F.split("reference", " ").alias("r"), F.split("hypothesis", " ").alias("h"))).alias("place", "w"))
    return zipped.select("t", F.col("place").cast("long").alias("place"), F.col("w.r").alias("ref_word"), F.col("w.h").alias("hyp_word")).where(F.col("ref_word") != F.col("hyp_word"))
