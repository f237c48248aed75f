"""Aggregations: counts, distributions, duplicates, metrics, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tarnloom.functions import scalars as S, text as T
from tarnloom.functions.ids import canonical_source, canonical_split, canonical_vid
from tarnloom.operators import metrics as M, profile as P
from tarnloom.plans.filters import WPS_SQL
from tarnloom.plans.registry import ORACLE, SOURCE_SQL, SPLIT_SQL, WS_SQL, norm_sql, query, vid_sql
from tarnloom.plans.texts import PIPELINE_SQL, fix_pipeline, lcs_sql


def split() -> Column:
    return canonical_split(F.col("split"))


def source() -> Column:
    return canonical_source(F.col("source"))


@query("a01_counts", "manifest", sql=f"SELECT {SPLIT_SQL} AS split, {SOURCE_SQL} AS source, count(*) AS n FROM manifest GROUP BY 1, 2")
def counts(m: DataFrame) -> DataFrame:
    return m.groupBy(split().alias("split"), source().alias("source")).agg(F.count("*").alias("n"))


@query("a02_sizes_sorted", "manifest", sql="SELECT source, split, count(*) AS n FROM manifest GROUP BY ALL ORDER BY n DESC, source, split")
def sizes_sorted(m: DataFrame) -> DataFrame:
    return m.groupBy("source", "split").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "split")


@query("a03_distinct", "manifest", sql=f"SELECT {SPLIT_SQL} AS split, count(DISTINCT vid) AS vids, count(DISTINCT text) AS texts, count(DISTINCT file_path) AS files FROM manifest GROUP BY 1")
def distinct(m: DataFrame) -> DataFrame:
    """Distinct values, nulls not counted."""
    return m.groupBy(split().alias("split")).agg(F.countDistinct("vid").alias("vids"), F.countDistinct("text").alias("texts"), F.countDistinct("file_path").alias("files"))


@query(
    "a04_vocabulary", "manifest",
    sql=f"""WITH w AS (SELECT {SPLIT_SQL} AS split, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM manifest)
      SELECT CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, count(DISTINCT word) AS vocabulary, count(*) AS tokens FROM w GROUP BY GROUPING SETS ((split), ())""",
)
def vocabulary(m: DataFrame) -> DataFrame:
    """Per split and over all; the overall vocabulary is a union, not a sum."""
    w = m.select(split().alias("split"), F.explode(T.letter_words(F.col("text"))).alias("word"))
    # per word first, so that only distinct words are shuffled by split
    per = w.groupBy("split", "word").agg(F.count("*").alias("n"))
    by = per.groupBy("split").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("tokens"))
    total = per.groupBy("word").agg(F.sum("n").alias("n")).agg(F.count("*").alias("vocabulary"), F.sum("n").alias("tokens"))
    return by.unionByName(total.select(F.lit("ALL").alias("split"), "vocabulary", "tokens"))


@query("a05_hours", "manifest", sql=f"SELECT {SPLIT_SQL} AS split, round(sum(duration_sec) / 3600, 6) AS hours FROM manifest GROUP BY 1")
def hours(m: DataFrame) -> DataFrame:
    return m.groupBy(split().alias("split")).agg(F.round(F.sum("duration_sec") / 3600, 6).alias("hours"))


@query(
    "a06_duration_stats", "manifest",
    sql=f"""SELECT {SPLIT_SQL} AS split, min(duration_sec) AS lo, max(duration_sec) AS hi, round(avg(duration_sec), 6) AS mean, round(median(duration_sec), 6) AS median, round(stddev_pop(duration_sec), 6) AS std FROM manifest GROUP BY 1""",
)
def duration_stats(m: DataFrame) -> DataFrame:
    """Population deviation."""
    d = F.col("duration_sec")
    return m.groupBy(split().alias("split")).agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.round(F.avg(d), 6).alias("mean"), F.round(F.median(d), 6).alias("median"), F.round(F.stddev_pop(d), 6).alias("std"))


_SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query(
    "a07_describe", "manifest",
    sql=f"""WITH w AS (SELECT word_count::DOUBLE / nullif(duration_sec, 0) AS w FROM manifest)
      SELECT count(w) AS n, round(stddev_samp(w), 6) AS std, {", ".join(f"round(quantile_cont(w, {q}), 6) AS p{int(q * 100):02d}" for q in _SHARES)} FROM w""",
)
def describe(m: DataFrame) -> DataFrame:
    """Exact percentiles by linear interpolation, sample deviation."""
    w = m.select((F.col("word_count") / F.nullif(F.col("duration_sec"), F.lit(0.0))).alias("w"))
    q = F.percentile("w", F.array(*[F.lit(x) for x in _SHARES]))
    s = w.agg(F.count("w").alias("n"), F.round(F.stddev_samp("w"), 6).alias("std"), q.alias("q"))
    return s.select("n", "std", *[F.round(F.get("q", F.lit(i)), 6).alias(f"p{int(x * 100):02d}") for i, x in enumerate(_SHARES)])


@query(
    "a08_small_group_std", "gen_samples",
    sql="SELECT global_step, count(*) AS n, round(coalesce(stddev_samp(length(reference)), 0), 6) AS std FROM gen_samples GROUP BY 1",
)
def small_group_std(g: DataFrame) -> DataFrame:
    """Sample deviation, 0 for fewer than two values."""
    return g.groupBy("global_step").agg(F.count("*").alias("n"), F.round(F.coalesce(F.stddev_samp(F.length("reference")), F.lit(0.0)), 6).alias("std"))


@query(
    "a09_percentile_if_enough", "gen_samples",
    sql="SELECT global_step, CASE WHEN count(reference) >= 4 THEN round(quantile_cont(length(reference)::DOUBLE, 0.9), 6) END AS p90 FROM gen_samples GROUP BY 1",
)
def percentile_if_enough(g: DataFrame, least: int = 4) -> DataFrame:
    n = F.length("reference").cast("double")
    return g.groupBy("global_step").agg(F.when(F.count("reference") >= least, F.round(F.percentile(n, F.lit(0.9)), 6)).alias("p90"))


@query(
    "a10_percentile_vectors", "documents",
    sql="SELECT doc_kind, list_transform(quantile_cont(length(text)::DOUBLE, [0.01, 0.1, 0.5, 0.9, 0.99]), lambda x: round(x, 4)) AS q FROM documents GROUP BY 1",
)
def percentile_vectors(d: DataFrame) -> DataFrame:
    q = F.percentile(F.length("text").cast("double"), F.array(*[F.lit(x) for x in (0.01, 0.1, 0.5, 0.9, 0.99)]))
    return d.groupBy("doc_kind").agg(F.transform(q, lambda x: F.round(x, 4)).alias("q"))


WPS_BUCKETS = [(0.0, 0.5, "very low"), (0.5, 1.0, "low"), (1.0, 2.0, "normal low"), (2.0, 3.0, "normal"), (3.0, 4.0, "normal high"), (4.0, 5.0, "high"), (5.0, 6.0, "very high"), (6.0, 999.0, "extreme")]


@query(
    "a11_rate_buckets", "manifest",
    sql=f"""WITH w AS (SELECT {WPS_SQL} AS w FROM manifest), b(lo, hi, bucket) AS (VALUES {", ".join(f"({a}, {b}, '{c}')" for a, b, c in WPS_BUCKETS)})
      SELECT bucket, count(w) AS n FROM b LEFT JOIN w ON w >= lo AND w < hi GROUP BY bucket""",
)
def rate_buckets(m: DataFrame) -> DataFrame:
    w = m.select(S.wps(F.col("word_count"), F.col("duration_sec")).alias("w"))
    return P.bucketed(w, F.col("w"), WPS_BUCKETS)


TOKEN_EDGES = [(0, 10, "0-10"), *[(10 * i + 1, 10 * (i + 1), f"{10 * i + 1}-{10 * (i + 1)}") for i in range(1, 10)], (101, 10**9, "101+")]
CLOSED_EDGES = [(0, 11, "0-10"), *[(10 * i + 1, 10 * (i + 1) + 1, f"{10 * i + 1}-{10 * (i + 1)}") for i in range(1, 10)], (101, 10**9, "101+")]
_LEN_SQL = f"SELECT len(list_filter(string_split_regex(text, '[{WS_SQL}]+'), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL"


def _token_sql(edges) -> str:
    vals = ", ".join(f"({a}, {b}, '{c}')" for a, b, c in edges)
    return f"WITH l AS ({_LEN_SQL}), b(lo, hi, bucket) AS (VALUES {vals}) SELECT bucket, count(l.n) AS n FROM b LEFT JOIN l ON l.n >= lo AND l.n < hi GROUP BY bucket"


def token_buckets(d: DataFrame, mode: str = "reference") -> DataFrame:
    """Lengths in buckets of ten.  ``reference``: the upper bound is exclusive while
    the next lower bound is one higher, so multiples of ten are in no bucket;
    ``closed``: they belong to the lower bucket."""
    n = d.where(F.col("text").isNotNull()).select(F.size(T.space_words(F.col("text"))).cast("double").alias("n0"))
    return P.bucketed(n, F.col("n0"), TOKEN_EDGES if mode == "reference" else CLOSED_EDGES)


query("a12_token_buckets", "documents", sql=_token_sql(TOKEN_EDGES))(token_buckets)
query("a12_token_buckets_closed", "documents", sql=_token_sql(CLOSED_EDGES))(lambda d: token_buckets(d, "closed"))


@query(
    "a13_exceedance", "documents",
    sql=" UNION ALL ".join(f"SELECT {t} AS threshold, count(*) FILTER (WHERE length(text) > {t}) AS n FROM documents" for t in (100, 500, 1000, 5000)),
)
def exceedance(d: DataFrame, thresholds: tuple[int, ...] = (100, 500, 1000, 5000)) -> DataFrame:
    s = d.agg(*[F.count_if(F.length("text") > t).alias(str(t)) for t in thresholds])
    return s.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"`{t}`").alias("n")) for t in thresholds])))


def _hist_sql(t: str, c: str, bins: int) -> str:
    return f"""WITH x AS (SELECT {c}::DOUBLE AS x FROM {t} WHERE {c} IS NOT NULL AND {c}::VARCHAR <> 'nan'), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
      SELECT least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1})::INT AS bin, round(min(lo + least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) * (hi - lo) / {bins}), 6) AS lo, count(*) AS n FROM x, e GROUP BY 1"""


@query("a14_histogram", "lineitem", sql=_hist_sql("lineitem", "l_extendedprice", 40))
def histogram(t: DataFrame) -> DataFrame:
    return P.histogram(t, "l_extendedprice", 40).select("bin", F.round("lo", 6).alias("lo"), "n")


@query("a15_integer_histogram", "manifest", sql="SELECT word_count, count(*) AS n FROM manifest WHERE word_count IS NOT NULL GROUP BY 1")
def integer_histogram(m: DataFrame) -> DataFrame:
    return m.where(F.col("word_count").isNotNull()).groupBy("word_count").agg(F.count("*").alias("n"))


@query(
    "a16_shared_histogram", "bbox",
    sql="""WITH e AS (SELECT (greatest(max(frame_width), max(frame_height)) + 50)::DOUBLE / 59 AS w FROM bbox),
      x AS (SELECT 'width' AS series, frame_width AS v FROM bbox UNION ALL SELECT 'height', frame_height FROM bbox)
      SELECT series, least(floor(v / w), 58)::INT AS bin, count(*) AS n FROM x, e WHERE v IS NOT NULL GROUP BY 1, 2""",
)
def shared_histogram(b: DataFrame, bins: int = 59) -> DataFrame:
    """Two series over the same edges, up to the greatest value plus 50."""
    w = b.agg((F.greatest(F.max("frame_width"), F.max("frame_height")) + 50).cast("double") / bins).scalar()
    long = b.select(F.inline(F.array(F.struct(F.lit("width").alias("series"), F.col("frame_width").alias("v")), F.struct(F.lit("height").alias("series"), F.col("frame_height").alias("v"))))).where("v IS NOT NULL")
    place = F.least(F.floor(F.col("v") / w), F.lit(bins - 1)).cast("int")
    return long.select("series", place.alias("bin")).groupBy("series", "bin").agg(F.count("*").alias("n"))


@query(
    "a17_score_bands", "match_pairs",
    sql="SELECT count(*) FILTER (WHERE score = 100) AS full_score, count(*) FILTER (WHERE score >= 95 AND score < 100) AS high, count(*) FILTER (WHERE score >= 90 AND score < 95) AS fair FROM match_pairs",
)
def score_bands(p: DataFrame) -> DataFrame:
    s = F.col("score")
    return p.agg(F.count_if(s == 100).alias("full_score"), F.count_if((s >= 95) & (s < 100)).alias("high"), F.count_if((s >= 90) & (s < 95)).alias("fair"))


def _dup_sql(key: str, where: str = "TRUE") -> str:
    return f"SELECT count(*) AS keys, coalesce(sum(n), 0)::BIGINT AS rows_in_groups, coalesce(sum(n - 1), 0)::BIGINT AS extra_copies FROM (SELECT k, count(*) AS n FROM (SELECT {key} AS k FROM manifest WHERE {where}) GROUP BY k HAVING count(*) > 1)"


query("a18_duplicates_text", "manifest", sql=_dup_sql("text"))(lambda m: P.duplicate_summary(m, ["text"]))
query("a18_duplicates_vid", "manifest", sql=_dup_sql(vid_sql()))(lambda m: P.duplicate_summary(m.select(canonical_vid(F.col("vid")).alias("v")), ["v"]))
query("a18_duplicates_norm", "manifest", sql=_dup_sql(norm_sql()))(lambda m: P.duplicate_summary(m.select(T.normalised(F.col("text")).alias("k")), ["k"]))


@query("a19_extra_copies", "manifest", sql="SELECT count(*) - (count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END)) AS extra FROM manifest")
def extra_copies(m: DataFrame) -> DataFrame:
    """Rows beyond the first of each text; nulls are one text."""
    return m.groupBy("text").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("extra"))


@query(
    "a20_weak_fingerprints", "manifest",
    sql=f"""WITH g AS (SELECT duration_sec, word_count, {SOURCE_SQL} AS s, count(*) AS n FROM manifest WHERE duration_sec IS NOT NULL AND word_count IS NOT NULL AND source IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
      SELECT count(*) AS keys, sum(n)::BIGINT AS rows_in_groups, round(100.0 * sum(n) / (SELECT count(*) FROM manifest), 4) AS percent FROM g""",
)
def weak_fingerprints(m: DataFrame) -> DataFrame:
    """Groups of equal duration, words and source; the share is of all rows."""
    ok = m.where(F.col("duration_sec").isNotNull() & F.col("word_count").isNotNull() & F.col("source").isNotNull())
    g = ok.groupBy("duration_sec", "word_count", source().alias("s")).agg(F.count("*").alias("n")).where("n > 1")
    s = g.agg(F.count("*").alias("keys"), F.sum("n").alias("rows_in_groups"))
    return s.select("keys", "rows_in_groups", F.round(100.0 * F.col("rows_in_groups") / m.agg(F.count("*")).scalar(), 4).alias("percent"))


@query("a21_texts_in_both_sources", "manifest", sql=f"SELECT text, list_sort(list(DISTINCT {SOURCE_SQL})) AS sources FROM manifest WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY text HAVING count(DISTINCT {SOURCE_SQL}) > 1")
def texts_in_both(m: DataFrame) -> DataFrame:
    g = m.where(F.col("text").isNotNull()).groupBy("text").agg(F.array_sort(F.collect_set(source())).alias("sources"))
    return g.where(F.size("sources") > 1)


@query("a22_joined_sources", "manifest", sql=f"SELECT word_count, array_to_string(list_sort(list(DISTINCT {SOURCE_SQL}) FILTER (WHERE source IS NOT NULL)), ', ') AS sources FROM manifest GROUP BY 1")
def joined_sources(m: DataFrame) -> DataFrame:
    return m.groupBy("word_count").agg(F.array_join(F.array_sort(F.collect_set(source())), ", ").alias("sources"))


@query(
    "a23_group_members", "manifest",
    sql="""WITH r AS (SELECT text, pos, row_number() OVER (PARTITION BY text ORDER BY pos) AS k, count(*) OVER (PARTITION BY text) AS n FROM manifest WHERE text IS NOT NULL)
      SELECT text, max(n) AS n, min(pos) AS kept, list(pos ORDER BY pos) FILTER (WHERE k BETWEEN 2 AND 4) AS removed FROM r WHERE n > 1 GROUP BY text""",
)
def group_members(m: DataFrame, shown: int = 3) -> DataFrame:
    """Of each repeated text the row kept and the first removed ones, without
    gathering whole groups: rows beyond the shown ones are cut by rank first."""
    t = m.where(F.col("text").isNotNull()).select("text", "pos")
    n = t.groupBy("text").agg(F.count("*").alias("n"), F.min("pos").alias("kept")).where("n > 1")
    ranked = t.withColumn("k", F.row_number().over(W.partitionBy("text").orderBy("pos"))).where(F.col("k") <= shown + 1)
    some = ranked.where("k > 1").groupBy("text").agg(F.array_sort(F.collect_list("pos")).alias("removed"))
    return n.join(some, "text").select("text", "n", "kept", "removed")


@query(
    "a24_fail_and_detection", "bbox",
    sql=f"SELECT {SOURCE_SQL} AS source, round(avg(coalesce(failed, true)::INT), 6) AS fail_rate, round(avg(detection_rate) FILTER (WHERE NOT failed), 6) AS mean_detection FROM bbox GROUP BY 1",
)
def fail_and_detection(b: DataFrame) -> DataFrame:
    return b.groupBy(source().alias("source")).agg(F.round(F.avg(F.coalesce("failed", F.lit(True)).cast("int")), 6).alias("fail_rate"), F.round(F.avg(F.when(~F.col("failed"), F.col("detection_rate"))), 6).alias("mean_detection"))


@query("a25_top_errors", "bbox", sql="SELECT error, count(*) AS n FROM bbox WHERE error <> '' GROUP BY 1 ORDER BY n DESC, error LIMIT 5")
def top_errors(b: DataFrame, k: int = 5) -> DataFrame:
    return b.where(F.col("error") != "").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(k)


@query(
    "a26_missing_rate", "bbox",
    sql="SELECT vid, sum(CASE WHEN x1 IS NULL AND x2 IS NULL AND y1 IS NULL AND y2 IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, count(*) AS frames FROM bbox GROUP BY vid",
)
def missing_rate(b: DataFrame) -> DataFrame:
    """Records of a clip of which all coordinates are missing."""
    gone = F.forall(F.array("x1", "x2", "y1", "y2"), lambda x: x.isNull())
    return b.groupBy("vid").agg(F.count_if(gone).alias("missing"), F.count("*").alias("frames"))


@query(
    "a27_source_tracker", "clip_jobs", "bbox",
    sql=f"""WITH d AS (SELECT {vid_sql()} AS v, bool_or(NOT coalesce(failed, true)) AS ok FROM bbox GROUP BY 1), j AS (SELECT DISTINCT {vid_sql()} AS v, source_file FROM clip_jobs)
      SELECT source_file, count(*) AS total, count(d.v) AS done, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed, count(*) = count(d.v) AS complete FROM j LEFT JOIN d ON d.v = j.v GROUP BY 1""",
)
def source_tracker(jobs: DataFrame, b: DataFrame) -> DataFrame:
    """Progress per source video; complete when every job has a result."""
    d = b.groupBy(canonical_vid(F.col("vid")).alias("v")).agg(F.bool_or(~F.coalesce("failed", F.lit(True))).alias("good"))
    j = jobs.select(canonical_vid(F.col("vid")).alias("v"), "source_file").distinct().join(d, "v", "left")
    done = F.count("good")
    return j.groupBy("source_file").agg(F.count("*").alias("total"), done.alias("done"), F.count_if(F.col("good")).alias("ok"), F.count_if(~F.col("good")).alias("failed"), (done == F.count("*")).alias("complete"))


@query(
    "a28_waterfall", "manifest",
    sql=f"""WITH b AS (SELECT pos, text, {SPLIT_SQL} AS split, {WPS_SQL} AS w FROM manifest),
      f AS (SELECT *, coalesce(w > 5.0 AND NOT isnan(w), false) AS fast FROM b),
      k AS (SELECT *, CASE WHEN NOT fast THEN row_number() OVER (PARTITION BY fast, split, text ORDER BY pos) END AS rn FROM f)
      SELECT CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, count(*) AS before, count(*) FILTER (WHERE fast) AS too_fast, count(*) FILTER (WHERE rn > 1) AS repeated,
        count(*) FILTER (WHERE rn = 1) AS after, round(100.0 * count(*) FILTER (WHERE rn = 1) / count(*), 4) AS kept_percent FROM k GROUP BY GROUPING SETS ((split), ())""",
)
def waterfall(m: DataFrame, most: float = 5.0) -> DataFrame:
    """Rows before, removed by each step, and after, per split and in total."""
    w = S.wps(F.col("word_count"), F.col("duration_sec"))
    f = m.select("pos", "text", split().alias("split"), F.coalesce((w > most) & ~F.isnan(w), F.lit(False)).alias("fast"))
    # of equal texts of a split the first stays: counted by group, not ranked
    g = f.groupBy("split", "text", "fast").agg(F.count("*").alias("n"))
    first = F.when(~F.col("fast"), 1).otherwise(0)
    rows = g.groupBy("split").agg(F.sum("n").alias("before"), F.coalesce(F.sum(F.when(F.col("fast"), F.col("n"))), F.lit(0)).alias("too_fast"), F.sum(first).alias("after"))
    total = rows.agg(*[F.sum(c).alias(c) for c in ("before", "too_fast", "after")]).withColumn("split", F.lit("ALL"))
    all_rows = rows.unionByName(total)
    return all_rows.select("split", "before", "too_fast", (F.col("before") - F.col("too_fast") - F.col("after")).alias("repeated"), "after", F.round(100.0 * F.col("after") / F.col("before"), 4).alias("kept_percent"))


@query(
    "a29_balance", "manifest",
    sql=f"""WITH c AS (SELECT {SPLIT_SQL} AS split, {SOURCE_SQL} AS source FROM manifest WHERE source IS NOT NULL), s AS (SELECT DISTINCT split FROM c WHERE split IS NOT NULL), q AS (SELECT DISTINCT source FROM c),
      r AS (SELECT s.split, q.source, (SELECT count(*) FROM c WHERE c.split = s.split AND c.source = q.source)::DOUBLE / (SELECT count(*) FROM c WHERE c.split = s.split) AS ratio FROM s, q)
      SELECT r.split, round(avg(abs(r.ratio - t.ratio)), 6) AS delta FROM r JOIN r t ON t.split = 'train' AND t.source = r.source WHERE r.split <> 'train' GROUP BY 1""",
)
def balance(m: DataFrame) -> DataFrame:
    """Mean absolute difference of the source shares from those of train; a source
    that a split lacks counts as 0."""
    names = ["train", "val", "test"]
    c = m.where(F.col("source").isNotNull()).select(split().alias("split"), source().alias("source")).groupBy("source").pivot("split", names).agg(F.count(F.lit(1))).na.fill(0)
    total = c.agg(F.struct(*[F.sum(s).alias(s) for s in names])).scalar()
    c = c.select(*names, total.alias("total"))
    share = lambda s: F.col(s) / F.nullif(F.col(f"total.{s}"), F.lit(0))
    wide = c.agg(*[F.round(F.avg(F.abs(share(s) - share("train"))), 6).alias(s) for s in names[1:]])
    return wide.unpivot([], names[1:], "split", "delta").where("delta IS NOT NULL")


@query(
    "a30_fix_counts", "manifest",
    sql=f"WITH {PIPELINE_SQL}, e AS (SELECT pos, unnest(fired) AS fix FROM fixes) SELECT fix, count(*) AS n, list_sort(list(pos))[1:5] AS first_rows FROM e GROUP BY fix",
)
def fix_counts(m: DataFrame) -> DataFrame:
    """How often each fix fired, with the first five rows."""
    fired = fix_pipeline(m).select("pos", F.explode("fired").alias("fix"))
    n = fired.groupBy("fix").agg(F.count("*").alias("n"))
    first = fired.withColumn("k", F.row_number().over(W.partitionBy("fix").orderBy("pos"))).where("k <= 5").groupBy("fix").agg(F.array_sort(F.collect_list("pos")).alias("first_rows"))
    return n.join(first, "fix")


def _pairs(g: DataFrame) -> DataFrame:
    return g.where(F.col("reference").isNotNull() & F.col("hypothesis").isNotNull()).select("global_step", source().alias("source"), "reference", "hypothesis")


_GIVEN_SQL = f"pairs AS (SELECT {SOURCE_SQL} AS source, reference, hypothesis FROM gen_samples WHERE reference IS NOT NULL AND hypothesis IS NOT NULL)"
_LISTS_SQL = f"""{_GIVEN_SQL}, l AS (SELECT source, list_filter(string_split_regex(__reference__, '[{WS_SQL}]+'), lambda w: w <> '') AS r, list_filter(string_split_regex(__hypothesis__, '[{WS_SQL}]+'), lambda w: w <> '') AS h FROM pairs),
  u AS (SELECT *, list_distinct(r || h) AS w FROM l), c AS (SELECT *, list_transform(r, lambda x: list_position(w, x)) AS a, list_transform(h, lambda x: list_position(w, x)) AS b FROM u)"""
_PLAIN_SQL = _LISTS_SQL.replace("__reference__", "reference").replace("__hypothesis__", "hypothesis")
_LOWER_SQL = _LISTS_SQL.replace("__reference__", "lower(reference)").replace("__hypothesis__", "lower(hypothesis)")
query(
    "a31_wer", "gen_samples",
    sql=f"""WITH {_PLAIN_SQL}, e AS (SELECT source, levenshtein(array_to_string(list_transform(a, lambda x: chr(x::INT)), ''), array_to_string(list_transform(b, lambda x: chr(x::INT)), '')) AS e, greatest(len(a), 1) AS n FROM c)
      SELECT source, sum(e)::BIGINT AS edits, sum(n)::BIGINT AS words, round(100.0 * sum(e) / sum(n), 4) AS wer FROM e GROUP BY source""",
)(lambda g: M.wer(_pairs(g), ["source"]))
query(
    "a32_rouge_l", "gen_samples",
    sql=f"""WITH {_LOWER_SQL}, s AS (SELECT source, {lcs_sql('a', 'b')} AS l, len(a) + len(b) AS n FROM c)
      SELECT source, count(*) AS pairs, round(100.0 * avg(CASE WHEN l > 0 THEN 2.0 * l / n ELSE 0.0 END), 4) AS rouge_l FROM s GROUP BY source""",
)(lambda g: M.rouge_l(_pairs(g), ["source"]))


def _bleu_sql(order: int, smoothed: bool) -> str:
    """Clipped n-gram matches of 13a tokens per pair, summed per source."""
    tokens = "__c__"
    for old, new in (("<skipped>", ""), ("-' || chr(10) || '", ""), ("' || chr(10) || '", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        tokens = f"replace({tokens}, '{old}', '{new}')"
    tokens = f"' ' || {tokens} || ' '"
    for pattern, new in ((r"([\{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        tokens = f"regexp_replace({tokens}, '{pattern}', '{new}', 'g')"
    tokens = f"list_filter(string_split_regex({tokens}, '[{WS_SQL}]+'), lambda w: w <> '')"
    grams = lambda c: f"list_transform(range(1, len({c}) - n + 2), lambda i: array_to_string({c}[i:i + n - 1], ' '))"
    zero = f"max(CASE WHEN z > 0 OR total = 0 THEN 1 ELSE 0 END) = 1 OR count(*) < {order} OR" if not smoothed else ""
    return f"""WITH {_GIVEN_SQL}, t AS (SELECT row_number() OVER () AS id, source, {tokens.replace('__c__', 'reference')} AS r, {tokens.replace('__c__', 'hypothesis')} AS h FROM pairs),
      o AS (SELECT id, source, r, h, unnest(range(1, {order + 1})) AS n FROM t),
      x AS (SELECT id, n, g, count(*) AS k FROM (SELECT id, n, unnest({grams('r')}) AS g FROM o) GROUP BY ALL), y AS (SELECT id, n, g, count(*) AS k FROM (SELECT id, n, unnest({grams('h')}) AS g FROM o) GROUP BY ALL),
      m AS (SELECT id, n, sum(least(x.k, y.k)) AS hit FROM x JOIN y USING (id, n, g) GROUP BY ALL),
      s AS (SELECT source, n, coalesce(sum(hit), 0)::DOUBLE AS hit, sum(greatest(len(h) - n + 1, 0))::DOUBLE AS total FROM o LEFT JOIN m USING (id, n) GROUP BY ALL),
      z AS (SELECT *, sum(CASE WHEN hit = 0 AND total > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n) AS zeros, CASE WHEN hit = 0 AND total > 0 THEN 1 ELSE 0 END AS z FROM s),
      p AS (SELECT source, exp(sum(CASE WHEN total > 0 THEN ln(CASE WHEN hit > 0 THEN hit / total ELSE 1 / (2.0 ** zeros * total) END) ELSE 0 END) / greatest(sum((total > 0)::INT), 1)) AS mean,
          {zero} max(CASE WHEN n = 1 THEN hit END) = 0 AS none FROM z GROUP BY source),
      b AS (SELECT source, sum(len(r))::DOUBLE AS nr, sum(len(h))::DOUBLE AS nh FROM t GROUP BY source)
      SELECT p.source, round(CASE WHEN none OR nh = 0 THEN 0.0 ELSE 100.0 * mean * CASE WHEN nh >= nr THEN 1.0 ELSE exp(1.0 - nr / nh) END END, 4) AS bleu FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source"""


_CHRF_SQL = f"""WITH {_GIVEN_SQL}, t AS (SELECT row_number() OVER () AS id, source, regexp_replace(reference, '[{WS_SQL}]+', '', 'g') AS r, regexp_replace(hypothesis, '[{WS_SQL}]+', '', 'g') AS h FROM pairs),
  o AS (SELECT id, source, r, h, unnest(range(1, 7)) AS n FROM t),
  x AS (SELECT id, n, g, count(*) AS k FROM (SELECT id, n, unnest(list_transform(range(1, length(r) - n + 2), lambda i: substring(r, i, n))) AS g FROM o) GROUP BY ALL),
  y AS (SELECT id, n, g, count(*) AS k FROM (SELECT id, n, unnest(list_transform(range(1, length(h) - n + 2), lambda i: substring(h, i, n))) AS g FROM o) GROUP BY ALL),
  m AS (SELECT id, n, sum(least(x.k, y.k)) AS hit FROM x JOIN y USING (id, n, g) GROUP BY ALL),
  s AS (SELECT source, n, coalesce(sum(hit), 0)::DOUBLE AS hit, sum(greatest(length(r) - n + 1, 0))::DOUBLE AS nr, sum(greatest(length(h) - n + 1, 0))::DOUBLE AS nh FROM o LEFT JOIN m USING (id, n) GROUP BY ALL),
  a AS (SELECT source, coalesce(avg(hit / nh) FILTER (WHERE nh > 0 AND nr > 0), 0) AS p, coalesce(avg(hit / nr) FILTER (WHERE nh > 0 AND nr > 0), 0) AS r FROM s GROUP BY source)
  SELECT source, round(CASE WHEN p + r > 0 THEN 100.0 * 5 * p * r / (4 * p + r) ELSE 0.0 END, 4) AS chrf FROM a"""
_GRAM_SQL = f"""WITH w AS (SELECT list_filter(string_split_regex(lower(hypothesis), '[{WS_SQL}]+'), lambda w: w <> '') AS w FROM gen_samples WHERE reference IS NOT NULL AND hypothesis IS NOT NULL),
  g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM w)
  SELECT count(DISTINCT x) AS unique_grams, count(*) AS grams, round(count(DISTINCT x)::DOUBLE / count(*), 6) AS distinct_n FROM g"""
query("a33_distinct_2", "gen_samples", sql=_GRAM_SQL)(lambda g: M.distinct_n(_pairs(g), 2))
query("a34_bleu", "gen_samples", sql=_bleu_sql(4, True))(lambda g: M.bleu(_pairs(g), ["source"]))
query("a34_bleu_2", "gen_samples", sql=_bleu_sql(2, True))(lambda g: M.bleu(_pairs(g), ["source"], 2))
query("a35_bleu_unsmoothed", "gen_samples", sql=_bleu_sql(2, False))(lambda g: M.bleu(_pairs(g), ["source"], 2, smoothed=False))
query("a36_chrf", "gen_samples", sql=_CHRF_SQL)(lambda g: M.chrf(_pairs(g), ["source"]))
def _words(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '[{WS_SQL}]+'), lambda w: w <> ''))"


query(
    "a38_length_stats", "gen_samples",
    sql=f"""WITH n AS (SELECT {SOURCE_SQL} AS source, {_words('reference')} AS r, {_words('hypothesis')} AS h FROM gen_samples WHERE reference IS NOT NULL AND hypothesis IS NOT NULL)
      SELECT source, round(avg(r), 6) AS mean_ref, round(avg(h), 6) AS mean_hyp, round(avg(h) / avg(r), 6) AS ratio, list_sort(list(h))[count(*) // 2 + 1]::INT AS median_hyp FROM n GROUP BY 1""",
)(lambda g: M.length_stats(_pairs(g), ["source"]))


def _panel_sql() -> str:
    """The twins of the single metrics over the pairs of each source and all pairs."""
    both = f"{_GIVEN_SQL.replace('pairs AS', 'given AS')}, pairs AS (SELECT * FROM given WHERE source IS NOT NULL UNION ALL SELECT 'overall', reference, hypothesis FROM given)"
    part = lambda name: ORACLE[name].replace(_GIVEN_SQL, both)
    lengths = ORACLE["a38_length_stats"].replace(f"{SOURCE_SQL} AS source", "source").replace("FROM gen_samples WHERE reference IS NOT NULL AND hypothesis IS NOT NULL", "FROM pairs").replace("WITH n AS", f"WITH {both}, n AS")
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("wer", "pairs", "rouge_l", "bleu", "chrf", "mean_ref", "mean_hyp", "ratio", "median_hyp"))
    return f"""SELECT source, {zero} FROM (SELECT unnest(['overall', 'openasl', 'how2sign']) AS source) LEFT JOIN ({part('a31_wer')}) USING (source) LEFT JOIN ({part('a32_rouge_l')}) USING (source)
      LEFT JOIN ({part('a34_bleu')}) USING (source) LEFT JOIN ({part('a36_chrf')}) USING (source) LEFT JOIN ({lengths}) USING (source)"""


@query("a39_metric_panel", "gen_samples", sql=_panel_sql())
def metric_panel(g: DataFrame, sources: tuple[str, ...] = ("openasl", "how2sign")) -> DataFrame:
    """All metrics overall and per source; a source without pairs has zeros."""
    p = _pairs(g)
    both = p.unionByName(p.withColumn("source", F.lit("overall"))).where(F.col("source").isNotNull())
    spine = g.sparkSession.createDataFrame([(s,) for s in ("overall", *sources)], "source string")
    out = spine
    for part in (M.wer(both, ["source"]).select("source", "wer"), M.rouge_l(both, ["source"]), M.bleu(both, ["source"]), M.chrf(both, ["source"]), M.length_stats(both, ["source"])):
        out = out.join(part, "source", "left")
    return out.na.fill(0)


@query(
    "a40_best_steps", "gen_samples",
    sql="""WITH s AS (SELECT global_step, count(*)::DOUBLE AS samples, avg(length(hypothesis)) AS length FROM gen_samples GROUP BY 1), l AS (UNPIVOT s ON samples, length INTO NAME metric VALUE value)
      SELECT metric, round(max(value), 6) AS best, arg_max(global_step, struct_pack(v := value, s := -global_step)) AS best_step, count(*) AS n FROM l GROUP BY 1""",
)
def best_steps(g: DataFrame) -> DataFrame:
    """The greatest value of each metric with its step; ties: the first step."""
    s = g.groupBy("global_step").agg(F.count("*").cast("double").alias("samples"), F.avg(F.length("hypothesis")).alias("length"))
    long = s.unpivot(["global_step"], ["samples", "length"], "metric", "value").where("value IS NOT NULL")
    return long.groupBy("metric").agg(F.round(F.max("value"), 6).alias("best"), F.max_by("global_step", F.struct("value", -F.col("global_step"))).alias("best_step"), F.count("*").alias("n"))


@query(
    "a41_plateau", "events",
    sql="""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS rn, count(*) OVER (PARTITION BY event_type) AS n, max(v) OVER (PARTITION BY event_type) AS peak FROM d)
      SELECT event_type, count(*) AS tail, max(abs(v - peak) / abs(peak)) <= 0.02 AS plateau, round(max(abs(v - peak) / abs(peak)), 6) AS deviation FROM r WHERE rn > greatest(1, floor(n * 0.8)) GROUP BY 1""",
)
def plateau(e: DataFrame, tail: float = 0.8, tolerance: float = 0.02) -> DataFrame:
    """Whether the last fifth of a series of days stays near its peak."""
    d = e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("v"))
    w = W.partitionBy("event_type")
    r = d.select("event_type", "v", F.row_number().over(w.orderBy("day")).alias("rn"), F.count("*").over(w).alias("n"), F.max("v").over(w).alias("peak"))
    off = F.max(F.abs(F.col("v") - F.col("peak")) / F.abs("peak"))
    return r.where(F.col("rn") > F.greatest(F.lit(1), F.floor(F.col("n") * tail))).groupBy("event_type").agg(F.count("*").alias("tail"), (off <= tolerance).alias("plateau"), F.round(off, 6).alias("deviation"))


@query(
    "a42_elapsed", "gen_samples",
    sql="""WITH t AS (SELECT global_step, epoch_us(logged_at) - min(epoch_us(logged_at)) OVER () AS u FROM gen_samples)
      SELECT max(u) FILTER (WHERE global_step <= 1000) AS first_phase, max(u) FILTER (WHERE global_step > 1000) AS second_phase FROM t""",
)
def elapsed(g: DataFrame, boundary: int = 1000) -> DataFrame:
    t = g.select("global_step", F.unix_micros(F.col("logged_at").cast("timestamp")).alias("u"))
    s = t.agg(F.min("u").alias("m"), F.max(F.when(F.col("global_step") <= boundary, F.col("u"))).alias("a"), F.max(F.when(F.col("global_step") > boundary, F.col("u"))).alias("b"))
    return s.select((F.col("a") - F.col("m")).alias("first_phase"), (F.col("b") - F.col("m")).alias("second_phase"))


@query(
    "a43_gap", "events",
    sql="""WITH l AS (SELECT user_id, arg_max(value, struct_pack(t := ts, i := event_id)) AS last_click, max(ts) AS t FROM events WHERE event_type = 'click' GROUP BY 1),
      p AS (SELECT user_id, ts, min(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL)
      SELECT l.user_id, round((SELECT p.v FROM p WHERE p.user_id = l.user_id ORDER BY abs(epoch_us(p.ts) - epoch_us(l.t)), p.ts LIMIT 1) - last_click, 6) AS gap FROM l""",
)
def gap(e: DataFrame) -> DataFrame:
    """The last value of one series less the nearest value of another, by key."""
    from tarnloom.plans.joins import nearest

    t = e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    last = t.where("event_type = 'click'").groupBy("user_id").agg(F.max_by("value", F.struct("t", "event_id")).alias("last_click"), F.max("t").alias("t"))
    near = nearest(last, t.where("event_type = 'view'").select("user_id", "t", "value"), "user_id", "t", "value")
    return near.select("user_id", F.round(F.col("value") - F.col("last_click"), 6).alias("gap"))


@query(
    "a44_mean_of_means", "lineitem",
    sql="WITH b AS (SELECT l_suppkey, sum(l_tax) FILTER (WHERE l_tax > 0) / nullif(count(*) FILTER (WHERE l_tax > 0), 0) AS m FROM lineitem GROUP BY 1) SELECT round(avg(m), 8) AS mean_of_means FROM b",
)
def mean_of_means(t: DataFrame) -> DataFrame:
    """Masked mean per batch, then the mean of those."""
    b = t.groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_tax") > 0, F.col("l_tax"))).alias("m"))
    return b.agg(F.round(F.avg("m"), 8).alias("mean_of_means"))


@query(
    "a45_pair_sources", "match_pairs", "manifest",
    sql=f"""WITH s AS (SELECT {vid_sql()} AS v, min({SOURCE_SQL}) AS s FROM manifest GROUP BY 1)
      SELECT least(a.s, b.s) AS source_a, greatest(a.s, b.s) AS source_b, count(*) AS pairs FROM match_pairs p JOIN s a ON a.v = {vid_sql('p.vid_a')} JOIN s b ON b.v = {vid_sql('p.vid_b')} WHERE a.s IS NOT NULL AND b.s IS NOT NULL GROUP BY 1, 2""",
)
def pair_sources(p: DataFrame, m: DataFrame) -> DataFrame:
    s = m.groupBy(canonical_vid(F.col("vid")).alias("v")).agg(F.min(source()).alias("s")).where("s IS NOT NULL")
    side = lambda k: s.select(F.col("v").alias(f"v{k}"), F.col("s").alias(f"s{k}"))
    both = p.select(canonical_vid(F.col("vid_a")).alias("va"), canonical_vid(F.col("vid_b")).alias("vb")).join(side("a"), "va").join(side("b"), "vb")
    return both.groupBy(F.least("sa", "sb").alias("source_a"), F.greatest("sa", "sb").alias("source_b")).agg(F.count("*").alias("pairs"))


@query(
    "a46_affected", "match_pairs",
    sql=f"SELECT count(DISTINCT v) AS clips FROM (SELECT {vid_sql('vid_a')} AS v FROM match_pairs UNION ALL SELECT {vid_sql('vid_b')} FROM match_pairs)",
)
def affected(p: DataFrame) -> DataFrame:
    return p.select(F.explode(F.array(canonical_vid(F.col("vid_a")), canonical_vid(F.col("vid_b")))).alias("v")).agg(F.countDistinct("v").alias("clips"))


@query(
    "a47_majority_source", "bbox",
    sql=f"""SELECT frame_width, frame_height, CASE WHEN count(*) FILTER (WHERE {SOURCE_SQL} = 'openasl') >= count(*) FILTER (WHERE {SOURCE_SQL} = 'how2sign') THEN 'openasl' ELSE 'how2sign' END AS majority
      FROM bbox WHERE frame_width IS NOT NULL GROUP BY ALL""",
)
def majority_source(b: DataFrame) -> DataFrame:
    """The source of most records of a resolution; at a tie the first."""
    n = lambda s: F.count_if(source() == s)
    return b.where("frame_width IS NOT NULL").groupBy("frame_width", "frame_height").agg(F.when(n("openasl") >= n("how2sign"), "openasl").otherwise("how2sign").alias("majority"))


@query(
    "a48_best_config", "part",
    sql="SELECT p_brand, arg_max(p_partkey, struct_pack(q := p_type NOT LIKE 'ECONOMY%', s := p_size, k := -p_partkey)) AS best FROM part WHERE p_retailprice < 1500 GROUP BY 1",
)
def best_config(p: DataFrame) -> DataFrame:
    """The feasible row that comes first by several preferences in turn."""
    order = F.struct(~F.col("p_type").startswith("ECONOMY"), F.col("p_size"), -F.col("p_partkey"))
    return p.where("p_retailprice < 1500").groupBy("p_brand").agg(F.max_by("p_partkey", order).alias("best"))


@query(
    "a49_delta_verdict", "events",
    sql="""WITH a AS (SELECT event_type, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, avg(value) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1)
      SELECT a.event_type, round(a.v - b.v, 6) AS delta, CASE WHEN a.v - b.v > 10 THEN 'strong' WHEN a.v - b.v > 5 THEN 'moderate' WHEN a.v - b.v > 0 THEN 'weak' ELSE 'none' END AS verdict FROM a JOIN b ON a.event_type = b.event_type""",
)
def delta_verdict(e: DataFrame) -> DataFrame:
    """Two runs compared metric by metric (here: even and odd users)."""
    odd = F.col("user_id") % 2 == 1
    s = e.groupBy("event_type").agg((F.avg(F.when(~odd, F.col("value"))) - F.avg(F.when(odd, F.col("value")))).alias("d")).where("d IS NOT NULL")
    verdict = F.when(F.col("d") > 10, "strong").when(F.col("d") > 5, "moderate").when(F.col("d") > 0, "weak").otherwise("none")
    return s.select("event_type", F.round("d", 6).alias("delta"), verdict.alias("verdict"))


@query("a50_rate", "events", sql="SELECT count(*) AS n, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 8) AS per_second FROM events")
def rate(e: DataFrame) -> DataFrame:
    seconds = F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))
    return e.agg(F.count("*").alias("n"), F.round(F.count("*") / (seconds / 1e6), 8).alias("per_second"))


@query("a51_share", "manifest", sql=f"SELECT {SOURCE_SQL} AS source, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM manifest GROUP BY 1")
def share(m: DataFrame) -> DataFrame:
    g = m.groupBy(source().alias("source")).agg(F.count("*").alias("n"))
    return g.select("source", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6).alias("percent"))


@query(
    "a52_masked_accuracy", "lineitem",
    sql="SELECT round(100.0 * count(*) FILTER (WHERE l_linestatus = CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END AND l_returnflag <> 'R') / greatest(count(*) FILTER (WHERE l_returnflag <> 'R'), 1), 6) AS accuracy FROM lineitem",
)
def masked_accuracy(t: DataFrame) -> DataFrame:
    """Right predictions among the labels that are not masked."""
    use = F.col("l_returnflag") != "R"
    hit = F.col("l_linestatus") == F.when(F.col("l_returnflag") == "N", "O").otherwise("F")
    return t.agg(F.round(100.0 * F.count_if(use & hit) / F.greatest(F.count_if(use), F.lit(1)), 6).alias("accuracy"))


@query("a53_interval_means", "events", sql="SELECT (event_id // 100) AS interval, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def interval_means(e: DataFrame, size: int = 100) -> DataFrame:
    """Means over windows of a fixed number of steps."""
    return e.groupBy(F.floor(F.col("event_id") / size).alias("interval")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query(
    "a54_outcomes", "clip_jobs", "bbox",
    sql=f"""WITH d AS (SELECT {vid_sql()} AS v, bool_or(NOT coalesce(failed, true)) AS good FROM bbox GROUP BY 1), j AS (SELECT {SPLIT_SQL} AS split, good FROM clip_jobs LEFT JOIN d ON d.v = {vid_sql()})
      SELECT CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, count(*) FILTER (WHERE good) AS ok, count(*) FILTER (WHERE good IS NULL) AS missing, count(*) FILTER (WHERE NOT good) AS error FROM j GROUP BY GROUPING SETS ((split), ())""",
)
def outcomes(jobs: DataFrame, b: DataFrame) -> DataFrame:
    """ok, missing and error per split and over all."""
    d = b.groupBy(canonical_vid(F.col("vid")).alias("v")).agg(F.bool_or(~F.coalesce("failed", F.lit(True))).alias("good"))
    j = jobs.select(split().alias("split"), canonical_vid(F.col("vid")).alias("v")).join(d, "v", "left")
    g = F.col("good")
    s = j.groupBy("split").agg(F.count_if(g).alias("ok"), F.count_if(g.isNull()).alias("missing"), F.count_if(~g).alias("error"))
    return s.unionByName(s.agg(*[F.sum(c).alias(c) for c in ("ok", "missing", "error")]).withColumn("split", F.lit("ALL")))


@query(
    "a55_pivot", "gen_samples",
    sql="""SELECT global_step, coalesce(round(avg(length(hypothesis)) FILTER (WHERE source = 'openasl'), 4), 0) AS openasl_length, coalesce(round(avg(length(hypothesis)) FILTER (WHERE source = 'how2sign'), 4), 0) AS how2sign_length,
      count(*) FILTER (WHERE source = 'openasl') AS openasl_n, count(*) FILTER (WHERE source = 'how2sign') AS how2sign_n FROM gen_samples GROUP BY 1""",
)
def pivoted(g: DataFrame) -> DataFrame:
    """Metrics by source as one wide row per step; zeros where absent."""
    p = g.groupBy("global_step").pivot("source", ["openasl", "how2sign"]).agg(F.round(F.avg(F.length("hypothesis")), 4).alias("length"), F.count(F.lit(1)).alias("n"))
    return p.na.fill(0)


@query(
    "a56_running_spikes", "events",
    sql="SELECT event_id, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spikes FROM events",
)
def running_spikes(e: DataFrame, above: float = 50.0) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.select("event_id", F.sum(F.when(F.col("value") > above, 1).otherwise(0)).over(w).alias("spikes"))
