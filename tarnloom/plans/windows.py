"""Windows, ranking, top-k, set operations, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from tarnloom.functions import text as T
from tarnloom.functions.ids import canonical_source, canonical_split, canonical_vid
from tarnloom.operators import graph, profile as P, series as S, splitting as R
from tarnloom.plans.joins import _BEST_SQL, REMOVALS_SQL, best_boxes, fuzzy_rows
from tarnloom.operators import fuzzy
from tarnloom.plans.registry import SOURCE_SQL, SPLIT_SQL, norm_sql, query, vid_sql


@query(
    "w01_keep_first", "manifest",
    sql=f"SELECT pos, split FROM (SELECT pos, {SPLIT_SQL} AS split, row_number() OVER (PARTITION BY {SPLIT_SQL}, text ORDER BY pos) AS rn FROM manifest) WHERE rn = 1",
)
def keep_first(m: DataFrame) -> DataFrame:
    """The first row of each text within its split, as a combinable minimum: no
    group of equal texts is sorted.  Null texts are equal to each other."""
    return m.groupBy(canonical_split(F.col("split")).alias("split"), "text").agg(F.min("pos").alias("pos")).select("pos", "split")


@query("w02_duplicated_flag", "manifest", sql="SELECT pos, count(*) OVER (PARTITION BY text) > 1 AS duplicated FROM manifest")
def duplicated_flag(m: DataFrame) -> DataFrame:
    n = m.groupBy("text").agg((F.count("*") > 1).alias("duplicated")).withColumnRenamed("text", "t")
    return m.select("pos", "text").join(n, F.col("text").eqNullSafe(F.col("t"))).select("pos", "duplicated")


@query("w03_best_record", "bbox", sql=f"WITH {_BEST_SQL} SELECT v AS vid, coalesce(failed, true) AS failed, detection_rate FROM best")
def best_record(b: DataFrame) -> DataFrame:
    return best_boxes(b).select(F.col("v").alias("vid"), F.coalesce("failed", F.lit(True)).alias("failed"), "detection_rate")


_EDGE_SQL = f"""e AS (SELECT DISTINCT {vid_sql('vid_a')} AS a, {vid_sql('vid_b')} AS b FROM match_pairs WHERE score >= 90 AND vid_a IS NOT NULL AND vid_b IS NOT NULL),
  s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM s UNION SELECT b, b FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen)"""


def _links(p: DataFrame) -> DataFrame:
    return p.where(F.col("score") >= 90).select(canonical_vid(F.col("vid_a")).alias("a"), canonical_vid(F.col("vid_b")).alias("b"))


@query("w04_cluster_keepers", "match_pairs", sql=f"WITH RECURSIVE {_EDGE_SQL}, c AS (SELECT node, min(seen) AS keeper FROM r GROUP BY 1) SELECT keeper, count(*) AS members FROM c GROUP BY 1 HAVING count(*) > 1")
def cluster_keepers(p: DataFrame) -> DataFrame:
    """The smallest id of each cluster, and its size."""
    return graph.components(_links(p)).groupBy(F.col("component").alias("keeper")).agg(F.count("*").alias("members"))


@query("w05_components", "match_pairs", sql=f"WITH RECURSIVE {_EDGE_SQL}, c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1) SELECT node, component FROM c WHERE node IN (SELECT a FROM s WHERE a <> b)")
def components(p: DataFrame) -> DataFrame:
    return graph.components(_links(p))


@query(
    "w06_deorphaned", "gen_samples",
    sql="""WITH s AS (SELECT source, epoch_us(logged_at) AS t, global_step, min(global_step) OVER (PARTITION BY source ORDER BY logged_at, reference, hypothesis ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM gen_samples)
      SELECT source, t, global_step FROM s WHERE later IS NULL OR global_step < later""",
)
def deorphaned(g: DataFrame) -> DataFrame:
    out = S.deorphaned(g, ["source"], ["logged_at", "reference", "hypothesis"], F.col("global_step"))
    return out.select("source", F.unix_micros(F.col("logged_at").cast("timestamp")).alias("t"), "global_step")


_EV = "PARTITION BY user_id ORDER BY ts, event_id"


@query("w07_moving_average", "events", sql=f"SELECT event_id, round(avg(value) OVER ({_EV} ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 9) AS mean FROM events")
def moving_average(e: DataFrame) -> DataFrame:
    return e.select("event_id", F.round(S.moving_average("value", ["user_id"], ["ts", "event_id"], 50), 9).alias("mean"))


@query("w08_trailing_mean", "events", sql=f"SELECT event_id, round(avg(value) OVER ({_EV} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def trailing_mean(e: DataFrame) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return e.select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query(
    "w09_phase_change", "gen_samples",
    sql="""WITH s AS (SELECT source, epoch_us(logged_at) AS t, epoch, lag(epoch) OVER (PARTITION BY source ORDER BY logged_at, reference, hypothesis) AS before FROM gen_samples)
      SELECT source, min(t) AS first_change FROM s WHERE epoch = 2 AND before <> 2 GROUP BY 1""",
)
def phase_change(g: DataFrame) -> DataFrame:
    w = W.partitionBy("source").orderBy("logged_at", "reference", "hypothesis")
    s = g.select("source", F.unix_micros(F.col("logged_at").cast("timestamp")).alias("t"), "epoch", F.lag("epoch").over(w).alias("before"))
    return s.where("epoch = 2 AND before <> 2").groupBy("source").agg(F.min("t").alias("first_change"))


@query(
    "w10_early_stop", "events",
    sql=f"""WITH m AS (SELECT *, min(value) OVER ({_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events), i AS (SELECT *, best IS NULL OR value < best AS improved FROM m),
      g AS (SELECT *, sum(improved::INT) OVER ({_EV} ROWS UNBOUNDED PRECEDING) AS grp FROM i), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) - 1 AS waited FROM g)
      SELECT user_id, min(event_id) FILTER (WHERE waited >= 20) AS stopped_at FROM p GROUP BY 1""",
)
def early_stop(e: DataFrame, most: int = 20) -> DataFrame:
    """The first event after ``most`` ones without a new least value."""
    p = S.patience(e.select("user_id", "ts", "event_id", "value"), "value", ["user_id"], ["ts", "event_id"])
    return p.groupBy("user_id").agg(F.min(F.when(F.col("waited") >= most, F.col("event_id"))).alias("stopped_at"))


@query(
    "w11_cumulative_hours", "manifest",
    sql=f"SELECT pos, round(sum(duration_sec) OVER (PARTITION BY {SOURCE_SQL}, {SPLIT_SQL} ORDER BY duration_sec, pos ROWS UNBOUNDED PRECEDING) / 3600, 9) AS hours FROM manifest WHERE duration_sec IS NOT NULL",
)
def cumulative_hours(m: DataFrame) -> DataFrame:
    d = m.where("duration_sec IS NOT NULL").select("pos", "duration_sec", canonical_source(F.col("source")).alias("source"), canonical_split(F.col("split")).alias("split"))
    return R.running_sum(d, ["source", "split"], ["duration_sec", "pos"], "duration_sec", "sum").select("pos", F.round(F.col("sum") / 3600, 9).alias("hours"))


@query(
    "w12_despiked", "events",
    sql=f"""WITH n AS (SELECT event_id, value, (lag(value) OVER ({_EV}) + lead(value) OVER ({_EV})) / 2 AS mid FROM events)
      SELECT event_id, CASE WHEN coalesce(abs(value - mid) <= 20, true) THEN value END AS value FROM n""",
)
def despiked(e: DataFrame) -> DataFrame:
    return S.despiked(e.select("user_id", "ts", "event_id", "value"), "value", ["user_id"], ["ts", "event_id"], 20.0).select("event_id", "value")


_GAPS = "SELECT user_id, ts, event_id, CASE WHEN event_id % 5 < 3 THEN value END AS v FROM events"


def _gappy(e: DataFrame) -> DataFrame:
    return e.select("user_id", "ts", "event_id", F.when(F.col("event_id") % 5 < 3, F.col("value")).alias("v"))


_FILL_SQL = f"""g0 AS ({_GAPS}), g1 AS (SELECT *, count(v) OVER ({_EV} ROWS UNBOUNDED PRECEDING) AS g FROM g0),
  g2 AS (SELECT *, max(g) OVER (PARTITION BY user_id) AS l, count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY user_id, g) AS n, first_value(v) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS b FROM g1),
  f AS (SELECT user_id, ts, event_id, CASE WHEN v IS NULL AND g > 0 AND g < l AND n <= 2 THEN b ELSE v END AS v FROM g2)"""


@query("w13_gap_filled", "events", sql=f"WITH {_FILL_SQL} SELECT event_id, v FROM f")
def gap_filled(e: DataFrame) -> DataFrame:
    return S.filled(_gappy(e), "v", ["user_id"], ["ts", "event_id"], 2).select("event_id", "v")


_SMOOTH = """SELECT event_id, round(CASE WHEN lag(v) OVER w IS NOT NULL AND v IS NOT NULL AND lead(v) OVER w IS NOT NULL THEN 0.25 * lag(v) OVER w + 0.5 * v + 0.25 * lead(v) OVER w ELSE v END, 6) AS v
  FROM {t} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query("w14_smoothed", "events", sql=f"WITH t AS ({_GAPS}) {_SMOOTH.format(t='t')}")
def smoothed(e: DataFrame) -> DataFrame:
    return S.smoothed(_gappy(e), ["v"], ["user_id"], ["ts", "event_id"]).select("event_id", F.round("v", 6).alias("v"))


@query(
    "w15_series_pipeline", "events",
    sql=f"""WITH n AS (SELECT *, (lag(value) OVER ({_EV}) + lead(value) OVER ({_EV})) / 2 AS mid FROM events), d AS (SELECT user_id, ts, event_id, CASE WHEN coalesce(abs(value - mid) <= 20, true) THEN value END AS value FROM n),
      {_FILL_SQL.replace(_GAPS, 'SELECT user_id, ts, event_id, value AS v FROM d')} {_SMOOTH.format(t='f')}""",
)
def series_pipeline(e: DataFrame) -> DataFrame:
    """Spikes out, short gaps filled, three-tap smoothing."""
    key, order = ["user_id"], ["ts", "event_id"]
    s = S.despiked(e.select("user_id", "ts", "event_id", F.col("value").alias("v")), "v", key, order, 20.0)
    return S.smoothed(S.filled(s, "v", key, order, 2), ["v"], key, order).select("event_id", F.round("v", 6).alias("v"))


_BATCH_SQL = "(row_number() OVER (ORDER BY duration_sec, pos) - 1) // 32"


@query("w16_batches", "manifest", sql=f"SELECT pos, {_BATCH_SQL} AS batch FROM manifest WHERE duration_sec IS NOT NULL")
def batches(m: DataFrame) -> DataFrame:
    """Batches of 32 rows of near-equal duration."""
    d = m.where("duration_sec IS NOT NULL").select("pos", "duration_sec")
    return R.batches(d, ["duration_sec", "pos"], 32).select("pos", "batch")


@query(
    "w17_curriculum", "manifest",
    sql="""WITH r AS (SELECT pos, duration_sec > 4.0 AS hard, (row_number() OVER (PARTITION BY duration_sec > 4.0 ORDER BY duration_sec, pos) - 1) // 32 AS b FROM manifest WHERE duration_sec IS NOT NULL)
      SELECT pos, hard, b + CASE WHEN hard THEN (SELECT coalesce(max(b) + 1, 0) FROM r WHERE NOT hard) ELSE 0 END AS batch FROM r""",
)
def curriculum(m: DataFrame, easy: float = 4.0, size: int = 32) -> DataFrame:
    """Easy clips first, batches within either part."""
    d = m.where("duration_sec IS NOT NULL").select("pos", "duration_sec", (F.col("duration_sec") > easy).alias("hard"))
    ranked = R.ranked(d, ["hard", "duration_sec", "pos"], "rank")
    r = ranked.withColumn("easy_rows", d.where("NOT hard").agg(F.count("*")).scalar())
    first = F.ceil(F.col("easy_rows") / size)
    batch = F.when(F.col("hard"), first + F.floor((F.col("rank") - F.col("easy_rows")) / size)).otherwise(F.floor(F.col("rank") / size))
    return r.select("pos", "hard", batch.alias("batch"))


@query(
    "w18_batch_order", "manifest",
    sql=f"WITH b AS (SELECT DISTINCT {_BATCH_SQL} AS batch FROM manifest WHERE duration_sec IS NOT NULL) SELECT batch, row_number() OVER (ORDER BY md5('42:3:' || batch)) AS place FROM b",
)
def batch_order(m: DataFrame, seed: int = 42, epoch: int = 3) -> DataFrame:
    """Batches in an order drawn by seed and epoch."""
    b = batches(m).select("batch").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col("batch").cast("string"))))
    return R.ranked(b, ["h"], "place").select("batch", (F.col("place") + 1).alias("place"))


@query("w19_last_k", "events", sql="SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def last_k(e: DataFrame, k: int = 5) -> DataFrame:
    """A queue of the last k per key."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.select("event_id", F.row_number().over(w).alias("k")).where(F.col("k") <= k).select("event_id")


@query(
    "w20_retained_checkpoints", "gen_samples",
    sql="""WITH s AS (SELECT global_step, avg(length(hypothesis)) AS v FROM gen_samples GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY global_step DESC) AS k, row_number() OVER (ORDER BY v DESC NULLS LAST, global_step) AS b FROM s)
      SELECT global_step FROM r WHERE k <= 3 OR b = 1""",
)
def retained(g: DataFrame, keep: int = 3) -> DataFrame:
    """The last checkpoints, and the best one whatever its age."""
    s = g.groupBy("global_step").agg(F.avg(F.length("hypothesis")).alias("v"))
    last = s.orderBy(F.desc("global_step")).limit(keep).select("global_step")
    best = s.orderBy(F.desc_nulls_last("v"), "global_step").limit(1).select("global_step")
    return last.union(best).distinct()


@query(
    "w21_union_box", "bbox",
    sql=f"SELECT {vid_sql()} AS vid, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(DISTINCT num_sampled_frames) AS kinds FROM bbox WHERE detection_rate >= 0.5 GROUP BY 1",
)
def union_box(b: DataFrame, visible: float = 0.5) -> DataFrame:
    ok = b.where(F.col("detection_rate") >= visible)
    return ok.groupBy(canonical_vid(F.col("vid")).alias("vid")).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.countDistinct("num_sampled_frames").alias("kinds"))


@query(
    "w22_sample_lookup", "bbox",
    sql="SELECT vid, num_sampled_frames AS n, round_even(0.4 * greatest(num_sampled_frames - 1, 0) / greatest(num_sampled_frames - 1, 1) * greatest(num_sampled_frames - 1, 0), 0)::INT AS place FROM bbox WHERE num_sampled_frames IS NOT NULL",
)
def sample_lookup(b: DataFrame, at: float = 0.4) -> DataFrame:
    """The sample at a share of the clip, by proportion."""
    last = F.greatest(F.col("num_sampled_frames") - 1, F.lit(0))
    return b.where("num_sampled_frames IS NOT NULL").select("vid", F.col("num_sampled_frames").alias("n"), F.bround(at * last / F.greatest(last, F.lit(1)) * last).cast("int").alias("place"))


@query("o01_top_texts", "manifest", sql="SELECT text, count(*) AS n FROM manifest WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(pos) LIMIT 20")
def top_texts(m: DataFrame) -> DataFrame:
    return P.top_k(m, "text", "pos", 20)


@query("o02_top_repeated", "manifest", sql=f"SELECT k, count(*) AS n FROM (SELECT pos, {norm_sql()} AS k FROM manifest WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, min(pos) LIMIT 20")
def top_repeated(m: DataFrame) -> DataFrame:
    return P.top_k(m.where("text IS NOT NULL").select("pos", T.normalised(F.col("text")).alias("k")), "k", "pos", 20, 2)


#: Words without content.
STOP_WORDS = """the a an and or but in on at to for of with is it that this i you we they he she so are was be have not do as by from
if just my your it's that's i'm don't about what there its s re ve ll""".split()


@query(
    "o03_top_words", "manifest",
    sql=f"""WITH w AS (SELECT pos, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM manifest)
      SELECT word, count(*) AS n FROM w WHERE length(word) > 1 AND word NOT IN ({", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)}) GROUP BY 1 ORDER BY n DESC, word LIMIT 50""",
)
def top_words(m: DataFrame, k: int = 50) -> DataFrame:
    w = m.select(F.explode(T.letter_words(F.col("text"))).alias("word")).where((F.length("word") > 1) & ~F.col("word").isin(STOP_WORDS))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


@query("o04_longest", "manifest", sql="SELECT pos, word_count FROM manifest WHERE word_count IS NOT NULL ORDER BY word_count DESC, pos LIMIT 15")
def longest(m: DataFrame) -> DataFrame:
    return m.where("word_count IS NOT NULL").orderBy(F.desc("word_count"), "pos").limit(15).select("pos", "word_count")


@query("o05_pairs_by_score", "match_pairs", sql="SELECT vid_a, vid_b, score FROM match_pairs WHERE score IS NOT NULL ORDER BY score DESC, vid_a, vid_b")
def pairs_by_score(p: DataFrame) -> DataFrame:
    return p.where("score IS NOT NULL").select("vid_a", "vid_b", "score").orderBy(F.desc("score"), "vid_a", "vid_b")


@query("o06_longest_per_split", "manifest", sql=f"SELECT pos, split FROM (SELECT pos, {SPLIT_SQL} AS split, row_number() OVER (PARTITION BY {SPLIT_SQL} ORDER BY word_count DESC NULLS LAST, pos) AS k FROM manifest) WHERE k <= 10")
def longest_per_split(m: DataFrame) -> DataFrame:
    s = m.select("pos", canonical_split(F.col("split")).alias("split"), "word_count")
    k = F.row_number().over(W.partitionBy("split").orderBy(F.desc_nulls_last("word_count"), "pos"))
    return s.withColumn("k", k).where("k <= 10").select("pos", "split")


@query("o07_first_rows", "manifest", sql="SELECT pos, vid FROM manifest ORDER BY pos LIMIT 100")
def first_rows(m: DataFrame, n: int = 100) -> DataFrame:
    return m.orderBy("pos").limit(n).select("pos", "vid")


@query("o08_first_per_label", "manifest", sql=f"SELECT pos, source FROM (SELECT pos, {SOURCE_SQL} AS source, row_number() OVER (PARTITION BY {SOURCE_SQL} ORDER BY pos) AS k FROM manifest) WHERE k <= 3")
def first_per_label(m: DataFrame, n: int = 3) -> DataFrame:
    s = m.select("pos", canonical_source(F.col("source")).alias("source"))
    return s.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("pos"))).where(F.col("k") <= n).select("pos", "source")


@query("o09_sample", "manifest", sql="SELECT pos FROM manifest ORDER BY md5('42:' || pos), pos LIMIT 200")
def sample(m: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    return m.select("pos").orderBy(R.hash_key(seed, "pos"), "pos").limit(n)


@query("o10_sample_per_source", "manifest", sql=f"SELECT pos, source FROM (SELECT pos, {SOURCE_SQL} AS source, row_number() OVER (PARTITION BY {SOURCE_SQL} ORDER BY md5('42:' || pos), pos) AS k FROM manifest WHERE source IS NOT NULL) WHERE k <= 25")
def sample_per_source(m: DataFrame, n: int = 25, seed: int = 42) -> DataFrame:
    """n rows of each source; an error if a source has fewer."""
    s = m.where("source IS NOT NULL").select("pos", canonical_source(F.col("source")).alias("source"))
    drawn = s.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(R.hash_key(seed, "pos"), "pos"))).where(F.col("k") <= n)
    n_of = F.count("*").over(W.partitionBy("source"))
    checked = drawn.withColumn("n", n_of)
    return checked.where(F.when(F.col("n") < n, F.raise_error(F.lit("a source has too few rows"))).isNull()).select("pos", "source")


@query("o11_shuffled", "manifest", sql="SELECT pos, row_number() OVER (ORDER BY md5('7:' || pos), pos) AS place FROM manifest")
def shuffled(m: DataFrame, seed: int = 7) -> DataFrame:
    return R.ranked(m.select("pos").withColumn("h", R.hash_key(seed, "pos")), ["h", "pos"], "place").select("pos", (F.col("place") + 1).alias("place"))


@query("u01_union_all", "manifest", "eval_items", sql="SELECT text, source, split FROM manifest UNION ALL SELECT text, source, split FROM eval_items")
def union_all(m: DataFrame, e: DataFrame) -> DataFrame:
    return m.select("text", "source", "split").unionByName(e.select("source", "split", "text"))


def _overlap_sql(key: str, name: str) -> str:
    return f"""SELECT '{name}' AS key, a.split AS split_a, b.split AS split_b, count(*) AS shared FROM (SELECT DISTINCT {SPLIT_SQL} AS split, {key} AS k FROM manifest) a
      JOIN (SELECT DISTINCT {SPLIT_SQL} AS split, {key} AS k FROM manifest) b ON a.k = b.k AND (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test')) GROUP BY ALL"""


def overlap(m: DataFrame, name: str, key) -> DataFrame:
    """Distinct keys that two splits share: one aggregation over the key, then the
    pairs of the (at most three) splits it was met in."""
    met = m.select(canonical_split(F.col("split")).alias("split"), key.alias("k")).where("split IS NOT NULL AND k IS NOT NULL")
    sets = met.groupBy("k").agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    n = sets.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(name).alias("key"), F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs])
    return n.select(F.inline(rows)).where("shared > 0")


query("u02_shared_texts", "manifest", sql=_overlap_sql("text", "text"))(lambda m: overlap(m, "text", F.col("text")))


@query("u03_missing_extra", "manifest", "clip_jobs", sql=f"SELECT 'missing' AS kind, count(*) AS n FROM (SELECT {vid_sql()} FROM manifest EXCEPT SELECT {vid_sql()} FROM clip_jobs) UNION ALL SELECT 'extra', count(*) FROM (SELECT {vid_sql()} FROM clip_jobs EXCEPT SELECT {vid_sql()} FROM manifest)")
def missing_extra(m: DataFrame, j: DataFrame) -> DataFrame:
    a, b = (d.select(canonical_vid(F.col("vid")).alias("v")) for d in (m, j))
    count = lambda d, k: d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(a.subtract(b), "missing").union(count(b.subtract(a), "extra"))


@query("u04_union_distinct", "manifest", "eval_items", sql="SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM manifest UNION SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) FROM eval_items")
def union_distinct(m: DataFrame, e: DataFrame) -> DataFrame:
    w = lambda d: d.select(F.explode(T.letter_words(F.col("text"))).alias("word"))
    return w(m).union(w(e)).distinct()


@query("u05_overlap_matrix", "manifest", sql=" UNION ALL ".join(_overlap_sql(k, n) for k, n in (("text", "text"), (norm_sql(), "norm"), (vid_sql(), "vid"), ("file_path", "file"))))
def overlap_matrix(m: DataFrame) -> DataFrame:
    keys = [("text", F.col("text")), ("norm", T.normalised(F.col("text"))), ("vid", canonical_vid(F.col("vid"))), ("file", F.col("file_path"))]
    out = [overlap(m, n, k) for n, k in keys]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("u06_ordered_unique", "manifest", sql="WITH w AS (SELECT pos, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM manifest WHERE text IS NOT NULL) SELECT pos, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM w")
def ordered_unique(m: DataFrame) -> DataFrame:
    return m.where("text IS NOT NULL").select("pos", F.array_distinct(T.letter_words(F.col("text"))).alias("words"))


_STRAT = f"""WITH b AS (SELECT pos, {SOURCE_SQL} AS s, row_number() OVER (PARTITION BY {SOURCE_SQL} ORDER BY md5('42:' || pos), pos) AS r, count(*) OVER (PARTITION BY {SOURCE_SQL}) AS n FROM manifest),
  c AS (SELECT *, round_even(n * 0.05, 0) AS v FROM b)"""
_NEW = "CASE WHEN r <= n - 2 * v THEN 'train' WHEN r <= n - v THEN 'val' ELSE 'test' END"


@query("r01_stratified", "manifest", sql=f"{_STRAT} SELECT pos, {_NEW} AS new_split FROM c")
def stratified(m: DataFrame) -> DataFrame:
    return R.stratified(m.select("pos", "source"), "pos", canonical_source(F.col("source"))).select("pos", "new_split")


@query("r02_conserved", "manifest", sql="SELECT count(*) AS before, count(*) AS after, true AS conserved FROM manifest")
def conserved(m: DataFrame) -> DataFrame:
    """No row lost or doubled by the split."""
    after = stratified(m).agg(F.count("*").alias("after"), F.countDistinct("pos").alias("d"))
    both = after.withColumn("before", m.agg(F.count("*")).scalar())
    return both.select("before", "after", ((F.col("before") == F.col("after")) & (F.col("d") == F.col("after"))).alias("conserved"))


@query("r03_removal_priority", "manifest", sql=f"WITH {REMOVALS_SQL} SELECT pos, split, reason FROM gone")
def removal_priority(m: DataFrame) -> DataFrame:
    """``(pos, split, reason)``: rows removed as a fuzzy copy within their split, or
    as a copy of a row of a split before theirs (train, val, test)."""
    rows = fuzzy_rows(m)
    return fuzzy.removals(rows).join(rows.select("pos", F.col("side").alias("split")), "pos").select("pos", "split", "reason")
