"""The curation chain as one plan, and the flagship summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnloom.functions import scalars as S, text as T
from tarnloom.functions.ids import canonical_source, canonical_split
from tarnloom.operators import fuzzy, splitting
from tarnloom.plans.filters import WPS_SQL
from tarnloom.plans.joins import REMOVALS_SQL, fuzzy_rows
from tarnloom.plans.lineage import cut, table
from tarnloom.plans.registry import SOURCE_SQL, SPLIT_SQL, norm_sql, query
from tarnloom.plans.texts import PIPELINE_SQL, fix_pipeline


def curation_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(table(spark, d, "manifest"))


@query(
    "q1_curation_summary", "manifest",
    sql=f"""WITH n AS (SELECT pos, {norm_sql()} AS norm, {SPLIT_SQL} AS split, {SOURCE_SQL} AS source, duration_sec FROM manifest WHERE text IS NOT NULL),
      k AS (SELECT * FROM n WHERE norm <> '' AND split IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split, norm ORDER BY pos) = 1)
      SELECT split, source, count(*) AS clips, round(sum(duration_sec), 3) AS seconds FROM k
      WHERE split = 'train' OR norm NOT IN (SELECT norm FROM k WHERE split = 'train') GROUP BY 1, 2""",
)
def summary(m: DataFrame) -> DataFrame:
    """Texts normalised, the first of each text kept within its split, evaluation
    rows that stand in train removed; clips and seconds per split and source."""
    n = m.where(F.col("text").isNotNull()).select(
        "pos", T.normalised(F.col("text")).alias("norm"), canonical_split(F.col("split")).alias("split"),
        canonical_source(F.col("source")).alias("source"), "duration_sec",
    ).where("norm <> '' AND split IS NOT NULL")
    kept = n.groupBy("split", "norm").agg(F.min_by(F.struct("source", "duration_sec"), "pos").alias("r")).select("split", "norm", "r.*")
    train = kept.where("split = 'train'")
    clean = train.unionByName(kept.where("split <> 'train'").join(train.select("norm"), "norm", "left_anti"))
    return clean.groupBy("split", "source").agg(F.count("*").alias("clips"), F.round(F.sum("duration_sec"), 3).alias("seconds"))


_SLOW_SQL = f"slow AS MATERIALIZED (SELECT * FROM (SELECT *, {WPS_SQL} AS wps FROM manifest) WHERE NOT coalesce(wps > 5.0 AND NOT isnan(wps), false))"
_REMOVED_SQL = REMOVALS_SQL.removeprefix("RECURSIVE ").replace("FROM manifest", "FROM slow")
_FIXED_SQL = PIPELINE_SQL.replace("FROM manifest WHERE", "FROM slow WHERE pos NOT IN (SELECT pos FROM gone) AND")
_CURATED_SQL = f"""WITH RECURSIVE {_SLOW_SQL}, {_REMOVED_SQL}, {_FIXED_SQL},
  k AS (SELECT fixes.pos, fixes.fixed AS text, slow.source, {SOURCE_SQL.replace('source', 'slow.source')} AS stratum FROM fixes JOIN slow USING (pos)),
  d AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || pos), pos) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM k),
  v AS (SELECT *, round_even(n * 0.05, 0) AS v FROM d)
  SELECT pos, text, source, CASE WHEN r <= n - 2 * v THEN 'train' WHEN r <= n - v THEN 'val' ELSE 'test' END AS new_split FROM v"""


@query("q2_curated_manifest", "manifest", sql=_CURATED_SQL)
def curated(m: DataFrame) -> DataFrame:
    """``(pos, text, source, new_split)``: the whole chain.  Fast speech, exact and
    fuzzy copies within and across splits go; texts are fixed; what stays is dealt
    anew, stratified by source."""
    w = S.wps(F.col("word_count"), F.col("duration_sec"))
    slow = m.where(~F.coalesce((w > 5.0) & ~F.isnan(w), F.lit(False)))
    gone = fuzzy.removals(fuzzy_rows(slow)).select("pos")
    kept = slow.join(gone, "pos", "left_anti")
    # written, since ranking reads its input more than once
    fixed = cut(fix_pipeline(kept, "source").select("pos", "fixed", "source"), "fixed")
    out = splitting.stratified(fixed, "pos", canonical_source(F.col("source")))
    return out.select("pos", F.col("fixed").alias("text"), "source", "new_split")
