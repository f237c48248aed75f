"""Scans, sinks, JSON and arrays: every source and sink is written and read again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnloom.functions.ids import canonical_split, canonical_vid
from tarnloom.operators import splitting
from tarnloom.plans.lineage import scratch, table
from tarnloom.plans.registry import ORACLE, QUERIES, SPLIT_SQL, query, vid_sql
from tarnloom.sources import readers as R, schema, writers as K


def with_session(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


def _tsv(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "manifest-tsv")
    K.write_separated(table(spark, d, "manifest"), path, ["vid", "text", "duration_sec", "word_count", "file_path", "source"])
    return path


@with_session("s01_k01_tsv_strings", sql="SELECT vid, nullif(text, '') AS text, word_count::VARCHAR AS word_count, source FROM manifest")
def tsv_strings(spark: SparkSession, d: str) -> DataFrame:
    """A manifest written as TSV and read back as strings; an empty text is null."""
    return R.read_separated(spark, _tsv(spark, d), multi_line=True).select("vid", F.nullif("text", F.lit("")).alias("text"), "word_count", "source")


@with_session("s02_s03_tsv_typed", sql="SELECT vid, duration_sec, word_count FROM manifest")
def tsv_typed(spark: SparkSession, d: str) -> DataFrame:
    """The same, with a declared schema."""
    return R.read_separated(spark, _tsv(spark, d), ddl=schema.MANIFEST, multi_line=True).select("vid", "duration_sec", "word_count")


@query("s04_pruned_scan", "manifest", sql="SELECT vid, source, duration_sec FROM manifest WHERE duration_sec > 5")
def pruned_scan(m: DataFrame) -> DataFrame:
    return m.where("duration_sec > 5").select("vid", "source", "duration_sec")


@with_session("s05_split_files", sql=f"SELECT {SPLIT_SQL} AS split, count(*) AS n FROM clip_jobs WHERE {SPLIT_SQL} IS NOT NULL GROUP BY 1")
def split_files(spark: SparkSession, d: str) -> DataFrame:
    """A file per split written, then read as one table; a missing file is skipped."""
    root = scratch(spark, "splits")
    jobs = table(spark, d, "clip_jobs").withColumn("s", canonical_split(F.col("split")))
    paths = {s: f"{root}/{s}" for s in ("train", "val", "test")}
    for s, path in paths.items():
        K.write_separated(jobs.where(F.col("s") == s), path, ["vid", "clip_start", "clip_end"])
    df = R.read_splits(spark, {**paths, "extra": f"{root}/none"}, on_missing="skip")
    return df.groupBy("split").agg(F.count("*").alias("n"))


@with_session("s06_csv_boxes", sql="SELECT vid, x1, y1, x2, y2, failed FROM bbox")
def csv_boxes(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "bbox-csv")
    K.write_separated(table(spark, d, "bbox"), path, sep=",", order=["vid"])
    df = R.read_separated(spark, path, sep=",", ddl="vid string, x1 int, y1 int, x2 int, y2 int, failed boolean")
    return df.select("vid", "x1", "y1", "x2", "y2", "failed")


@query("s07_parquet_scan", "embeddings", sql="SELECT vec_id, label FROM embeddings WHERE label = 3")
def parquet_scan(e: DataFrame) -> DataFrame:
    return e.where("label = 3").select("vec_id", "label")


@with_session(
    "s08_json_map",
    sql=f"""SELECT {vid_sql()} AS vid, round(max(x1::DOUBLE / frame_width), 9) AS left_edge FROM bbox WHERE x1 IS NOT NULL AND frame_width > 0 GROUP BY 1""",
)
def json_map(spark: SparkSession, d: str, most: int = 1000) -> DataFrame:
    """Boxes as JSON objects ({vid: [x]}) of about ``most`` clips, one a line, read as rows."""
    path = scratch(spark, "boxes-json")
    b = table(spark, d, "bbox").where("x1 IS NOT NULL AND frame_width > 0")
    per = b.groupBy(canonical_vid(F.col("vid")).alias("vid")).agg(F.max(F.col("x1") / F.col("frame_width")).alias("x"))
    # as many objects as rows ask for, so that none grows with the table
    buckets = per.groupBy(F.pmod(F.xxhash64("vid"), F.ceil(per.agg(F.count("*")).scalar() / most) + 1).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("vid", F.array("x")))).alias("m"))
    buckets.select(F.to_json("m").alias("value")).write.text(path)
    lines = spark.read.text(path)
    rows = lines.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("vid", "v"))
    return rows.select("vid", F.round(F.get("v", F.lit(0)), 9).alias("left_edge"))


@with_session("s09_k08_json_documents", sql="SELECT doc_id, n_chars, lang FROM documents")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "docs-json")
    K.write_json(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), path)
    return spark.read.schema("doc_id long, n_chars long, lang string").json(path)


@with_session("s10_k05_append_log", sql="SELECT global_step, source, count(*) AS n FROM gen_samples GROUP BY ALL")
def append_log(spark: SparkSession, d: str) -> DataFrame:
    """A log written in two appends, read with positions."""
    path = scratch(spark, "log")
    g = table(spark, d, "gen_samples").select("global_step", "source")
    for half in (0, 1):
        K.append_log(g.where(F.col("global_step") % 2 == half), path, ["global_step", "source", "note"])
    log = R.with_positions(R.read_separated(spark, path, sep=","))
    return log.groupBy(F.col("global_step").cast("long").alias("global_step"), "source").agg(F.count("pos").alias("n"))


@with_session("s11_listing", sql="SELECT count(*) AS files, true AS sane FROM (SELECT DISTINCT doc_kind FROM documents)")
def listing(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder by their metadata only."""
    path = scratch(spark, "kinds")
    table(spark, d, "documents").select("doc_kind", "doc_id").repartition("doc_kind").write.partitionBy("doc_kind").parquet(path)
    files = R.list_files(spark, path, "*.parquet").select(F.regexp_extract("path", "doc_kind=([^/]+)", 1).alias("k"), "length")
    return files.groupBy("k").agg(F.min("length").alias("least")).agg(F.count("*").alias("files"), F.bool_and(F.col("least") >= 500).alias("sane"))


@with_session("s13_npz", sql="SELECT vec_id, len(embedding)::INT AS n FROM embeddings")
def npz(spark: SparkSession, d: str) -> DataFrame:
    """All vectors as npz archives, written by tasks and read back: per batch and
    length one archive of many vectors.  A null vector stays null."""
    path = scratch(spark, "npz")
    K.write_npz(table(spark, d, "embeddings").select("vec_id", "embedding"), path, "vec_id", "embedding", "pose")
    ids = R.read_npz(spark, path, "vec_id", "array<long>").select("path", F.posexplode("data").alias("i", "vec_id"))
    poses = R.read_npz(spark, path, "pose", "array<array<float>>").select("path", F.col("data").alias("pose"))
    return ids.join(poses, "path").select("vec_id", F.size(F.get("pose", F.col("i"))).alias("n"))


@with_session("k02_sorted_sink", sql="SELECT vid, detection_rate FROM bbox")
def sorted_sink(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "sorted")
    K.write_separated(table(spark, d, "bbox"), path, ["vid", "detection_rate"], order=["vid", "detection_rate"])
    return R.read_separated(spark, path, ddl="vid string, detection_rate double")


@with_session("k03_csv_sink", sql="SELECT doc_id, doc_kind, n_chars FROM documents")
def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    """A table as CSV with its columns in a fixed order, read back."""
    path = scratch(spark, "docs-csv")
    K.write_separated(table(spark, d, "documents"), path, ["doc_id", "doc_kind", "n_chars"], sep=",")
    return R.read_separated(spark, path, sep=",", ddl="doc_id long, doc_kind string, n_chars long")


@with_session("k06_deleted_sources", sql="SELECT source_file, count(*) AS jobs FROM clip_jobs WHERE source_file IS NOT NULL GROUP BY 1")
def deleted_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source files logged as deleted, split by split, each append with the columns
    of the first; rows without a source file are not logged."""
    path = scratch(spark, "deleted")
    jobs = table(spark, d, "clip_jobs").where("source_file IS NOT NULL").withColumn("s", F.coalesce(canonical_split(F.col("split")), F.lit("none")))
    for s in ("train", "val", "test", "none"):
        K.append_log(jobs.where(F.col("s") == s), path, ["source_file", "vid", "reason"])
    return R.read_separated(spark, path, sep=",").groupBy("source_file").agg(F.count("*").alias("jobs"))


@with_session("k13_run_config", sql="SELECT unnest(['rows', 'tables']) AS name, unnest([count(*)::VARCHAR, '[\"manifest\"]']) AS value FROM manifest")
def run_config(spark: SparkSession, d: str) -> DataFrame:
    """The configuration of a run as a text report, ``name = JSON`` a line, read back."""
    path = scratch(spark, "config")
    text = K.render_config({"tables": ["manifest"], "rows": table(spark, d, "manifest").count()})
    spark.createDataFrame([(line,) for line in text.splitlines()], "value string").coalesce(1).write.text(path)
    line = F.split("value", " = ", 2)
    return spark.read.text(path).select(line[0].alias("name"), line[1].alias("value"))


@with_session("k04_k11_versions", sql="SELECT split, count(*) AS n FROM manifest WHERE split IS NOT NULL GROUP BY 1")
def versions(spark: SparkSession, d: str) -> DataFrame:
    """Two versions committed; the reader sees the second, the first is a backup."""
    root = scratch(spark, "versions")
    g = table(spark, d, "manifest").groupBy("split").agg(F.count("*").alias("n"))
    K.commit_version(g, root)
    K.commit_version(g.where("split IS NOT NULL"), root)
    return K.read_current(spark, root)


@query("k08_n04_nested_json", "bbox", sql="""SELECT vid, '{"x1":' || coalesce(x1::VARCHAR, 'null') || ',"x2":' || coalesce(x2::VARCHAR, 'null') || ',"failed":' || coalesce(failed::VARCHAR, 'null') || '}' AS json FROM bbox""")
def nested_json(b: DataFrame) -> DataFrame:
    return K.nested_json(b, "vid", ["x1", "x2", "failed"])


@query(
    "k12_scalar_events", "gen_samples",
    sql="""WITH s AS (SELECT global_step, count(*)::DOUBLE AS samples, round(avg(length(hypothesis)), 6) AS mean_length FROM gen_samples GROUP BY 1)
      SELECT global_step, 'samples' AS metric, samples AS value FROM s UNION ALL SELECT global_step, 'mean_length', mean_length FROM s WHERE mean_length IS NOT NULL""",
)
def scalar_events(g: DataFrame) -> DataFrame:
    s = g.groupBy("global_step").agg(F.count("*").alias("samples"), F.round(F.avg(F.length("hypothesis")), 6).alias("mean_length"))
    return K.scalar_events(s, "global_step", ["samples", "mean_length"])


@query("k07_k09_report", "manifest", sql=f"SELECT {SPLIT_SQL} AS split, count(*) AS n FROM manifest GROUP BY 1")
def report(m: DataFrame) -> DataFrame:
    """The table behind a report; ``render`` makes the text."""
    return m.groupBy(canonical_split(F.col("split")).alias("split")).agg(F.count("*").alias("n"))


@query(
    "n01_probe_json", "bbox",
    sql="""SELECT vid, frame_width AS width, frame_height AS height, round(num_sampled_frames / 10.0, 6) AS duration, round(num_sampled_frames::DOUBLE / nullif(num_detected_frames, 0), 4) AS fps
      FROM bbox WHERE frame_width IS NOT NULL AND num_sampled_frames IS NOT NULL""",
)
def probe_json(b: DataFrame) -> DataFrame:
    """Media probe documents parsed (here made from the boxes)."""
    ok = b.where("frame_width IS NOT NULL AND num_sampled_frames IS NOT NULL")
    rate = F.concat_ws("/", F.col("num_sampled_frames").cast("string"), F.coalesce(F.col("num_detected_frames").cast("string"), F.lit("0")))
    stream = F.struct(F.lit("video").alias("codec_type"), F.col("frame_width").alias("width"), F.col("frame_height").alias("height"), rate.alias("avg_frame_rate"), F.lit("0/0").alias("r_frame_rate"))
    sound = F.struct(F.lit("audio").alias("codec_type"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("avg_frame_rate"), F.lit(None).cast("string").alias("r_frame_rate"))
    made = F.to_json(F.struct(F.struct((F.col("num_sampled_frames") / 10.0).cast("string").alias("duration")).alias("format"), F.array(sound, stream).alias("streams")))
    got = R.parse_probe(ok.select("vid", made.alias("probe")))
    return got.select("vid", "width", "height", F.round("duration", 6).alias("duration"), "fps")


@query("n02_json_field", "events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_field(e: DataFrame) -> DataFrame:
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("n03_npy_round_trip", "embeddings", sql="SELECT vec_id, embedding[1:3] AS head, len(embedding)::INT AS n FROM embeddings")
def npy_round_trip(e: DataFrame) -> DataFrame:
    """Arrays as npy bytes and back."""
    import io

    @F.pandas_udf("binary")
    def to_npy(s: pd.Series) -> pd.Series:
        import numpy as np

        def one(v) -> bytes:
            raw = io.BytesIO()
            np.save(raw, np.asarray(v, np.float32))
            return raw.getvalue()

        return s.map(one)

    back = R.decode_npy(e.select("vec_id", to_npy("embedding").alias("v")), {"v": "array<float>"})
    return back.select("vec_id", F.slice("v", 1, 3).alias("head"), F.size("v").alias("n"))


@query(
    "n05_array_functions", "embeddings",
    sql="SELECT vec_id, embedding[2:4] || embedding[1:1] AS parts, len(list_filter(embedding, lambda x: x > 0.4)) > 0 AS any_high, len(list_filter(embedding, lambda x: x > -0.5)) = len(embedding) AS all_above FROM embeddings",
)
def array_functions(e: DataFrame) -> DataFrame:
    v = F.col("embedding")
    return e.select("vec_id", F.concat(F.slice(v, 2, 3), F.slice(v, 1, 1)).alias("parts"), F.exists(v, lambda x: x > 0.4).alias("any_high"), F.forall(v, lambda x: x > -0.5).alias("all_above"))


@query(
    "n06_padded", "manifest",
    sql=r"""WITH w AS (SELECT pos, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM manifest WHERE text IS NOT NULL),
      r AS (SELECT *, (row_number() OVER (ORDER BY len(w), pos) - 1) // 64 AS batch FROM w), n AS (SELECT *, max(len(w)) OVER (PARTITION BY batch) AS n FROM r)
      SELECT pos, batch, list_resize(w, n, '<pad>') AS padded, list_transform(range(1, n + 1), lambda i: i <= len(w)) AS mask FROM n""",
)
def padded(m: DataFrame, size: int = 64) -> DataFrame:
    """Batches of ``size`` texts of like length, their words padded to the longest of
    the batch, with a mask: one long text lengthens its own batch only."""
    w = m.where(F.col("text").isNotNull()).select("pos", F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != "").alias("w"))
    rows = splitting.batches(w.withColumn("k", F.size("w")), ["k", "pos"], size)
    both = rows.join(rows.groupBy("batch").agg(F.max("k").alias("n")), "batch")
    mask = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: i <= F.col("k"))).otherwise(F.array().cast("array<boolean>"))
    return both.select("pos", "batch", F.concat("w", F.array_repeat(F.lit("<pad>"), F.col("n") - F.col("k"))).alias("padded"), mask.alias("mask"))


@query("n07_grouped_by_size", "bbox", sql=f"SELECT {vid_sql()} AS vid, frame_width, frame_height, count(*) OVER (PARTITION BY frame_width, frame_height) AS alike FROM bbox WHERE frame_width IS NOT NULL")
def grouped_by_size(b: DataFrame) -> DataFrame:
    """Clips of one resolution together, the group's result scattered back."""
    ok = b.where("frame_width IS NOT NULL")
    n = ok.groupBy("frame_width", "frame_height").agg(F.count("*").alias("alike"))
    return ok.join(n, ["frame_width", "frame_height"]).select(canonical_vid(F.col("vid")).alias("vid"), "frame_width", "frame_height", "alike")


@query(
    "d07_boxes_to_points", "bbox",
    sql=f"SELECT {vid_sql()} AS vid, unnest(['left', 'right']) AS side, unnest([x1, x2]) AS x FROM bbox WHERE x1 IS NOT NULL",
)
def boxes_to_points(b: DataFrame) -> DataFrame:
    """A table-valued step: one row in, several out."""
    pts = F.array(F.struct(F.lit("left").alias("side"), F.col("x1").alias("x")), F.struct(F.lit("right").alias("side"), F.col("x2").alias("x")))
    return b.where("x1 IS NOT NULL").select(canonical_vid(F.col("vid")).alias("vid"), F.inline(pts))


@query("d02_worker_state", "documents", sql="SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents WHERE text IS NOT NULL")
def worker_state(docs: DataFrame) -> DataFrame:
    """A worker that sets itself up once per partition and then takes batches."""

    def run(batches):
        import re

        digits = re.compile("[0-9]+")
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "numbers": [len(digits.findall(t)) for t in b["text"]]})

    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, "doc_id long, numbers long")
