"""Round trips through every source and sink, and streams that resume."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnloom.sources import readers as R, schema, writers as K
from tarnloom.streaming import incremental as I


def test_separated_round_trip(spark, tmp_path):
    rows = [("a", 'say "hi"\tnow', 1), ("b", "two\nlines", None), ("c", None, 3), (" d ", "NA", 4)]
    df = spark.createDataFrame(rows, "vid string, text string, n int")
    K.write_separated(df.withColumn("_help", F.lit(1)), str(tmp_path / "t"), order=["vid"])
    got = R.read_separated(spark, str(tmp_path / "t"), ddl="vid string, text string, n int", multi_line=True)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_typed_and_required(spark):
    df = spark.createDataFrame([("5.0", "x", "1.5", "k")], "word_count string, vid string, d string, extra string")
    got = schema.typed(df, "vid string, word_count int, d double")
    assert got.first().asDict() == {"word_count": 5, "vid": "x", "d": 1.5, "extra": "k"}
    with pytest.raises(ValueError, match="text"):
        schema.require(df, ["vid", "text"])


def test_split_files(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "vid string")
    K.write_separated(df, str(tmp_path / "train"))
    paths = {"train": str(tmp_path / "train"), "val": str(tmp_path / "val")}
    assert [tuple(r) for r in R.read_splits(spark, paths, "skip").collect()] == [("a", "train")]
    with pytest.raises(FileNotFoundError):
        R.read_splits(spark, paths)


def test_json(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"v": [1, 2.5], "w": []}))
    assert {r.key: r.value for r in R.read_json_map(spark, str(tmp_path / "m.json")).collect()} == {"v": [1.0, 2.5], "w": []}
    (tmp_path / "n.json").write_text('{"a": NaN,\n "b": {"c": 1}}')
    assert R.read_json_documents(spark, str(tmp_path / "n.json")).select("b.c").first().c == 1


def test_listing_and_arrays(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(2, 3, 2)
    raw = io.BytesIO()
    np.save(raw, a)
    with zipfile.ZipFile(tmp_path / "x.npz", "w") as z:
        z.writestr("pose.npy", raw.getvalue())
    assert [r.length > 0 for r in R.list_files(spark, str(tmp_path), "*.npz").collect()] == [True]
    assert R.read_npz(spark, str(tmp_path), "pose", most=1).first().data == a[:1].tolist()
    assert R.read_npz(spark, str(tmp_path), "none").first().data is None
    df = spark.createDataFrame([(bytearray(raw.getvalue()),), (None,)], "v binary")
    got = [r.v for r in R.decode_npy(df, {"v": "array<array<array<float>>>"}).collect()]
    assert got == [a.tolist(), None]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in (1, 2, 3):
        K.commit_version(spark.range(n), root)
    assert K.read_current(spark, root).count() == 3
    assert len(K.prune_versions(spark, root, 1)) == 2 and K.read_current(spark, root).count() == 3


def test_render_and_log(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("bb", None)], "k string, n int")
    assert K.render(df, "T") == "T\nk   n\n--  -\na   1\nbb\n"
    with pytest.raises(ValueError):
        K.render(df, most=1)
    K.append_log(df, str(tmp_path / "log"), ["k", "missing"])
    K.append_log(df, str(tmp_path / "log"), ["k", "missing"])
    assert R.read_separated(spark, str(tmp_path / "log"), sep=",").count() == 4


def test_stream_resumes(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for part in (range(3), range(3, 8)):
        spark.createDataFrame([(i,) for i in part], "i long").write.mode("append").parquet(src)
        I.run_available(I.stream_files(spark, src, "i long"), out, check)
    assert sorted(r.i for r in spark.read.parquet(out).collect()) == list(range(8))


def test_upsert_twice(spark, tmp_path):
    write = I.upsert_new(str(tmp_path / "t"), "k")
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    write(df, 0)
    write(df, 0)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]


def test_pending(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a", False), ("b", True), ("x", None)], "k string, failed boolean")
    assert sorted(r.k for r in I.pending(tasks, done, "k", F.col("failed")).collect()) == ["b", "c"]
