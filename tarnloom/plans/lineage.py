"""Cutting lineage with written tables, and small session helpers.

Iterative operators must not replay every earlier round when an executor is
lost.  ``cut`` writes a DataFrame as Parquet below the folder that the cluster
names in ``spark.checkpoint.dir`` (shared by all executors) and reads it back,
so later stages start from files and the planner knows their size.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset on one machine (tests, a
    laptop), a fresh temporary folder, which is then set for the session.  On a
    cluster that is an error: other executors could not read it."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="tarnloom-")
        spark.conf.set("spark.checkpoint.dir", conf)
        _made.append((spark, conf))
    return conf.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/tarnloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame | None) -> None:
    """Delete the table behind a DataFrame made by ``cut``; nothing that still
    reads it may run afterwards."""
    path = getattr(df, "_tarnloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def cut(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.  The
    folder of the written table is removed when the driver's process ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnloom_path = path
    return out


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
