"""Sinks.  None writes in place: a table is written beside the old one, then named."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_separated(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = "\t", order: list[str] | None = None) -> None:
    """A separated table with a header, of fixed columns (else all that do not
    start with ``_``), sorted if an order is given."""
    df = df.select(*(columns or [c for c in df.columns if not c.startswith("_")]))
    if order:
        df = df.orderBy(*order)
    df.write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_log(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows added to a log; columns that ``df`` lacks are empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("append").csv(path, header=True)


def commit_version(df: DataFrame, root: str) -> str:
    """``df`` as a new version of a Parquet table: written apart, then named in a
    pointer file of its own.  Pointers are never replaced; the last one counts, so a
    reader sees the old or the new table whole.  Returns the version's path; old
    versions stay as backups."""
    spark = df.sparkSession
    version = f"{root.rstrip('/')}/v{time.time_ns()}"
    df.write.parquet(version)
    fs, path = _files(spark, root)
    new = path(f"{root}/.CURRENT-{version.rsplit('/', 1)[-1]}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    if not fs.rename(new, path(f"{root}/CURRENT-{version.rsplit('/', 1)[-1]}")):
        raise OSError(f"{root}: the pointer could not be named")
    return version


def _files(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, root: str) -> str:
    """The path of the version that the last pointer names."""
    fs, path = _files(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    last = max((n for n in names if n.startswith("CURRENT-v")), key=lambda n: int(n.removeprefix("CURRENT-v")), default=None)
    if last is None:
        raise FileNotFoundError(f"{root}: no version")
    return spark.read.text(f"{root}/{last}").first()[0]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(current_version(spark, root))


def prune_versions(spark: SparkSession, root: str, keep: int) -> list[str]:
    """All but the last ``keep`` versions removed, never the current one."""
    fs, path = _files(spark, root)
    current = current_version(spark, root)
    found = sorted(s.getPath().toString() for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("v"))
    gone = [p for p in found[: max(0, len(found) - keep)] if p.rsplit("/", 1)[-1] != current.rsplit("/", 1)[-1]]
    for p in gone:
        fs.delete(path(p), True)
        fs.delete(path(f"{root}/CURRENT-{p.rsplit('/', 1)[-1]}"), False)
    return gone


def write_npz(df: DataFrame, path: str, key: str, values: str, name: str, per_archive: int = 2000) -> None:
    """Arrays of numbers as npz archives below ``path``: rows of one length and a part
    of the keys' hashes go into an archive with the arrays ``key`` and ``name`` (none for
    null vectors).  Archives are written through the file system of ``path``, each
    under a name of its own that a repeated task overwrites."""
    import pyarrow as pa

    spark = df.sparkSession
    size = F.when(F.col(values).isNull(), -1).otherwise(F.size(values))
    sized = df.select(F.col(key).cast("long").alias("k"), F.col(values).cast("array<float>").alias("v"), size.alias("n"))
    parts = sized.groupBy("n").agg(F.ceil(F.count("*") / per_archive).alias("parts"))
    held = sized.join(parts, "n").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")))

    def pack(key_, t):
        import io
        import zipfile

        import numpy as np

        n, part = key_[0].as_py(), key_[1].as_py()
        arrays = {key: t["k"].to_numpy()}
        if n >= 0:
            arrays[name] = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(t.num_rows, n)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for a, x in arrays.items():
                raw = io.BytesIO()
                np.save(raw, x)
                z.writestr(f"{a}.npy", raw.getvalue())
        return pa.table({"file": [f"{n}-{part}.npz"], "content": pa.array([out.getvalue()], pa.binary())})

    packed = held.groupBy("n", "part").applyInArrow(pack, "file string, content binary")
    write_files(packed, path)


def write_files(df: DataFrame, path: str) -> None:
    """``(file, content)`` rows as files below ``path``, written by the tasks through the
    file system that the path names: with pyarrow where that is not the local one."""
    from urllib.parse import urlparse

    local = urlparse(path).scheme in ("", "file")

    def save(batches):
        import os

        from pyarrow import fs

        target, base = (fs.LocalFileSystem(), urlparse(path).path) if local else fs.FileSystem.from_uri(path)
        target.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(b["file"].to_pylist(), b["content"].to_pylist()):
                with target.open_output_stream(os.path.join(base, name)) as out:
                    out.write(content)
            yield b.select(["file"])

    df.mapInArrow(save, "file string").agg(F.count("*")).collect()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def nested_json(df: DataFrame, key: str, columns: list[str], out: str = "json") -> DataFrame:
    """``(key, out)``: the columns of each row as one JSON object."""
    return df.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(out))


def scalar_events(df: DataFrame, step: str, metrics: list[str]) -> DataFrame:
    """``(step, metric, value)`` rows of a wide table of metrics; nulls left out."""
    wide = df.select(step, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot([step], metrics, "metric", "value").where(F.col("value").isNotNull())


def render(df: DataFrame, title: str = "", most: int = 1000) -> str:
    """A small result as aligned text for a report; an error above ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cells = [df.columns, *[["" if x is None else str(x) for x in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in cells]
    return "\n".join([*([title] if title else []), lines[0], "  ".join("-" * w for w in width), *lines[1:]]) + "\n"


def render_config(values: dict) -> str:
    return "".join(f"{k} = {json.dumps(v, default=str)}\n" for k, v in sorted(values.items()))


class Tee:
    """Report text for the console and a file at once."""

    def __init__(self, path: str) -> None:
        self.file = open(path, "w", encoding="utf-8")

    def write(self, text: str) -> None:
        print(text, end="")
        self.file.write(text)

    def close(self) -> None:
        self.file.close()
