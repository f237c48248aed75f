"""Scans."""

from __future__ import annotations

import ast
import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnloom.sources.schema import PROBE, typed


def read_separated(spark: SparkSession, path: str | list[str], sep: str = "\t", ddl: str | None = None, multi_line: bool = False) -> DataFrame:
    """A separated file with a header, all columns as strings, doubled quotes
    allowed; names are stripped.  ``multi_line``: line breaks in quotes are allowed
    too, for which a file is read by one task.  Only empty fields are null.
    ``ddl``: cast to it, null where that fails, and an error for a missing column."""
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=multi_line, inferSchema=False, enforceSchema=False)
    df = df.toDF(*[c.strip() for c in df.columns])
    return typed(df, ddl) if ddl else df


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_splits(spark: SparkSession, paths: dict[str, str], on_missing: str = "error", **options) -> DataFrame:
    """One table from a file per split, with a ``split`` column.  ``on_missing``:
    ``skip`` or ``error``; an error if no file is left."""
    out = None
    for split, path in paths.items():
        if not _exists(spark, path):
            if on_missing == "skip":
                continue
            raise FileNotFoundError(path)
        part = read_separated(spark, path, **options).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(", ".join(paths.values()))
    return out


def with_positions(df: DataFrame) -> DataFrame:
    """``pos``: rising in file order; neither dense nor, without a single ordered
    file, a global order."""
    return df.withColumn("pos", F.monotonically_increasing_id())


def read_json_map(spark: SparkSession, path: str, value: str = "array<double>") -> DataFrame:
    """``(key, value)`` rows of files that hold one JSON object each."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents over several lines; bare NaN is allowed, missing keys are null."""
    return spark.read.option("multiLine", True).option("allowNonNumericNumbers", True).json(path)


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``(path, length, modified)`` without reading any content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def parse_probe(df: DataFrame, column: str = "probe") -> DataFrame:
    """``df`` with the fields of a media probe's JSON: duration, bit rate in kbit/s,
    and those of the first video and the first audio stream; null where absent."""
    from tarnloom.functions.scalars import rational

    p = df.withColumn("_p", F.from_json(F.col(column), PROBE))
    first = lambda kind: F.get(F.filter("_p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    p = p.withColumn("_v", first("video")).withColumn("_a", first("audio"))
    return p.withColumns({
        "duration": F.col("_p.format.duration").try_cast("double"), "kbit_rate": F.col("_p.format.bit_rate").try_cast("double") / 1000,
        "width": F.col("_v.width"), "height": F.col("_v.height"), "codec": F.col("_v.codec_name"),
        "fps": F.coalesce(rational(F.col("_v.avg_frame_rate")), rational(F.col("_v.r_frame_rate"))),
        "sample_rate": F.col("_a.sample_rate").try_cast("int"), "channels": F.col("_a.channels"),
    }).drop("_p", "_v", "_a")


def parse_npy(raw: bytes) -> list:
    """A nested list from the bytes of an npy file of numbers in C order."""
    import numpy as np

    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    size, at = (struct.unpack("<H", raw[8:10])[0], 10) if raw[6] == 1 else (struct.unpack("<I", raw[8:12])[0], 12)
    head = ast.literal_eval(raw[at : at + size].decode("latin1"))
    a = np.frombuffer(raw[at + size :], np.dtype(head["descr"])).reshape(head["shape"], order="F" if head["fortran_order"] else "C")
    return a.tolist()


def decode_npy(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of npy bytes as native arrays; ``columns`` maps each to its type,
    such as ``array<array<array<float>>>``.  Null stays null."""

    def decoder(kind: str):
        @F.pandas_udf(kind)
        def decode(s: pd.Series) -> pd.Series:
            return s.map(lambda raw: None if raw is None else parse_npy(bytes(raw)))

        return decode

    return df.withColumns({c: decoder(kind)(F.col(c)) for c, kind in columns.items()})


def read_npz(spark: SparkSession, path: str, name: str, kind: str = "array<array<array<float>>>", most: int | None = None) -> DataFrame:
    """``(path, data)``: one named array of each npz archive, cut to ``most`` first
    entries; null where the archive lacks it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for raw in b["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    data.append(parse_npy(z.read(f"{name}.npy"))[:most] if f"{name}.npy" in z.namelist() else None)
            yield pd.DataFrame({"path": b["path"], "data": data})

    return files.select("path", "content").mapInPandas(load, f"path string, data {kind}")
