"""Table schemas (names and types are fixed values) and casting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MANIFEST = "vid string, text string, duration_sec double, word_count int, file_path string, source string"
RAW_MANIFEST = "vid string, text string, start string, end string, duration_sec string, word_count string, file_path string, source string"
BBOX = (
    "vid string, file_path string, source string, x1 int, y1 int, x2 int, y2 int, frame_width int, frame_height int, "
    "detection_rate double, num_sampled_frames int, num_detected_frames int, failed boolean, error string"
)
PROBE = (
    "struct<format: struct<duration: string, bit_rate: string>, streams: array<struct<codec_type: string, codec_name: string, "
    "width: int, height: int, duration: string, avg_frame_rate: string, r_frame_rate: string, sample_rate: string, channels: int>>>"
)


def fields(ddl: str) -> dict[str, str]:
    return dict(x.strip().split(" ", 1) for x in ddl.split(","))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself; an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def typed(df: DataFrame, ddl: str) -> DataFrame:
    """All-string columns cast to a schema; what cannot be cast is null.  Whole
    numbers may be written with a fraction.  Other columns stay as they are."""
    want = fields(ddl)
    require(df, list(want))

    def cast(c: str):
        if want[c] == "int":
            return F.col(c).try_cast("double").try_cast("int").alias(c)
        return F.col(c).try_cast(want[c]).alias(c)

    return df.select(*[cast(c) if c in want else F.col(c) for c in df.columns])
