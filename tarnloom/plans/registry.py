"""All queries of the core and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnloom.plans.lineage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of the named tables as a query, with its SQL twin."""

    def wrap(f):
        QUERIES[name] = lambda spark, d: f(*(table(spark, d, t) for t in tables))
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


def load() -> None:
    from tarnloom.plans import (  # noqa: F401
        aggregates, curation, filters, joins, projections, scans, streams, texts, windows,
    )


# SQL fragments that several twins share
SPLIT_SQL = (
    "CASE WHEN lower(trim(split)) IN ('train','training') THEN 'train'"
    " WHEN lower(trim(split)) IN ('val','valid','validation','dev') THEN 'val'"
    " WHEN lower(trim(split)) = 'test' THEN 'test' END"
)
SOURCE_SQL = "lower(trim(source))"
VID_SQL = (
    r"regexp_replace(regexp_replace(trim({v}), '\.mp4$', ''),"
    r" '^(.{11})-(\d\d)[.:](\d\d)[.:](\d\d\.\d{3})-(\d\d)[.:](\d\d)[.:](\d\d\.\d{3})$', '\1-\2:\3:\4-\5:\6:\7')"
)


def vid_sql(v: str = "vid") -> str:
    return VID_SQL.replace("{v}", v)


WS_SQL = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def norm_sql(c: str = "text") -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_{WS_SQL}]', '', 'g'), '[{WS_SQL}]+', ' ', 'g'))"
    )
