"""Runs a query and its SQL twin on the same files and compares the rows."""

import math
import os

import duckdb


def cell(x):
    if x is None or str(x) in ("<NA>", "NaT") or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    return str(x)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(cell, r)) for r in frame[cols].values.tolist())


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    got, want = rows(query(spark, sf_dir).toPandas()), rows(con.execute(sql).fetch_df())
    assert got[0] == want[0]
    assert got[1] == want[1]
