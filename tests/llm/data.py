"""Small hand-made tables for the training-data operators."""

MANIFEST = "pos long, vid string, text string, duration_sec double, word_count int, file_path string, source string, split string"


def manifest(spark, rows, extra=False):
    """Rows of (pos, text) or (pos, text, vid, split, source)."""
    full = [(p, v, t, 2.0, 6, None, src, s) for p, t, v, s, src in ((*r, *(None,) * (5 - len(r))) for r in rows)]
    df = spark.createDataFrame(full, MANIFEST)
    if extra:  # columns whose names clash with those the operators use inside
        for c in ("key", "bag", "spelled", "ckey", "shown", "words", "rid", "side", "a", "b", "h", "n", "canonical", "restored", "first_pos"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def vid(i):
    return f"rec{i:08d}_1-{i}-rgb_front"


def pairs(df, *cols):
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)
