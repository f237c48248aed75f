"""Hand-made cases for scalar and text functions, and kernels against plain loops."""

import html
import math
import re

import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tarnloom.functions import ids, kernels as K, scalars as S, text as T


def column(spark, values, kind, *exprs):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + kind)
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_wps_edges(spark):
    got = column(spark, [(10, 2.0), (5, 0.0), (0, 0.0), (None, 2.0), (3, None)], "w int, d double", S.wps(F.col("w"), F.col("d")))
    assert got[0] == (5.0,) and got[1] == (math.inf,) and math.isnan(got[2][0]) and got[3] == (None,) and got[4] == (None,)


def test_seconds(spark):
    got = column(spark, ["00:01:38.099", "183.12", " 00:00:05 ", "x", None, "", "1:2"], "t string", F.round(S.hms_seconds(F.col("t")), 3))
    assert [g[0] for g in got] == [98.099, 183.12, 5.0, None, None, None, None]


def test_paths(spark):
    cases = [r"D:\set\a\train\f.mp4", "D:/set/a", "set/a/train/f.mp4", None]
    assert [g[0] for g in column(spark, cases, "p string", S.remapped_path(F.col("p"), "m"))] == ["m/a/a/train/f.mp4", "D:/set/a", "m/a/a/train/f.mp4", None]


def test_snap_and_indices(spark):
    lo, hi = S.snapped(F.col("a"), F.col("b"))
    assert column(spark, [(3, 100), (0, 10)], "a int, b int", lo, hi) == [(3, 99), (-11, 21)]
    assert [g[0] for g in column(spark, [0, 1, 5, 6], "n int", S.sample_indices(F.col("n"), F.lit(4)))] == [[], [0], [0, 4], [0, 4, 5]]


def test_gcd_and_rates(spark):
    assert [g[0] for g in column(spark, [(1920, 1080), (None, 2), (0, 0)], "w int, h int", S.gcd(F.col("w").cast("long"), F.col("h").cast("long")))] == [120, None, 0]
    assert [g[0] for g in column(spark, ["30000/1001", "0/0", "25", "x/1", None], "r string", S.rational(F.col("r")))] == [29.97, None, 25.0, None, None]


def test_shift_and_fit(spark):
    a = F.col("a")
    got = column(spark, [([1.0, 2.0, 3.0],), ([1.0],), ([],)], "a array<double>", S.shifted(a, 2), S.shifted(a, -1, edge=False), S.last_index(a, 3.0))
    assert got == [([1.0, 1.0, 1.0], [2.0, 3.0, 0.0], 2), ([1.0], [0.0], -1), ([], [], -1)]


def test_status_and_duration(spark):
    s = S.trim_status(F.col("f"), F.col("p"), F.col("a"))
    cases = [(False, 1.0, 1.0), (True, 1.0, None), (True, None, 1.0), (True, 3.0, 5.0), (True, 3.0, 5.1), (True, 5.1, 3.0)]
    assert [g[0] for g in column(spark, cases, "f boolean, p double, a double", s)] == ["MISSING", "FFPROBE_ERROR", "BAD_TSV_TIMING", "ALREADY_TRIMMED", "NEEDS_TRIM", "CLIP_TOO_SHORT"]
    assert [g[0] for g in column(spark, [59.9, 3600.0, 90061.0], "s double", S.spoken_duration(F.col("s")))] == ["59s", "1h 0m 0s", "1d 1h 1m 1s"]


def test_ids(spark):
    cases = [" abcdefghijk-00.01.02.003-00.01.04.005.mp4 ", "abcdefghijk_1-2-rgb_front.mp4", "short", None, ""]
    got = column(spark, cases, "v string", ids.canonical_vid(F.col("v")), ids.recording(F.col("v")))
    assert got == [("abcdefghijk-00:01:02.003-00:01:04.005", "abcdefghijk"), ("abcdefghijk_1-2-rgb_front", "abcdefghijk"), ("short", None), (None, None), ("", None)]
    assert [g[0] for g in column(spark, [" Training", "DEV", "valid", "test ", "other", None], "s string", ids.canonical_split(F.col("s")))] == ["train", "val", "val", "test", None, None]


def test_normalised(spark):
    cases = ["It's  A_b, Déjà!", "", None, "\u00a0x\u2009y "]
    assert [g[0] for g in column(spark, cases, "t string", T.normalised(F.col("t")))] == ["its a_b déjà", "", None, "x y"]


def test_fixes(spark):
    f = lambda fix, *texts: [g[0] for g in column(spark, list(texts), "t string", fix(F.col("t")))]
    assert f(T.single_punctuation, "wow!!! ok?? a..b--c") == ["wow! ok? a.b-c"]
    assert f(T.without_unpaired, "(a)(b", "a)b(", "((x))", 'say "hi', None) == ["ab", "ab", "((x))", "say hi", None]
    assert f(T.decoded_entities, "a &amp; b&rsquo;s", "plain", None) == ["a & b’s", "plain", None]
    assert f(T.unescaped_quotes, "it\\'s \\\\'x /'") == ["it's 'x '"]
    assert f(T.tidied, "  a   b\u00a0") == ["a b"]


def test_sentence_case_threshold(spark):
    low, high = "ABCDEFGHIJKLMNOPQR. x", "ABCDEFGHIJKLMNOPQRS. éx! 1Y"
    got = [g[0] for g in column(spark, [low, high], "t string", T.sentence_case(F.col("t")))]
    assert got == [low, "Abcdefghijklmnopqrs. Éx! 1Y"]


def test_fix_order(spark):
    from tarnloom.plans.texts import fix_pipeline

    m = spark.createDataFrame([(1, "It’s — ok&rsquo;s"), (2, "123"), (3, None)], "pos long, text string")
    got = [(r.pos, r.fixed, r.fired, r.modified) for r in fix_pipeline(m).collect()]
    assert got == [(1, "Its ok's", ["F1_non_ascii", "F2_entities", "F3_curly_quotes"], True)]


text = st.text(st.sampled_from("ab c."), max_size=12)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(text, text)
def test_lcs(a, b):
    assert K.lcs(a, b) == plain_lcs(a, b)
    assert 0 <= K.indel_ratio(a, b) <= 100 and K.indel_ratio(a, a) == 100


def test_edits():
    assert K.edits("abc", "axcd") == 2 and K.edits("", "ab") == 2 and K.edits([], []) == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("()[]{}\" a"), max_size=10))
def test_unpaired_model(t):
    assert _model_unpaired(t) == _model_unpaired(_model_unpaired(t))


def _model_unpaired(t):
    for a, b in ("()", "[]", "{}"):
        depth, bad = 0, False
        for c in t:
            depth += (c == a) - (c == b)
            bad |= depth < 0
        if bad or depth:
            t = t.replace(a, "").replace(b, "")
    return t.replace('"', "") if t.count('"') % 2 else t


def test_unpaired_against_model(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice('()[]{}" ab') for _ in range(rng.randint(0, 9))) for _ in range(300)]
    assert [g[0] for g in column(spark, texts, "t string", T.without_unpaired(F.col("t")))] == [_model_unpaired(t) for t in texts]


def test_unescape_is_pythons(spark):
    texts = ["&lt;b&gt;", "&#8217;", "&bogus;", "&eacute"]
    assert [g[0] for g in column(spark, texts, "t string", T.decoded_entities(F.col("t")))] == [html.unescape(t) for t in texts]


def test_checks_on_empty_and_long(spark):
    exprs = [c(F.col("t")).alias(n) for n, c in T.CHECKS]
    got = column(spark, ["", None, "x" * 100_000], "t string", *exprs)
    assert got[0][12] is True and got[1] == (None,) * 15 and got[2][13] is True
    assert re.match("15", T.CHECKS[-1][0]) and isinstance(pd.Series([1]), pd.Series)
