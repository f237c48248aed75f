"""Operators against plain loops, with nulls, ties, empty tables and odd columns."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnloom.functions.kernels import indel_ratio
from tarnloom.operators import fuzzy, graph, metrics as M, profile as P, series as S, splitting as R
from tarnloom.plans.lineage import cut


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(None, 3), (7, None), (5, 5)]
    edges += [(i, i + 1) for i in range(100, 160)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert graph.components(frame(spark, [], "a long, b long")).count() == 0
    assert graph.components(frame(spark, [(1, 1), (None, None)], "a long, b long")).count() == 0


def model_deorphan(steps):
    kept = []
    for i, s in enumerate(steps):
        if s is None:
            kept.append((i, None))
            continue
        while kept and kept[-1][1] is not None and kept[-1][1] >= s:
            kept.pop()
        kept.append((i, s))
    return [i for i, _ in kept]


def test_deorphan(spark):
    rng = random.Random(3)
    cases = [[1, 2, 3, 4, 3, 4, 5], [1, 2, None, 1], [], [5]] + [[rng.choice([None, *range(6)]) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = [(k, i, s) for k, c in enumerate(cases) for i, s in enumerate(c)]
    got = S.deorphaned(frame(spark, rows, "k int, i int, s int"), ["k"], ["i"], F.col("s")).collect()
    for k, c in enumerate(cases):
        assert sorted(r.i for r in got if r.k == k) == model_deorphan(c)


def test_moving_average(spark):
    df = frame(spark, [(i, float(i)) for i in range(1, 6)], "i int, v double").withColumn("k", F.lit(1))
    got = [r.m for r in df.withColumn("m", S.moving_average("v", ["k"], ["i"], 3)).orderBy("i").collect()]
    assert got == [1.5, 2.0, 3.0, 4.0, 4.5]


def test_gap_fill(spark):
    v = [1, None, None, 4, None, None, None, 8, None]
    df = frame(spark, [(0, i, x) for i, x in enumerate(v)] + [(1, 0, None), (1, 1, None)], "k int, i int, v int")
    got = S.filled(df, "v", ["k"], ["i"], 2).orderBy("k", "i").collect()
    assert [r.v for r in got] == [1, 1, 1, 4, None, None, None, 8, None, None, None]


def test_spike_and_smooth(spark):
    df = frame(spark, [(0, i, x) for i, x in enumerate([0.1, 0.5, 0.1])], "k int, i int, v double")
    assert [r.v for r in S.despiked(df, "v", ["k"], ["i"], 0.12).orderBy("i").collect()] == [0.1, None, 0.1]
    df = frame(spark, [(0, i, x) for i, x in enumerate([0.0, 4.0, 0.0, 0.0])], "k int, i int, v double")
    assert [r.v for r in S.smoothed(df, ["v"], ["k"], ["i"]).orderBy("i").collect()] == [0, 2, 1, 0]


def test_patience(spark):
    df = frame(spark, [(0, i, x) for i, x in enumerate([5, 4, 4, 6, 3])], "k int, i int, v int")
    got = S.patience(df, "v", ["k"], ["i"]).orderBy("i").collect()
    assert [r.waited for r in got] == [0, 0, 1, 2, 0] and [r.improved for r in got] == [True, True, False, False, True]


def expanded(pairs, members, across):
    """Pairs of rows from pairs of classes and the rows of each."""
    rows = {}
    for r in members:
        rows.setdefault(r.rid, []).append(r.pos)
    out = [(a, b) for r in pairs for a in rows[r.rid_a] for b in rows[r.rid_b]]
    if across:
        return out
    inside = [(a, b) for v in rows.values() for a in v for b in v if a < b]
    return [(min(x), max(x)) for x in out] + inside


@pytest.mark.parametrize("across", [False, True])
def test_fuzzy_against_loops(spark, across):
    rng = random.Random(7)
    base = ["".join(rng.choice("abc ") for _ in range(30)) for _ in range(8)]
    rows = []
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abcd")
        rows.append((i, "".join(t), rng.choice([None, 3, 4, 4, 5]), rng.choice(["train", "val", "test"])))
    rows.append((998, None, 4, "train"))
    p = fuzzy.prepared(frame(spark, rows, "pos long, text string, wc int, side string"), F.col("pos"), F.col("text"), F.col("wc"), F.col("side"))
    kept = [tuple(r) for r in p.select("pos", "norm", "wc", "side").collect()]
    rank, want = {"train": 0, "val": 1, "test": 2}, set()
    for a in kept:
        for b in kept:
            if a[0] == b[0] or b[2] - a[2] not in (0, 1) or indel_ratio(a[1], b[1]) < 90:
                continue
            if across and rank[a[3]] < rank[b[3]]:
                want.add((a[0], b[0]))
            if not across and a[3] == b[3]:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    classes = fuzzy.classes_of(p)
    for chunk in (2000, 3):
        pairs = fuzzy.class_pairs(classes, fuzzy.scored_texts(classes, chunk=chunk), across)
        got = expanded(pairs.collect(), fuzzy.members(p).collect(), across)
        assert len(got) == len(set(got)) and set(got) == want


def test_fuzzy_one_sided(spark):
    rows = [(1, "a b c d e f", 6, "train"), (2, "a b c d e f", 5, "val")]
    p = fuzzy.prepared(frame(spark, rows, "pos long, text string, wc int, side string"), F.col("pos"), F.col("text"), F.col("wc"), F.col("side"))
    assert fuzzy.scored_pairs(p, True).count() == 0 and fuzzy.scored_pairs(p, True, one_sided=False).count() == 1


def test_fuzzy_of_longer_texts(spark):
    """Lengths that differ, edits spread over the text, letters beyond ASCII."""
    rng = random.Random(11)
    words = ["sign", "language", "für", "deaf", "people", "hände", "watch", "the", "a", "today", "ж", "news"]
    rows = []
    for i in range(40):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
        for k in range(4):
            u = list(t)
            for _ in range(rng.randint(0, 7)):
                at = rng.randrange(len(u) + 1)
                u[at : at + rng.randint(0, 1)] = rng.choice(["", "x", " ", "ü"])
            rows.append((len(rows), "".join(u), 5, "train"))
    p = fuzzy.prepared(frame(spark, rows, "pos long, text string, wc int, side string"), F.col("pos"), F.col("text"), F.col("wc"), F.col("side"))
    kept = {r.pos: r.norm for r in p.collect()}
    want = {(a, b) for a in kept for b in kept if a < b and indel_ratio(kept[a], kept[b]) >= 90}
    classes = fuzzy.classes_of(p)
    for chunk in (2000, 3):
        got = expanded(fuzzy.class_pairs(classes, fuzzy.scored_texts(classes, chunk=chunk), False).collect(), fuzzy.members(p).collect(), False)
        assert set(got) == want and len(got) == len(want)


def test_fuzzy_tiles_at_size(spark):
    """of three million texts in blocks like the captions' each is sent a few times, and no tile is more than two strips."""
    rows = [(wc, n, 300_000 // 60) for wc in range(10, 20) for n in range(70, 130)]
    placed, grid = fuzzy.tiles(frame(spark, rows, "wc int, len int, n long"), 90.0, fuzzy.CHUNK)
    in_strip = collections.Counter()
    for r in placed.collect():
        for k in range(r.n):
            in_strip[r.wc, (r.before + k * r.weight) // fuzzy.CHUNK] += 1
    assert max(in_strip.values()) <= fuzzy.CHUNK and sum(in_strip.values()) == 3_000_000
    ends = [{(r.wc_a, r.strip_a), (r.wc_b, r.strip_b)} for r in grid.collect()]
    assert sum(in_strip[s] for e in ends for s in e) <= 10 * 3_000_000
    assert {frozenset(e) for e in ends} >= {frozenset({s}) for s in in_strip}


def test_fuzzy_bytes_sent_at_size(spark):
    """F2: what three million captions send to their tiles is at most 2.5 times the bytes of the texts."""
    rng = random.Random(3)
    names = [a + b for a in "fence rose tide sap rail elm forge hedge owl cliff".split() for b in "hill side mud grass wheel box slope fox".split()]
    texts = [f"don't train the {rng.choice(names)}s just keep the {rng.choice(names)} close to {rng.choice(names)} and {rng.choice(names)} {k}" for k in range(fuzzy.PART)]
    t = pa.table({"wc": [14] * len(texts), "strip": [0] * len(texts), "kid": pa.array(range(len(texts)), pa.int64()), "mask": [1] * len(texts), "norm": texts})
    packed = fuzzy._packed(t)["held"][0].as_py()
    assert sorted(pa.ipc.open_stream(packed).read_all()["norm"].to_pylist()) == sorted(texts)
    of_a_text = len(packed) / sum(map(len, texts))
    rows = [(wc, n, 300_000 // 60) for wc in range(10, 20) for n in range(70, 130)]
    placed, grid = fuzzy.tiles(frame(spark, rows, "wc int, len int, n long"), 90.0, fuzzy.CHUNK)
    texts_in = collections.Counter()
    for r in placed.collect():
        for k in range(r.n):
            texts_in[r.wc, (r.before + k * r.weight) // fuzzy.CHUNK] += 1
    tiles = grid.orderBy("tile").collect()
    assert [r.tile for r in tiles] == list(range(len(tiles)))
    sent = sum(texts_in[s] for r in tiles for s in {(r.wc_a, r.strip_a), (r.wc_b, r.strip_b)})
    assert sent * of_a_text <= 2.5 * 3_000_000, (sent, of_a_text)


def test_fuzzy_strips_without_texts(spark):
    """a tile of which one strip got no text compares nothing, not the other strip with itself as texts of different word counts."""
    rows = [(i, "watch the deaf people sign today" + "abcdefgh"[i % 8], 6 + i % 2, "train" if i % 3 else "val") for i in range(48)]
    p = fuzzy.prepared(frame(spark, rows, "pos long, text string, wc int, side string"), F.col("pos"), F.col("text"), F.col("wc"), F.col("side"))
    classes = cut(fuzzy.classes_of(p), "classes")
    want = sorted(map(tuple, fuzzy.scored_texts(classes).collect()))
    assert len(want) == len(set(want)) and sorted(map(tuple, fuzzy.scored_texts(classes, chunk=2).collect())) == want


def test_fuzzy_sides_asked_for(spark):
    """Comparing only what one mode asks for gives the pairs of comparing all."""
    rng, rows = random.Random(5), []
    for i in range(150):
        t = list("watch the deaf people sign today")
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice("abc")
        rows.append((i, "".join(t), rng.choice([6, 6, 7]), rng.choice(["train", "train", "val", "test"])))
    rows += [(200 + k, "the same for all of them", 6 + k % 2, s) for k, s in enumerate(["train", "val", "test", "test"])]
    p = fuzzy.prepared(frame(spark, rows, "pos long, text string, wc int, side string"), F.col("pos"), F.col("text"), F.col("wc"), F.col("side"))
    classes = cut(fuzzy.classes_of(p), "classes")
    every = cut(fuzzy.scored_texts(classes), "every")
    for across, one_sided in ((False, True), (True, True), (True, False)):
        want = sorted(map(tuple, fuzzy.class_pairs(classes, every, across, one_sided).collect()))
        assert want and sorted(map(tuple, fuzzy.scored_pairs(p, across, one_sided=one_sided).collect())) == want


def test_fuzzy_removals_group_once(spark, monkeypatch):
    """rows are grouped to classes once, not again for their members."""
    rows = [(1, "a b c", 3, "train"), (2, "a b c", 3, "train"), (3, "a b c", 3, "val")]
    p = fuzzy.prepared(frame(spark, rows, "pos long, text string, wc int, side string"), F.col("pos"), F.col("text"), F.col("wc"), F.col("side"))
    asked, classes_of = [], fuzzy.classes_of
    monkeypatch.setattr(fuzzy, "classes_of", lambda rows: asked.append(rows) or classes_of(rows))
    assert sorted(map(tuple, fuzzy.removals(p).collect())) == [(2, "within"), (3, "across")] and len(asked) == 1


def test_fuzzy_removals(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text, 10, "train"), (5, text, 10, "train"), (4, text + "s", 11, "train"), (1, text + "s", 10, "val"), (2, text + "s", 10, "val"),
            (6, text, 9, "test"), (7, "quite another", 10, "test"), (8, text, 10, None), (9, text + "s", 12, "test")]
    p = fuzzy.prepared(frame(spark, rows, "pos long, text string, wc int, side string"), F.col("pos"), F.col("text"), F.col("wc"), F.col("side"))
    assert sorted(tuple(r) for r in fuzzy.removals(p).collect()) == [(1, "across"), (2, "within"), (4, "within"), (5, "within"), (6, "across")]
    assert fuzzy.removals(p.limit(0)).count() == 0


def test_stratified(spark):
    rows = [(i, "a") for i in range(30)] + [(100 + i, "b") for i in range(50)] + [(200, None)]
    out = R.stratified(frame(spark, rows, "pos long, source string"), "pos", F.col("source"), per_block=13)
    n = {(r.source, r.new_split): r["count"] for r in out.groupBy("source", "new_split").count().collect()}
    assert n == {("a", "train"): 26, ("a", "val"): 2, ("a", "test"): 2, ("b", "train"): 46, ("b", "val"): 2, ("b", "test"): 2, (None, "train"): 1}


@pytest.mark.parametrize("per_block", [1000, 3])
def test_running_sum(spark, per_block):
    rows = [(i, ["a", "b", None][i % 3 % 2 if i < 30 else 2], float(i * 7 % 5)) for i in range(40)]
    df = frame(spark, rows, "pos long, k string, d double")
    want, at = {}, {}
    for p, k, d in sorted(rows, key=lambda r: (r[2], r[0])):
        at[k] = at.get(k, 0) + d
        want[p] = at[k]
    assert {r.pos: r.s for r in R.running_sum(df, ["k"], ["d", "pos"], "d", "s", per_block).collect()} == want


def test_ranked_and_batches(spark):
    rows = [(i, float(i * 7 % 13)) for i in range(40)]
    df = frame(spark, rows, "pos long, d double")
    want = {p: k for k, (p, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.pos: r["rank"] for r in R.ranked(df, ["d", "pos"], per_block=7).collect()} == want
    assert {r.pos: r.batch for r in R.batches(df, ["d", "pos"], 6).collect()} == {p: k // 6 for p, k in want.items()}
    assert R.ranked(df.limit(0), ["d"]).count() == 0


def test_histogram_edges(spark):
    df = frame(spark, [(0.0,), (1.0,), (9.9,), (10.0,), (None,), (float("nan"),)], "x double")
    assert {r.bin: r.n for r in P.histogram(df, "x", 10).collect()} == {0: 1, 1: 1, 9: 2}
    assert {r.bin: r.n for r in P.histogram(df.where("x = 1"), "x", 4).collect()} == {0: 1}


def test_top_k_ties(spark):
    df = frame(spark, [(i, x) for i, x in enumerate("baabc")] + [(9, None)], "pos long, k string")
    assert [(r.k, r.n) for r in P.top_k(df, "k", "pos", 3).collect()] == [("b", 2), ("a", 2), ("c", 1)]


def pairs(spark, rows):
    return frame(spark, [("s", r, h) for r, h in rows], "source string, reference string, hypothesis string")


def test_wer_rouge_distinct(spark):
    g = pairs(spark, [("a b c", "a x c d")])
    assert M.wer(g, ["source"]).first().wer == 66.6667
    assert M.rouge_l(pairs(spark, [("a b c d", "a c e")]), ["source"]).first().rouge_l == 57.1429
    assert M.rouge_l(pairs(spark, [("", "a"), ("a", "a")]), ["source"]).first().rouge_l == 50
    d = M.distinct_n(pairs(spark, [("", "a b a b"), ("", "a")]), 2).first()
    assert (d.unique_grams, d.grams) == (2, 3)


def test_bleu_chrf(spark):
    same = pairs(spark, [("the cat sat on the mat.", "the cat sat on the mat."), ("a b c d e", "a b c d e")])
    assert M.bleu(same, ["source"]).first().bleu == 100 and M.chrf(same, ["source"]).first().chrf == 100
    none = pairs(spark, [("a b c", "x y z"), ("a", "")])
    assert M.bleu(none, ["source"]).first().bleu == 0 and M.chrf(none, ["source"]).first().chrf == 0
    # 3 of 4 words, 1 of 3 pairs, 0 of 2 triples, 0 of 1: smoothed with 1/2 and 1/4
    part = pairs(spark, [("a b c d", "a b x d")])
    want = 100 * (3 / 4 * 1 / 3 * 1 / 4 * 1 / 4) ** 0.25
    assert abs(M.bleu(part, ["source"]).first().bleu - want) < 1e-3
    assert M.bleu(part, ["source"], smoothed=False).first().bleu == 0


def test_upper_median(spark):
    g = pairs(spark, [("a", "a"), ("a", "a b"), ("a", "a b c"), ("a", "a b c d")])
    assert M.length_stats(g, ["source"]).first().median_hyp == 3
