"""Problems 1 and 7: components, dealing to splits, groups of pairs."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tarnloom.llm import groups, splits

from .data import manifest, pairs, vid


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def shapes():
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)]
    edges += [(i, i + 1) for i in range(200, 280)]  # a long chain
    edges += [(300, i) for i in range(301, 380)]  # a hub
    edges += [(i, i // 2) for i in range(402, 460)]  # a tree
    return [(a, b) for a, b in edges if a != b]


def test_group_pairs(spark):
    edges = shapes()
    dirty = edges + [(b, a) for a, b in edges[:20]] + [(5, 5), (None, 3), (4, None)]
    df = spark.createDataFrame([(f"{a:04d}" if a is not None else None, f"{b:04d}" if b is not None else None) for a, b in dirty], "x string, y string")
    got = {r.id: r.group_id for r in groups.group_pairs(df, "x", "y").collect()}
    assert got == {f"{a:04d}": f"{b:04d}" for a, b in union_find(edges).items()}


def test_group_nothing(spark):
    assert groups.group_pairs(spark.createDataFrame([], "x string, y string"), "x", "y").count() == 0


def test_clip_links(spark):
    m = manifest(spark, [(i, "t", vid(i)) for i in range(5)])
    p = spark.createDataFrame(
        [(vid(0), f" {vid(1)}.mp4", 90.0), (vid(1), vid(2), 89.9), (vid(2), vid(99), 99.0), (vid(3), vid(3), 99.0), (vid(3), vid(4), None), (None, vid(4), 99.0), (vid(3), vid(4), float("nan"))],
        "vid_a string, vid_b string, score double",
    )
    got = groups.group_pairs(groups.clip_links(p, m), "vid_a", "vid_b", "group_vid", "vid")
    assert pairs(got, "group_vid", "vid") == {(vid(0), vid(0)), (vid(0), vid(1))}


def test_components_by_hooking(spark):
    edges = shapes()
    df = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in edges], "u string, v string")
    got = {r.node: r.parent for r in splits.components(df).collect()}
    assert got == {f"{a:04d}": f"{b:04d}" for a, b in union_find(edges).items()}
    assert splits.components(df.limit(0)).count() == 0


def best_total(sizes, target):
    sums = {0}
    for s, n in sizes.items():
        sums = {t + s * k for t in sums for k in range(n + 1)}
    return min((abs(t - target), t) for t in sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=5), st.integers(0, 120))
def test_closest_counts(sizes, target):
    got = splits.closest_counts(sizes, target)
    assert all(0 < k <= sizes[s] for s, k in got.items())
    total = sum(s * k for s, k in got.items())
    assert abs(total - target) == best_total(sizes, target)[0]


def test_closest_counts_of_any_window():
    rng = random.Random(5)
    for _ in range(400):
        sizes = {rng.choice([1, 2, 3, 4, 6, 7, 9, 12, 15, 30]) * rng.choice([1, 1, 5]): rng.randint(1, 4) for _ in range(rng.randint(0, 4))}
        sums, target = {0}, rng.randint(0, sum(s * m for s, m in sizes.items()) + 3)
        for s, m in sizes.items():
            sums = {t + k * s for t in sums for k in range(m + 1)}
        for window in (splits.WINDOW_ROWS, 5, 1):
            got = splits.closest_counts(sizes, target, window)
            assert all(0 < k <= sizes[s] for s, k in got.items())
            assert sum(s * k for s, k in got.items()) == min(sums, key=lambda t: (abs(t - target), t))


def test_closest_counts_of_very_large_sizes():
    assert splits.closest_counts({1_500_001: 1, 1_000_000: 3}, 3_000_000) == {1_000_000: 3}
    sizes = {2 * s + 1: 1 for s in range(1_000_000, 1_000_060)}
    total = sum(s * k for s, k in splits.closest_counts(sizes, 24_000_999).items())
    assert total == min((sum(list(sizes)[:k]) + x for k in (11, 12) for x in range(0, 2 * k * (60 - k) + 1, 2)), key=lambda t: abs(t - 24_000_999))


def test_resplit_keeps_recordings(spark):
    rng = random.Random(4)
    rows, pos = [], 0
    for rec in range(150):
        for k in range(1 if rec else 300):  # one recording holds most rows
            for _ in range(rng.randint(1, 4)):
                pos += 1
                rows.append((pos, "t", f"rec{rec:08d}_1-{k}-rgb_front", rng.choice(["train", "val", None]), rng.choice(["OpenASL ", "openasl", "how2sign"]) if rec % 7 == 0 else "openasl"))
    rows += [(pos + 1, "t", None), (pos + 2, None, "short", "odd", None)]
    m = manifest(spark, rows, extra=True)
    out = {r.pos: (r.recording, r.new_split) for r in splits.resplit(m).collect()}
    assert len(out) == len(rows) and out[pos + 1] == (None, "train")
    by = {}
    for rec, s in out.values():
        if rec:
            by.setdefault(rec, set()).add(s)
    assert all(len(s) == 1 for s in by.values())
    n = {s: sum(x == s for _, x in out.values()) for s in ("train", "val", "test")}
    assert abs(n["val"] - 0.05 * len(rows)) <= 3 and abs(n["test"] - 0.05 * len(rows)) <= 3


def test_mixed_recordings(spark):
    rows = [
        (1, "t", vid(1), "train"), (2, "t", vid(1) + ".mp4", " Val"), (3, "t", vid(2), "train"), (4, "t", vid(2), "TRAINING"),
        (5, "t", vid(3), "test"), (6, "t", vid(3), None), (7, "t", None, "val"), (8, "t", vid(4), "odd"), (9, "t", vid(4), "val"),
    ]
    assert pairs(splits.mixed_recordings(manifest(spark, rows)), "recording") == {("rec00000001",)}
    assert splits.mixed_recordings(manifest(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, "t", None)]])
def test_resplit_small(spark, rows):
    assert splits.resplit(manifest(spark, rows)).count() == len(rows)


def test_ranked_blocks(spark):
    df = spark.createDataFrame([(f"g{i % 2}", i) for i in range(101)], "g string, x long")
    got = splits._ranked(df, ["g"], "x", per_block=9)
    for g in ("g0", "g1"):
        ranks = sorted(r["rank"] for r in got.where(F.col("g") == g).collect())
        assert ranks == list(range(len(ranks)))
