"""Problems 2, 4, 5 and 6: copies, near-duplicates, overlap, look-alikes."""

import random
import re
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tarnloom.llm import copies, lookalikes, near, norm, overlap

from .data import manifest, pairs, vid

TABLE = {ord(k): v for k, v in norm._SINGLE.items()} | {c: None for c in norm.INVISIBLE}


def display(t):
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).translate(TABLE))


def words(t):
    return re.findall(r"[^\W_]+", re.sub("['’]", "", display(t).lower()))


def squeeze(t):
    return "".join(re.findall(r"[^\W_]+", t))


def content(t):
    low = display(t).lower()
    parts = [p for p in re.split("[|;]", low) if squeeze(p)]
    halves = [p.split(":", 1) for p in parts]
    if re.search("[|;]", low) and len(parts) > 1 and all(len(h) == 2 and squeeze(h[0]) and squeeze(h[1]) for h in halves):
        return "|".join(sorted(f"{squeeze(a)}:{squeeze(b)}" for a, b in halves))
    return squeeze(low)


def similar(a, b):
    u, v = Counter(words(a)), Counter(words(b))
    return 5 * (u & v).total() >= 2 * (u.total() + v.total())


def captions():
    """Texts with every kind of variation, copies, edits, nulls and oddities."""
    rng = random.Random(11)
    vocab = [f"w{i}{c}" for i in range(60) for c in "abc"]
    base = [" ".join(rng.choice(vocab[:40] if k % 3 else vocab) for _ in range(rng.randint(6, 16))) for k in range(60)]
    base += ["the same the same the same", "Lesson: 7 | Topic: red door | Signer: Ann Bell", "Zuerst prüft soap das Gerät und café"]
    out = []
    for t in base:
        for _ in range(rng.randint(1, 5)):
            w = t.split(" ")
            for _ in range(rng.randint(0, 2)):
                k, i = rng.randint(0, 3), rng.randrange(len(w))
                if k == 0:
                    w[i] = rng.choice(vocab)
                elif k == 1 and len(w) > 6:
                    w.pop(i)
                elif k == 2:
                    w.insert(i, rng.choice(vocab))
                else:
                    rng.shuffle(w)
            v = " ".join(w)
            v = rng.choice([str, str.upper, str.title, lambda x: x.replace(" ", "  ") + "!", lambda x: x.replace("a", "а"), lambda x: x[:3] + "​" + x[3:], lambda x: unicodedata.normalize("NFD", x), lambda x: "".join(chr(ord(c) + 0xFEE0) if c.isalpha() and c < "\x7f" else c for c in x)])(v)
            out.append(v)
    out += ["Signer: Ann Bell; Lesson: 7; Topic: red door", "TOPIC:RED DOOR|LESSON:7|SIGNER:ANN BELL", "Lesson: red door | Topic: 7 | Signer: Ann Bell"]
    out += [None, "", " ", "nan", "Yes.", "too few words here", "..., !!! ???", "x " * 400, "x " * 399 + "y"]
    out += ["one two three four five six"] * 40  # many exact copies
    return list(enumerate(out, 1))


@pytest.fixture(scope="module")
def table():
    rows = captions()
    return rows, [(p, t) for p, t in rows if t is not None and len(words(t)) >= 6]


def test_display_words_content(spark, table):
    df = spark.createDataFrame(table[0], "pos long, text string").withColumn("shown", norm.display(F.col("text")))
    got = df.select("text", "shown", norm.words_of(F.col("shown")).alias("w"), norm.content_key(F.col("shown")).alias("k"), norm.spelled(F.col("shown")).alias("s"))
    got = got.select("*", norm.key_spelled(F.col("s")).alias("k2"), F.array_sort(norm.words_spelled(F.col("s"))).alias("w2")).collect()
    for r in got:
        if r.text is None:
            assert r.shown is None and r.k is None
        else:
            assert (r.shown, r.w, r.k) == (display(r.text), words(r.text), content(r.text)) and r.k2 == r.k
            assert [w for w in r.w2 if w] == sorted(r.w)


def test_display_cases(spark):
    cases = {"Ｈｉ！": "Hi!", "café": "café", "a​b­c﻿": "abc", "a b c": "a b c", "ѕһаԁе": "shade", "“q” – é": "“q” – é", "½ 20°C": "½ 20°C", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in df.select("t", norm.display(F.col("t")).alias("d")).collect()} == cases


@pytest.mark.parametrize("limit", [100_000, 5, 1])
def test_radix_count(spark, table, limit):
    keys = [(content(t).encode(), p) for p, t in table[1]] + [(None, 9999), (b"", 5000), (b"", 5001)]
    df = spark.createDataFrame(keys, "key binary, pos long").repartition(5)
    got = {bytes(r.key): (r.first_pos, r.n) for r in copies.radix_count(df, limit).collect()}
    want = {}
    for k, p in keys:
        if k is not None:
            a, n = want.get(k, (p, 0))
            want[k] = (min(a, p), n + 1)
    empty = got.pop(b"", None) or got.pop(b"\0")
    assert empty == want.pop(b"") and got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).filter(lambda b: b"\0" not in b), max_size=40))
def test_trie(keys):
    t = copies.Trie()
    for i, k in enumerate(keys):
        t.add(k, 1, -i)
    got = {k: tuple(s) for k, s in zip(t.keys, t.slots)}
    assert got == {k: (n, -max(i for i, x in enumerate(keys) if x == k)) for k, n in Counter(keys).items()}


def test_copy_pairs(spark, table):
    rows, kept = table
    first, want = {}, set()
    for p, t in kept:
        f = first.setdefault(content(t), p)
        if f != p:
            want.add((f, p))
    m = manifest(spark, rows, extra=True)
    assert pairs(copies.copy_pairs(m), "first_pos", "copy_pos") == want
    got = {r.first_pos: (r.n, r.text) for r in copies.collapse(m).collect()}
    n = Counter(content(t) for _, t in kept)
    assert got == {p: (n[k], dict(kept)[p]) for k, p in first.items()}


def near_want(kept):
    return {(p, q) for i, (p, a) in enumerate(kept) for q, b in kept[i + 1 :] if similar(a, b) and content(a) != content(b)}


@pytest.mark.parametrize("rare", [24, 1, 10**6, 2])
def test_near_pairs(spark, table, monkeypatch, rare):
    monkeypatch.setattr(near, "RARE", rare)
    rows, kept = table
    assert pairs(near.near_pairs(manifest(spark, rows, extra=True)), "pos_a", "pos_b") == near_want(kept)


def test_near_groups(spark, table):
    rows, kept = table
    links = near_want(kept)
    parent = {p: p for p, _ in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    spelled = {}
    for p, t in kept:
        spelled.setdefault(content(t) + "\n" + " ".join(sorted(words(t))), p)
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.pos: r for r in near.near_groups(manifest(spark, rows)).collect()}
    assert set(got) == {p for p, _ in kept}
    for a, b in links:
        assert got[a].group_pos == got[b].group_pos and got[a].links > 0 and got[b].links > 0


def test_look_alike_pairs(spark, table):
    rows, kept = table
    want = {(p, q) for i, (p, a) in enumerate(kept) for q, b in kept[i + 1 :] if a != b and display(a) == display(b)}
    m = manifest(spark, rows, extra=True)
    assert pairs(lookalikes.look_alike_pairs(m), "pos_a", "pos_b") == want
    got = {r.pos: r.form for r in lookalikes.unify(m.select("pos", "text"), out="form").collect()}
    assert len(got) == len(rows)
    for p, t in rows:
        assert got[p] == (None if t is None else display(t))


def test_overlap(spark, table):
    rows = [(p, t, vid(p), ["train", "val", " Test", None, "odd"][p % 5], ["openasl", None][p % 2]) for p, t in table[0]]
    jobs = spark.createDataFrame([(f" {vid(p)}", "dev") for p, *_ in rows if p % 3 == 0] + [(None, "train")], "vid string, split string")
    side = {}
    for p, _, _, s, _ in rows:
        s = {"train": "train", "val": "val", " Test": "test"}.get(s) or ("val" if p % 3 == 0 else None)
        if s:
            side[p] = s
    kept = [(p, t) for p, t in table[1] if p in side]
    want = {(p, q) for i, (p, a) in enumerate(kept) for q, b in kept[i + 1 :] if (side[p] == "train") != (side[q] == "train") and (similar(a, b) or content(a) == content(b))}
    m = manifest(spark, rows)
    assert pairs(overlap.overlap_pairs(m, jobs), "pos_a", "pos_b") == want
    counts = overlap.overlap_counts(m, jobs).collect()
    assert sum(r.same_pairs + r.near_pairs for r in counts) == len(want)


@pytest.mark.parametrize("op", [copies.copy_pairs, copies.collapse, near.near_pairs, near.near_groups, lookalikes.look_alike_pairs])
def test_empty_tables(spark, op):
    assert op(manifest(spark, [])).count() == 0
    assert op(manifest(spark, [(1, None), (2, ""), (None, "a b c d e f g")])).count() == 0
