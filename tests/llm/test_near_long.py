"""Problem 4: one index rule for records of any length; classes of many rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnloom.llm import near


def similar(a, b):
    x, y = Counter(a), Counter(b)
    return 5 * sum((x & y).values()) >= 2 * (len(a) + len(b))


@pytest.mark.parametrize("sizes", [(6, 30), (20, 60), (150, 400)])
def test_index_of_any_length(sizes):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words[: rng.choice([8, 60])]) for _ in range(rng.randint(*sizes))] for _ in range(12)]
    docs = []
    for i in range(90):
        d = list(base[i % 12])
        for _ in range(rng.randint(0, max(1, len(d) // 3))):
            at = rng.randrange(len(d) + 1)
            d[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        docs.append(d if len(d) >= 6 else d + words[:6])
    number = {w: rng.getrandbits(62) for w in words}
    hashes = pa.array([[number[w] for w in d] for d in docs], pa.list_(pa.int64()))
    _, pos, _ = near._positional(hashes)
    freq = np.bincount(pos, minlength=near.POSITIONS)
    key, rid, *_ = near._index_rows(np.arange(len(docs)), np.zeros(len(docs), int), hashes, freq)
    held = {}
    for k, r in zip(key.tolist(), rid.tolist()):
        held.setdefault(k, set()).add(r)
    met = {(a, b) for v in held.values() for a in v for b in v if a < b}
    want = {(a, b) for a in range(len(docs)) for b in range(a) if similar(docs[a], docs[b])}
    assert len(want) > 20 and {(min(x), max(x)) for x in want} <= met
    assert len(key) <= 4 * sum(map(len, docs))  # postings grow with the words, not with their square


def test_expanded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 3)
    pairs = spark.createDataFrame([(1, 2, "x"), (2, 3, "y")], "a long, b long, how string")
    rows = {1: [10, 11, 12, 13, 14, 15, 16], 2: [20], 3: [30, 31, 32, 33]}
    df = spark.createDataFrame([(r, v) for r, vs in rows.items() for v in vs], "rid long, p long")
    got = [tuple(r) for r in near.expanded(pairs, df, df.withColumnRenamed("p", "q"), "how").collect()]
    assert sorted(got) == sorted([(p, 20, "x") for p in rows[1]] + [(20, q, "y") for q in rows[3]])
