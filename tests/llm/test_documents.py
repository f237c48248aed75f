"""Problems 8, 9 and 10: token ids, leaked passages, shared spans."""

import base64
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from tarnloom.llm import leaks, spans, tokens

from .data import pairs

P = pytest.importorskip("public_tokenizers")
PATH = tokens.default_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


ODD = ["", " ", "\n\n \t x", "<|endoftext|> is text", "don't we'll I'M", "aaaa" * 50, "x" * 300, "😀👍🏽 é́ ﬁ", "\x00\x01", "Привет мир 123456", "日本語のテキスト", "  two  spaces  ", "a b c"]


def test_ids(library):
    for t in ODD:
        assert tokens.encode_text(t, PATH) == library(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, t):
    assert tokens.encode_text(t, PATH) == library(t)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcdeinorst"), min_size=1, max_size=40), st.text(st.sampled_from("abeinorst"), max_size=6), st.data())
def test_appends_and_edits(t, more, data):
    enc = tokens._loaded(PATH)[0]
    d = tokens.Draft(enc, t.encode())
    d.append(more.encode())
    assert d.tokens() == enc.tokens((t + more).encode())
    i = data.draw(st.integers(0, len(d.data)))
    j = data.draw(st.integers(i, len(d.data)))
    d.replace(i, j, b"xy")
    assert d.tokens() == enc.tokens(d.data)


def test_rank_file():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ODD:
        assert tokens.encode_text(t, path) == other.encode_ordinary(t)


def test_small_memory(monkeypatch, library):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    t = "unhappiness saucercopper lemonstars trailrobes " * 5
    assert tokens.encode_text(t, PATH) == library(t)


def test_encode_rows(spark, library):
    df = spark.createDataFrame([(1, "hello world", "z"), (2, None, "z"), (3, "", "z"), (None, "x", "z")], "doc_id long, text string, ids string")
    assert {r.doc_id: r.ids for r in tokens.encode(df).collect()} == {1: library("hello world"), 2: [], 3: [], None: library("x")}
    assert tokens.encode(df.limit(0)).count() == 0


# -- leaks


def plain(t):
    return re.findall(r"[^\W_]+", t.lower())


def corpus():
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 25)))) for i in range(40)]
    items += [(100, items[0][1].upper() + "!"), (101, None), (102, ""), (103, "only three words")]
    docs = []
    for d in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            src = items[rng.randrange(40)][1].split(" ")
            a = rng.randrange(len(src))
            at = rng.randrange(len(w) + 1)
            w[at:at] = src[a : a + rng.randint(5, 15)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w).title()))
    return docs + [(900, None), (901, ""), (902, "..."), (903, "word1 " * 30_000)], items


def test_leaks(spark, monkeypatch):
    docs, items = corpus()
    want = set()
    for i, t in items:
        w = plain(t or "")
        grams = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
        for d, x in docs:
            y = plain(x or "")
            if any(tuple(y[k : k + 10]) in grams for k in range(len(y) - 9)):
                want.add((d, i))
    D = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS d", "2 AS i", "3 AS words")
    E = spark.createDataFrame(items, "item_id long, text string")
    assert want and pairs(leaks.find_leaks(D, E), "doc_id", "item_id") == want
    monkeypatch.setattr(leaks, "BITS", 1 << 9)  # lets nearly all pass
    assert pairs(leaks.find_leaks(D, E), "doc_id", "item_id") == want
    assert leaks.leaked_items(D, E).count() == len({i for _, i in want})
    assert leaks.find_leaks(D.limit(0), E).count() == 0 and leaks.find_leaks(D, E.limit(0)).count() == 0


def test_leak_with_edits(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    docs = [(1, "x " + item.replace("echo", "ecko") + " y"), (2, item.replace("echo foxtrot golf", "one")), (3, item)]
    D, E = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert pairs(leaks.find_leaks(D, E, 10, 0), "doc_id") == {(3,)}
    assert pairs(leaks.find_leaks(D, E, 10, 1), "doc_id") == {(1,), (3,)}


# -- spans


def long_documents():
    rng = random.Random(6)
    line = lambda n: "".join(rng.choice("abcdefgh ijklmnopé") for _ in range(n))
    parts = [line(n) for n in (150, 199, 200, 201, 260, 500)]
    docs = []
    for d in range(60):
        t = line(rng.randint(0, 400))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(parts)
            a = rng.choice([0, 0, rng.randint(0, 20)])
            t += p[a:] + line(rng.randint(0, 300))
        docs.append((d, t))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "z" * 1000), (103, "z" * 700), (104, None), (105, ""), (106, parts[2]), (107, parts[1]), (108, parts[5] * 2)]
    return docs


def span_truth(docs):
    held = {}
    for d, t in docs:
        for k in range(len(t or "") - 199):
            held.setdefault(t[k : k + 200], set()).add(d)
    many = {s: v for s, v in held.items() if len(v) > 1}
    found = {(a, b) for v in many.values() for a in v for b in v if a < b}
    cover = {}
    for d, t in docs:
        got = set()
        for k in range(len(t or "") - 199):
            if t[k : k + 200] in many:
                got.update(range(k, k + 200))
        if got:
            cover[d] = len(got)
    return found, cover


@pytest.mark.parametrize("block,shard", [(500, 1000), (2, 3)])
def test_spans(spark, monkeypatch, block, shard):
    monkeypatch.setattr(spans, "BLOCK", block)
    monkeypatch.setattr(spans, "SHARD", shard)
    docs = long_documents()
    found, cover = span_truth(docs)
    D = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS h", "3 AS lo", "4 AS win")
    assert pairs(spans.shared_pairs(D), "doc_a", "doc_b") == found
    assert {r.doc_id: r.shared_chars for r in spans.coverage(D).collect()} == cover
    assert spans.shared_pairs(D.limit(0)).count() == 0 and spans.coverage(D.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), min_size=6, max_size=14), min_size=1, max_size=5), st.text(st.sampled_from("abc"), min_size=6, max_size=14))
def test_fm_index(texts, query):
    fm = spans.FMIndex(texts)
    got = {(end, w, at) for _, end, w, at in fm.matches([(query, 5)], 5, 0)}
    want = {(e, w, i) for e in range(5, len(query) + 1) for w, t in enumerate(texts) for i in range(len(t) - 4) if t[i : i + 5] == query[e - 5 : e]}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abcd"), min_size=200, max_size=260), st.text(st.sampled_from("abcd"), max_size=60), st.text(st.sampled_from("abcd"), max_size=60))
def test_anchor_in_every_shared_span(t, left, right):
    a, b = spans.anchors(t), spans.anchors(left + t + right)
    inside = {h for h, p in zip(*b) if len(left) <= p and p + spans.K <= len(left) + len(t)}
    assert set(a[0]) & inside
