"""Problem 3: encodings outside the prior are learned by alignment with clean twins."""

import random

import pytest

from tarnloom.llm import garble

from .data import manifest

WORDS = ["café", "señor", "château", "garçon", "über", "forêt", "naïve", "répété", "mañana", "jalapeño"]
PLAIN = "the people in this video talk about sign language today with hands and faces".split()


def captions(spoilt):
    rng, rows, bad = random.Random(3), [], {}
    for i in range(440):
        words = [rng.choice(PLAIN) for _ in range(6)]
        words.insert(rng.randint(0, 6), WORDS[i % 10])
        t = " ".join(words)
        if i >= 400:
            bad[i] = (spoilt(t), t)
        rows.append((i, bad[i][0] if i >= 400 else t))
    return rows, bad


def read_as(encoding):
    return lambda t: t.encode().decode(encoding, "replace" if encoding in ("gbk", "shift_jis") else "strict")


def invented(t):
    """An encoding that does not exist: each letter becomes two signs of another script."""
    return "".join(c if ord(c) < 128 else chr(0x10A0 + ord(c) % 37) + chr(0x0531 + ord(c) % 31) for c in t)


@pytest.mark.parametrize("encoding", ["cp1256", "cp874", "gbk", "shift_jis", "iso8859_2", "cp852", "mac_cyrillic", "cp1258", "iso8859_15"])
def test_unlisted_encodings(spark, encoding):
    spoilt = (lambda t: "".join(garble._read(c.encode(), encoding) if ord(c) > 127 else c for c in t)) if encoding not in ("gbk", "shift_jis") else read_as(encoding)
    rows, bad = captions(spoilt)
    got = {r.pos: r.restored for r in garble.repair(manifest(spark, rows)).collect()}
    assert set(got) <= set(bad)
    right = sum(got.get(p) == t for p, (_, t) in bad.items())
    assert len(got) >= 36 and right >= 36


def test_invented_encoding(spark):
    rows, bad = captions(invented)
    # the mapping reaches a word that has no twin
    rows.append((900, "a " + invented("pâtéñ") + " alone"))
    got = {r.pos: r.restored for r in garble.repair(manifest(spark, rows)).collect()}
    assert got == {p: t for p, (_, t) in bad.items()} | {900: "a pâtéñ alone"}


def test_spelling_is_no_encoding(spark):
    rows = [(i, f"the café and the señor of {w}") for i, w in enumerate(PLAIN * 10)]
    rows += [(500, "the ｃａｆé and CAFÉ"), (501, "the caf​é and se​ñor"), (502, "the cafè and la señora"), (503, "it‘s and that‘s and what‘s")]
    rows += [(600 + i, "it’s and that’s and what’s fine") for i in range(9)]
    assert garble.repair(manifest(spark, rows)).count() == 0
