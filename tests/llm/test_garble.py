"""Problem 3: garbled text is found and restored; right text is left alone."""

import random

from pyspark.sql import functions as F

from tarnloom.llm import garble

from .data import manifest

CLEAN = [
    "the señor said it’s a café near the château",
    "we’ve put “jam” on the entrée – for £5",
    "it’s 20°C at the château and we’ve a señor",
    "Пожалуйста, положите новый гонёк рядом",
    "À côté du château, il répète déjà la leçon",
    "Em SÃO Paulo, a mãe não deve dobrar",
    "Ångel and Zoë met Müller … quite “often”",
    "plain ascii text only",
]


def spoil(t, enc):
    return "".join(garble._read(c.encode(), enc) if ord(c) > 127 else c for c in t)


def table(spark):
    rows = [(i, CLEAN[i % len(CLEAN)]) for i in range(400)]
    bad = {}
    kinds = [lambda t: spoil(t, "cp1252"), lambda t: spoil(spoil(t, "cp1252"), "cp1252"), lambda t: spoil(t, "mac_roman"), lambda t: spoil(t, "cp437"), lambda t: spoil(t, "cp1251"), lambda t: spoil(t, "latin_1")]
    rng = random.Random(1)
    for i in range(60):
        t = CLEAN[rng.choice([0, 1, 2, 4, 6])]
        bad[1000 + i] = (kinds[i % len(kinds)](t), t)
    one = CLEAN[0].encode("mac_roman").decode("cp1252")
    bad[2000], bad[2001] = (one, CLEAN[0]), (one + "!", CLEAN[0] + "!")
    bad[2002] = ("the se�or said a caf�", "the señor said a café")
    bad[2003] = ("lost �xyz�", None)
    rows += [(p, g) for p, (g, _) in bad.items()] + [(5000, None), (5001, ""), (5002, "x" * 50_000 + "é")]
    return rows, bad


def test_repair(spark):
    rows, bad = table(spark)
    got = {r.pos: r.restored for r in garble.repair(manifest(spark, rows, extra=True)).collect()}
    assert set(got) == set(bad)
    assert {p: x for p, x in got.items() if x != bad[p][1]} == {}


def test_nothing_to_learn(spark):
    assert garble.repair(manifest(spark, [])).count() == 0
    assert garble.repair(manifest(spark, [(1, None), (2, "abc"), (3, "déjà vu")])).count() == 0
    got = garble.repair(manifest(spark, [(1, "�")])).collect()
    assert [(r.pos, r.restored) for r in got] == [(1, None)]


def test_other_key_and_column(spark):
    rows, bad = table(spark)
    df = spark.createDataFrame([(f"k{p}", t) for p, t in rows], "id string, body string").withColumn("restored", F.lit(1))
    assert {r.id for r in garble.repair(df, "id", "body").collect()} == {f"k{p}" for p in bad}


def test_units_do_not_cover_natural_letters():
    t = garble.unit_table({"и": 5, "é": 3}, set("абвгдеёжзийклмнопрстуфхцчшщъыьэюяРСГВ"))
    assert "é" in t["utf8>cp1251"].values() and all(any(c not in "РСё" for c in u) for u in t["utf8>cp1251"])
