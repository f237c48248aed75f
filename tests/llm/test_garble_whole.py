"""Problem 3: words without a Latin letter, read with a wrong one-byte encoding."""

import pyarrow as pa
import pytest

from tarnloom.llm import garble

from .data import manifest

RUSSIAN = ["Пожалуйста, положите новый ключ рядом", "Сегодня хорошая погода", "Новый дом стоит рядом"]


@pytest.mark.parametrize("true, read", [("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251")])
def test_cyrillic_one_byte(spark, true, read):
    rows = [(i, RUSSIAN[i % 3]) for i in range(60)] + [(900, "it’s a café"), (901, "déjà vu")]
    bad = {1000 + i: (t.encode(true).decode(read), t) for i, t in enumerate(RUSSIAN)}
    got = garble.repair(manifest(spark, rows + [(p, g) for p, (g, _) in bad.items()], extra=True)).collect()
    assert {r.pos: r.restored for r in got} == {p: t for p, (_, t) in bad.items()}


@pytest.mark.parametrize("rounds", [1, 6, 7, 9])
def test_every_round_is_undone(rounds):
    text = "it’s déjà vu"
    bad = seen = text
    for _ in range(rounds):
        bad = garble._read(bad.encode(), "latin_1")
        seen += bad
    tables = {how: t for how, t in garble.unit_table({c: 1 for c in seen if ord(c) > 127}, joint=True).items() if how == "utf8>latin_1"}
    batch = pa.RecordBatch.from_pydict({"id": [1], "text": [bad]})
    (out,) = garble._apply(tables, tables)(iter([batch]))
    assert out["restored"].to_pylist() == [text]
    assert garble.Decoder(tables["utf8>latin_1"]).fully(bad) == text
