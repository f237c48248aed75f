"""The pN_ queries: those with an SQL twin give its rows, all have their columns."""

import pytest

from tarnloom.llm.oracle import ORACLE
from tarnloom.llm.queries import QUERIES

from ..twins import compare

COLUMNS = {
    "p1_found": ["recording"], "p2_found": ["first_pos", "copy_pos"], "p3_found": ["pos"], "p4_found": ["pos_a", "pos_b"], "p5_found": ["pos_a", "pos_b"],
    "p6_found": ["pos_a", "pos_b"], "p7_found": ["group_vid", "vid"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == COLUMNS.get(name, df.columns)
    df.count()
