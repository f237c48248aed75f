"""Every query of the core with an SQL twin gives the twin's rows; the others run."""

import pytest

from tarnloom.plans import registry

from .twins import compare

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twin(spark, sf_dir, name):
    compare(spark, sf_dir, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns))
    df.count()


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
