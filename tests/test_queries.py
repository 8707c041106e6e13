"""Every query of the core against its SQL twin."""

import pytest

from quarrylight.plans import registry
from tests import compare


@pytest.fixture(scope="module")
def duck():
    return compare.duck()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_agrees_with_sql(spark, duck, name):
    assert compare.spark_rows(registry.QUERIES[name](spark, compare.DATA)) == compare.duck_rows(duck, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, compare.DATA).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["entity_name", "law_id", "reason", "applicable"]
