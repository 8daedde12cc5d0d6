"""Every query with an oracle, against DuckDB on the whole tables of sf0.01; the others have to run."""

import pytest
from conftest import SF

from lectern.plans import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(name, same_as_duck):
    same_as_duck(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
