"""Queries that SQL can express, against DuckDB on the whole tables of sf0.01."""

import pytest

from lectern.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_as_duck):
    same_as_duck(QUERIES[name], ORACLES[name])
