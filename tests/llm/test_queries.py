from __future__ import annotations

import pytest

from compare import compare, connection
from conftest import SF
from plantweave.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", [*QUERIES])
def test_query(spark, duck, name):
    n, _, wrong, _ = compare(spark, SF, name, QUERIES[name], SQL.get(name), duck)
    assert wrong is None and n > 0
