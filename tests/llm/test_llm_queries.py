"""Every pN query runs on the smallest tables; those with SQL give what DuckDB gives."""

import pytest

from talesieve.llm import queries
from tests.test_queries import compared, duck, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    compared(spark, duck, queries.QUERIES[name], queries.ORACLES.get(name))
