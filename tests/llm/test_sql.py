import pytest

from cueloom.llm import queries
from oracle import agree


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, sf_dir, name):
    agree(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])
