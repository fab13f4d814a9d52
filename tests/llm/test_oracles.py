"""The SQL of corpus queries says what the queries do."""

import pytest

from reckoner.llm import registry
from tests.compare import check


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(name, spark, sf, duck):
    check(registry.QUERIES[name](spark, sf), duck, registry.ORACLE_SQL[name])
