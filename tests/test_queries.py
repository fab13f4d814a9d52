"""Every registered query of the library against its SQL."""

import pytest

from reckoner import catalog
from tests.compare import check


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(df.collect()) > 0
    else:
        check(df, duck, sql)
