"""Every registered query against the SQL that states the same result."""

from __future__ import annotations

import pytest

from factfold.plans import catalogue
from tests.oracle import expected, found


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, data, name):
    assert found(catalogue.QUERIES[name](spark, data)) == expected(catalogue.ORACLE_SQL[name], data)
