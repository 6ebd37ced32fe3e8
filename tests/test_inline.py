"""The operators on small inline inputs, with the rows they must give written out."""

import duckdb
import inline_cases
import pytest
from test_queries import as_rows


@pytest.mark.parametrize("name", sorted(inline_cases.QUERIES))
def test_inline_case(spark, name):
    got, truth = inline_cases.QUERIES[name](spark, "").toPandas(), duckdb.execute(inline_cases.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(truth.columns)
    assert as_rows(got) == as_rows(truth)
