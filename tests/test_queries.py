"""Each query with SQL gives the same rows; some must match something at all."""

import pytest
from conftest import SF
from oracle import compare

from siftwright import queries

@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    compare(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_names_are_whole():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_rules_match_something(spark):
    reasons = {r.reason for r in queries.QUERIES["segment_histogram"](spark, SF).collect()}
    assert {"tool_metadata", "cleaned_from_filler", "inline_filler", "residual_fragment", "empty_line"} <= reasons
