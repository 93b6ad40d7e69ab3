"""Corpus queries that SQL can express, on the smallest driver tables."""

from pathlib import Path

import pytest
from oracle import compare

from lodestar.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), SF, queries.ORACLE_SQL[name]) is None
