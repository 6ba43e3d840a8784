"""Every training-data query with SQL gives the rows that DuckDB gives."""

import pytest
from oracle import TESTDATA, compare

from trackweave.llm import queries

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    compare(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF)
