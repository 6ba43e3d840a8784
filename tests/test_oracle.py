"""Every core query with SQL gives the rows that DuckDB gives."""

import pytest
from oracle import TESTDATA, compare

from trackweave.plans import catalog

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    compare(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)
