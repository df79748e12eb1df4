"""Every registered query against its DuckDB SQL."""

import compare
import pytest
from driftlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, name):
    assert compare.differences(spark, name, registry.QUERIES[name], registry.ORACLE[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_same_rows_again(spark, name):
    """Without SQL: rows that don't depend on the run, and some of them."""
    first = registry.QUERIES[name](spark, SF)
    rows = sorted(map(str, first.collect()))
    assert rows
    assert rows == sorted(map(str, registry.QUERIES[name](spark, SF).collect()))
