"""Every query that has SQL against DuckDB; the others run."""

import compare
import pytest

from polystrata.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.views(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, con, name):
    assert compare.compare(spark, con, SF, registry.QUERIES[name], registry.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.count()
