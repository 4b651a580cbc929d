"""Every registered query with an oracle agrees with it; the others run and return rows."""

import pytest

from tests import oracle
from tessellore.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    oracle.compare(spark, con, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry_has_rows_and_stable_columns(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.columns == ["topic_id", "year", "n_papers"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
