"""The training-data queries that SQL can express agree with it."""

import pytest

from tests import oracle
from tessellore.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    oracle.compare(spark, oracle.connect(SF), QUERIES[name], ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_over_the_whole_table(spark, name):
    out = QUERIES[name](spark, SF)
    source = "embeddings" if name.startswith("op9") else "documents"
    assert out.count() >= spark.read.parquet(f"{SF}/{source}.parquet").count()
