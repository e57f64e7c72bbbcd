import os

import pytest
from compare import DATA, connection, rows_of_duckdb, rows_of_spark

from graphloom.plans import registry

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert rows_of_spark(QUERIES[name](spark, DATA)) == rows_of_duckdb(connection(), SQL[name])


@pytest.mark.parametrize("name", ["narrow_k20", "assemble_budget", "hybrid_search", "anchors_noisy_or", "ppr_reweight", "related_tests", "impact_dependents_2", "get_context_for_task"])
def test_same_rows_under_another_partitioning(spark, name):
    first = rows_of_spark(QUERIES[name](spark, DATA))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows_of_spark(QUERIES[name](spark, DATA)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_the_others_run(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0
