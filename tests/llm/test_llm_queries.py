import os

import pytest
from compare import DATA, connection, rows_of_duckdb, rows_of_spark

from graphloom.llm.queries import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    assert rows_of_spark(QUERIES[name](spark, DATA)) == rows_of_duckdb(connection(), ORACLE[name])


@pytest.mark.parametrize("name", ["p1_ranking", "p2_pairs", "p3_found", "p4_found", "p10_found"])
def test_same_rows_under_another_partitioning(spark, name):
    first = rows_of_spark(QUERIES[name](spark, DATA))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows_of_spark(QUERIES[name](spark, DATA)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_found_queries_have_exactly_their_columns(spark):
    columns = {"p1_found": ["task_id", "symbol_id"], "p2_found": ["node_id"], "p3_found": ["file_id"], "p4_found": ["file_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id_a", "doc_id_b"]}
    assert {n: QUERIES[n](spark, DATA).columns for n in columns} == columns
