"""All queries of the core engine with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import data_queries, graph_queries, index_queries, lookup_queries, retrieval_queries, search_queries

MODULES = [data_queries, graph_queries, search_queries, retrieval_queries, index_queries, lookup_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.get_context_for_task(spark, sf_dir)
