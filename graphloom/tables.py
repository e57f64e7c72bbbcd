"""Readers of the code-graph tables and their cleaned states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import ship, spread

SYMBOL_PROPERTIES = (
    "name STRING, kind STRING, signature STRING, visibility STRING, package STRING, namespace STRING, file_id STRING, "
    "line INT, end_line INT, is_test BOOLEAN, body STRING, docstring STRING, language STRING, path STRING, repo_id STRING, text STRING"
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs far more than its bytes: spread over all cores where its files are few."""
    return spread(read(spark, sf_dir, name))


def latest(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order``; ties fall to the greatest values, so repeated rows never change the result.

    One hash aggregate with map-side combine: a key's history is never gathered in a task.
    """
    state = F.max(F.struct(F.col(order), *[F.col(v) for v in values])).alias("_s")
    return df.groupBy(*keys).agg(state).select(*keys, F.col(f"_s.{order}").alias(order), *[F.col(f"_s.{v}").alias(v) for v in values])


def live_nodes(nodes: DataFrame, label: str | None = None) -> DataFrame:
    """Nodes in their latest state that are not deleted."""
    if label:
        nodes = nodes.where(F.col("label") == label)
    state = latest(nodes, ["label", "node_id"], "changed_at", ["op", "properties", "search_text", "repo_id", "file_id", "indexed_at_commit"])
    return state.where(F.col("op") == "upsert")


def symbols(nodes: DataFrame) -> DataFrame:
    """Live symbols with their properties as columns; keys missing in the JSON are null."""
    p = F.from_json("properties", SYMBOL_PROPERTIES)
    return (
        live_nodes(nodes, "Symbol")
        .withColumn("p", p)
        .select(
            F.col("node_id").alias("symbol_id"),
            F.coalesce("p.name", id_name(F.col("node_id"))).alias("name"),
            F.col("p.kind").alias("kind"),
            F.col("p.signature").alias("signature"),
            F.col("p.visibility").alias("visibility"),
            F.coalesce("p.package", id_package(F.col("node_id"))).alias("package"),
            F.col("p.namespace").alias("namespace"),
            F.coalesce("p.file_id", "file_id").alias("file_id"),
            "repo_id",
            F.col("p.line").alias("line"),
            F.col("p.end_line").alias("end_line"),
            F.coalesce("p.is_test", F.lit(False)).alias("is_test"),
            F.col("p.docstring").alias("docstring"),
            F.col("p.body").alias("body"),
            "search_text",
            "indexed_at_commit",
        )
    )


def edges(edge_log: DataFrame) -> DataFrame:
    """Edges by identity (label, src, dst); sightings of one edge are folded, unresolved targets left out.

    The largest value of each property stands for the edge (a total order, so the result never depends on row order).
    """
    return (
        edge_log.where(F.col("dst_id").isNotNull())
        .groupBy("label", "src_id", "dst_id")
        .agg(
            F.max("provenance").alias("provenance"),
            F.max("ref_kind").alias("ref_kind"),
            F.min("line").alias("line"),
        )
    )


def id_package(node_id: Column) -> Column:
    """Package part of ``language::package::namespace::name#digest``."""
    return F.try_element_at(F.split(node_id, "::"), F.lit(2))


def id_name(node_id: Column) -> Column:
    """Name part of a symbol id."""
    return F.regexp_replace(F.element_at(F.split(node_id, "::"), -1), "#[0-9a-f]*$", "")


def row_rank(keys: list[str], order: list[Column], name: str = "rank") -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias(name)
