"""Running sums and ranks within keys, also where one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpointed, slots


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str = "before", total: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same key that come strictly before in ``order``.

    ``total`` names a further column for the sum over the whole key, which costs no further pass.

    Rows are range-partitioned by (keys, order), so a key that holds a third of all rows spans many partitions; each
    partition sums on its own, and the offsets of the partitions of a key (at most as many rows as partitions) are
    added. ``order`` must be total within a key. The partitioning is written to the shared folder, because a second
    sampling of the ranges could differ. Null keys form a group of their own; an empty table stays empty.
    """
    parts = slots(df.sparkSession)
    ranged = checkpointed(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_pid").agg(F.sum(value).alias("_t"))
    up_to = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_pid").alias("_k_pid"), F.coalesce(F.sum("_t").over(up_to), F.lit(0)).alias("_offset"), F.sum("_t").over(Window.partitionBy(*keys)).alias("_total"))
    inside = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = F.col("_pid") == F.col("_k_pid")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    whole = [F.col("_total").alias(total)] if total else []
    return own.join(offsets, on).withColumn(name, F.col("_offset") + F.col("_own")).select(*df.columns, name, *whole)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its position, from 1, within its key; ``order`` must be total within a key."""
    return running_sum(df.withColumn("_one", F.lit(1)), keys, order, "_one", name).drop("_one").withColumn(name, F.col(name) + 1)


def numbered(values: DataFrame, column: str) -> DataFrame:
    """(``column``, number): each distinct value of ``column`` with its position, from 1, in the order of the values; nulls have none.

    Numbers compare as their values do, so they stand for long texts in joins and ties.
    """
    return ranked(values.select(column).where(F.col(column).isNotNull()).distinct(), [], [F.col(column)], "number")
