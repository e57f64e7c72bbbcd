"""Per-key results when a few keys hold most rows.

A frequent-items sketch finds the heavy keys (its list is bounded by ``capacity``), rows of heavy keys are marked
by a broadcast join and spread over salts, the remaining keys take the ordinary shuffle, and both parts are united.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Most keys that can be heavy: a key is heavy from 1/256 of the rows on, so no more than 256 exist.
CAPACITY = 256
#: Counters of the frequent-items sketch; its error stays below rows / 1024, a quarter of the heavy share.
TRACKED = 4096


def heavy_keys(df: DataFrame, key: str, capacity: int = CAPACITY, tracked: int = TRACKED) -> list:
    """Keys that hold at least a 1/``capacity`` share of the non-null rows, greatest first; at most ``capacity``.

    The sketch is combined map-side, so only sketches travel. Its counts may miss by rows/1024; the share is only a
    choice of path, results are exact on either. Empty tables and all-null keys give an empty list.
    """
    found = (
        df.where(F.col(key).isNotNull())
        .agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {capacity}, {tracked})").alias("top"))
        .first()
    )
    if not found or not found["n"]:
        return []
    return [x["item"] for x in found["top"] if x["count"] * capacity >= found["n"]]


def _named(df: DataFrame, key: str, heavy: list) -> DataFrame:
    """(key, _salt_key): the heavy keys and their small numbers as rows of the plan itself, for which no Python worker starts."""
    kind = df.schema[key].dataType
    rows = pa.table({key: pa.array(heavy, to_arrow_type(kind)), "_salt_key": pa.array(range(len(heavy)), pa.int32())})
    return df.sparkSession.createDataFrame(rows, f"`{key}` {kind.simpleString()}, _salt_key INT")


def split(df: DataFrame, key: str, heavy: list) -> tuple[DataFrame, DataFrame]:
    """Rows of heavy keys (with ``_salt_key``, their small number) and the rest, nulls of the key left out."""
    rows = df.where(F.col(key).isNotNull())
    small = F.broadcast(_named(df, key, heavy))  # at most CAPACITY rows
    return rows.join(small, key), rows.join(small, key, "left_anti")


def distinct_counts(df: DataFrame, key: str, members: list[str], heavy: list | None = None, salts: int = 32) -> DataFrame:
    """(key, n_rows, n_distinct): rows and distinct ``members`` tuples of every non-null key.

    Members are deduplicated as tuples, null members counting as values. Null keys belong to no group; an empty table
    gives no rows; repeated rows count in ``n_rows`` only. Heavy keys are counted in ``salts`` shares, each member
    tuple in one share, so that no task holds a heavy key.
    """
    heavy = heavy_keys(df, key) if heavy is None else heavy
    hot, cold = split(df.select(key, *members), key, heavy)
    of = F.hash(*members)
    hot = (
        hot.groupBy("_salt_key", key, *members).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("_salt_key", key, F.pmod(of, F.lit(salts)).alias("_salt")).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"))
        .groupBy(key).agg(F.sum("_n").alias("n_rows"), F.sum("_d").alias("n_distinct"))
    )
    cold = (
        cold.groupBy(key, *members).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(key).agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    )
    return hot.unionByName(cold)


def aggregate(df: DataFrame, key: str, partial: dict, final: dict, heavy: list | None = None, salts: int = 32) -> DataFrame:
    """Any decomposable aggregate per key: ``partial`` columns per (key, salt), ``final`` columns over them.

    Both parts combine map-side; heavy keys are shuffled by (key, salt) first. Null keys are left out.
    """
    heavy = heavy_keys(df, key) if heavy is None else heavy
    hot, cold = split(df, key, heavy)
    parts = [e.alias(k) for k, e in partial.items()]
    totals = [e.alias(k) for k, e in final.items()]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    hot = hot.groupBy("_salt_key", key, salt.alias("_salt")).agg(*parts).groupBy(key).agg(*totals)
    return hot.unionByName(cold.groupBy(key).agg(*parts).groupBy(key).agg(*totals))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: list, how: str = "inner", heavy: list | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, heavy keys of ``left`` in salted shares; ``how``: inner, left or left_semi.

    Null keys meet nothing, as in any equi-join; all columns of the right side but the key are appended.
    """
    a, b = salted_pair(left, right, key, spread, heavy)
    return a.join(b, [key, "_salt"], how).drop("_salt")


def salted_pair(left: DataFrame, right: DataFrame, key: str, spread: list, heavy: list | None = None, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join with a ``_salt``: heavy keys of ``left`` are cut into ``salts`` shares by ``spread``,
    and only their rows of ``right`` are repeated; every other key keeps salt 0. Join on (key, _salt)."""
    heavy = heavy_keys(left, key) if heavy is None else heavy
    if not heavy:
        return left.withColumn("_salt", F.lit(0)), right.withColumn("_salt", F.lit(0))
    small = F.broadcast(_named(left, key, heavy).select(key, F.lit(True).alias("_hot")))  # at most CAPACITY rows
    left = left.join(small, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    shares = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(small, key, "left").withColumn("_salt", F.explode(shares)).drop("_hot")
    return left, right
