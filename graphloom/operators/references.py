"""References to records that do not exist: missing, deleted or arriving later than the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import heavy_keys as hk
from graphloom.tables import id_name, id_package


def package_of(text: Column) -> Column:
    """One spelling of a package: blanks dropped, slashes and double colons as dots."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"::|/", ".")


def parent_intervals(nodes: DataFrame, library: DataFrame) -> DataFrame:
    """(key, first_at, live_at, gone_at): validity of each parent key.

    ``first_at``: first row of any symbol of the key; ``live_at``: earliest first row of one whose latest state is not
    a delete (null: none is live); library symbols are live from the beginning of time. Keys: ``S|node_id`` for an id,
    ``N|package|name`` for a name in a package. Of two states at the same instant the upsert counts.
    """
    state = (
        nodes.where(F.col("label") == "Symbol")
        .groupBy("node_id")
        .agg(
            F.min("changed_at").alias("first_at"),
            F.max("changed_at").alias("last_at"),
            F.max(F.struct("changed_at", (F.col("op") != "delete").alias("live"))).alias("s"),
            F.max(F.struct(F.col("properties").isNotNull(), F.col("changed_at"), F.get_json_object("properties", "$.name").alias("name"), F.get_json_object("properties", "$.package").alias("package"))).alias("p"),
        )
        .select(
            "node_id", "first_at", "last_at", F.col("s.live").alias("live"),
            F.coalesce("p.name", id_name(F.col("node_id"))).alias("name"),
            F.coalesce("p.package", id_package(F.col("node_id"))).alias("package"),
        )
    )
    by_both = state.select(
        F.explode(F.array(F.concat(F.lit("S|"), "node_id"), F.concat(F.lit("N|"), package_of(F.col("package")), F.lit("|"), "name"))).alias("key"),
        "first_at",
        F.when(F.col("live"), F.col("first_at")).alias("live_at"),
        F.when(~F.col("live"), F.col("last_at")).alias("gone_at"),
    )
    always = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    shared = library.select(
        F.concat(F.lit("N|"), package_of(F.col("package")), F.lit("|"), "name").alias("key"), always.alias("first_at"), always.alias("live_at"), F.lit(None).cast("timestamp_ntz").alias("gone_at")
    )
    return (
        by_both.unionByName(shared).where(F.col("key").isNotNull())
        .groupBy("key").agg(F.min("first_at").alias("first_at"), F.min("live_at").alias("live_at"), F.max("gone_at").alias("gone_at"))
    )


def reference_keys(refs: DataFrame) -> DataFrame:
    """Each reference as up to two rows (ref_id, side, key, ...); null ids and names refer to nothing and are left out."""
    target = F.concat(F.lit("N|"), package_of(F.coalesce("qualifier", "package")), F.lit("|"), "name")
    sides = F.array(
        F.struct(F.lit("source").alias("side"), F.concat(F.lit("S|"), "src_symbol_id").alias("key"), F.col("src_symbol_id").isNotNull().alias("refers")),
        F.struct(F.lit("target").alias("side"), target.alias("key"), F.col("name").isNotNull().alias("refers")),
    )
    return (
        refs.select("ref_id", "repo_id", "kind", "recorded_at", F.explode(sides).alias("s"))
        .select("ref_id", "repo_id", "kind", "recorded_at", "s.side", F.coalesce("s.key", F.lit("N||")).alias("key"), "s.refers")
        .where("refers").drop("refers")
    )


def orphans(refs: DataFrame, nodes: DataFrame, library: DataFrame) -> DataFrame:
    """(ref_id, side, repo_id, kind, recorded_at, key, reason) of every reference whose symbol is not there.

    Both streams are co-partitioned by key, sorted and merged linearly (a sort-merge join over the validity
    intervals). Keys referred to by a large share of all references are cut into salted shares, and only their one
    interval is repeated. ``reason``: missing (no row at all), deleted (all its symbols end in a delete), late (live,
    but first seen after the reference). Repeated rows give one row; a null ``recorded_at`` is before any symbol.
    Empty tables give an empty result, or all references as missing.
    """
    wanted = reference_keys(refs).distinct()
    left, right = hk.salted_pair(wanted, parent_intervals(nodes, library), "key", ["ref_id", "side"])
    merged = left.join(right.hint("merge"), ["key", "_salt"], "left")
    there = F.coalesce(F.col("live_at") <= F.col("recorded_at"), F.lit(False))
    reason = F.when(F.col("first_at").isNull(), "missing").when(F.col("live_at").isNull(), "deleted").otherwise("late")
    return merged.where(~there).select("ref_id", "side", "repo_id", "kind", "recorded_at", "key", reason.alias("reason"))


def orphan_report(orphan_rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Orphans per side, month of ``recorded_at`` and reason, with the references of that side and month."""
    month = F.date_format(F.date_trunc("month", "recorded_at"), "yyyy-MM")
    total = reference_keys(refs).distinct().groupBy("side", month.alias("month")).agg(F.count(F.lit(1)).alias("n_references"))
    found = orphan_rows.groupBy("side", month.alias("month")).agg(
        *[F.count(F.when(F.col("reason") == r, 1)).alias(f"n_{r}") for r in ("missing", "deleted", "late")],
        F.count(F.lit(1)).alias("n_orphans"),
    )
    none = {f"n_{r}": 0 for r in ("missing", "deleted", "late", "orphans")}
    return total.join(found, ["side", "month"], "left").fillna(none).withColumn(
        "table_name", F.when(F.col("side") == "source", F.lit("graph_node")).otherwise(F.lit("graph_node+library_symbol"))
    )
