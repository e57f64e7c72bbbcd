from collections import Counter

from pyspark.sql import functions as F

from graphloom.operators import heavy_keys as hk


def rows(spark):
    data = [("hub", f"m{i % 700}", i) for i in range(2000)] + [(f"k{i % 90}", f"m{i % 13}", i) for i in range(1000)] + [(None, "x", 1)] * 50 + [("k1", None, 1)] * 2
    return spark.createDataFrame(data, "k string, m string, v int"), data


def test_finds_the_heavy_key(spark):
    df, _ = rows(spark)
    assert hk.heavy_keys(df, "k", capacity=4) == ["hub"]


def test_counts_are_complete_on_both_paths(spark):
    df, data = rows(spark)
    want_rows = Counter(k for k, _, _ in data if k)
    want_distinct = Counter(k for k, _ in {(k, m) for k, m, _ in data if k})
    for heavy in ([], ["hub"], ["hub", "k1", "k2"]):
        got = {r["k"]: (r["n_rows"], r["n_distinct"]) for r in hk.distinct_counts(df, "k", ["m"], heavy).collect()}
        assert got == {k: (want_rows[k], want_distinct[k]) for k in want_rows}


def test_aggregate_matches_plain_group_by(spark):
    df, _ = rows(spark)
    got = hk.aggregate(df, "k", {"_s": F.sum("v"), "_m": F.max("v")}, {"s": F.sum("_s"), "m": F.max("_m")}, ["hub"])
    want = df.where(F.col("k").isNotNull()).groupBy("k").agg(F.sum("v").alias("s"), F.max("v").alias("m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_salted_join_loses_and_repeats_nothing(spark):
    df, _ = rows(spark)
    names = spark.createDataFrame([("hub", 1), ("k1", 2), ("none", 3)], "k string, w int")
    a, b = hk.salted_pair(df, names, "k", ["v"], ["hub"])
    assert a.join(b, ["k", "_salt"]).count() == df.join(names, "k").count()
    assert a.where("k = 'hub'").select("_salt").distinct().count() > 1


def test_empty_and_null_keys(spark):
    empty = spark.createDataFrame([], "k string, m string")
    assert hk.heavy_keys(empty, "k") == []
    assert hk.distinct_counts(empty, "k", ["m"]).count() == 0
    nulls = spark.createDataFrame([(None, "a")] * 3, "k string, m string")
    assert hk.distinct_counts(nulls, "k", ["m"]).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a", "x", 1, 2)], "k string, m string, n_rows int, heavy int")
    assert [tuple(r) for r in hk.distinct_counts(df, "k", ["m"], ["a"]).collect()] == [("a", 1, 1)]


def test_a_hub_with_a_third_of_the_rows_is_cut(spark):
    """The largest task of the join on a key that holds a third of all rows stays far below that third."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), F.col("id").alias("v"))
    names = spark.createDataFrame([("hub", 1), ("k1", 2)], "k string, w int")
    joined = hk.salted_join(df, names, "k", ["v"])
    assert joined.count() == 2001 and joined.columns == ["k", "v", "w"]
    a, _ = hk.salted_pair(df, names, "k", ["v"])
    sizes = [r["count"] for r in a.where("k = 'hub'").groupBy("_salt").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 300
    assert hk.salted_join(df, names, "k", ["v"], "left_semi").count() == 2001 and hk.salted_join(df, names, "k", ["v"], "left").count() == 6000
    assert hk.salted_join(df.limit(0), names, "k", ["v"]).count() == 0
