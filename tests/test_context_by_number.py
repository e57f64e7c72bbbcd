"""What makes the batch of contexts fast: ids as numbers, one join a hop, heavy keys without Python, tasks kept together."""

from pyspark.sql import functions as F

from graphloom.operators import candidates, expand, heavy_keys
from graphloom.operators.ordering import numbered
from graphloom.session import checkpointed_by


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_stand_in_the_order_of_their_values(spark):
    df = spark.createDataFrame([("b",), ("a::x",), (None,), ("Z",), ("b",), ("",)], "id string")
    assert rows(numbered(df, "id")) == [("", 1), ("Z", 2), ("a::x", 3), ("b", 4)]
    assert rows(numbered(df.limit(0), "id")) == []


def test_heavy_keys_start_no_python_worker(spark):
    df = spark.range(40).select((F.col("id") % 2).cast("string").alias("k"), "id")
    names = df.select("k").distinct()
    for heavy in ([], ["1"]):
        a, b = heavy_keys.salted_pair(df, names, "k", ["id"], heavy)
        assert "ExistingRDD" not in plan(a) + plan(b)
        assert rows(a.join(b, ["k", "_salt"]).select("k", "id")) == rows(df)


def test_rows_of_a_task_stay_where_they_are(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    df = checkpointed_by(spark.range(100).select((F.col("id") % 7).alias("task_id"), "id"), "task_id")
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    assert "Exchange" not in plan(df.groupBy("task_id", "id").count())
    assert df.count() == 100


def test_one_join_a_hop_in_all_directions(spark):
    edges = spark.createDataFrame([("CALLS", 2, 1, "call", "scip"), ("CALLS", 1, 3, "call", "scip"), ("REFERENCES", 4, 1, "read", "heuristic"), ("REFERENCES", 1, 5, "read", None), ("INHERITS", 6, 1, None, None), ("IMPLEMENTS", 1, 7, None, None), ("OWNS", 8, 1, None, None)], "label string, src_id long, dst_id long, ref_kind string, provenance string")
    got = expand._hops(spark.createDataFrame([("t", 1, 1.0)], "task_id string, symbol_id long, strength double"), edges, list(expand.RULES))
    assert {(r["rule"], r["symbol_id"]) for r in got.collect()} == {(1, 2), (3, 3), (4, 4), (5, 5), (6, 7), (7, 6)}
    assert "Union" not in plan(got)


def test_demotion_and_selection_by_number(spark):
    ids = ["py::p::A::f#1", "py::p::A::g#2", "py::p::::A#3", "py::p::B::f#4", "py::p::::B#5", "py::q::::mod#6"]
    kinds = ["method", "method", "class", "method", "class", "module"]
    by_id = spark.createDataFrame([("t", i, k, f, 9.0 - n, n if n % 2 else None) for n, (i, k, f) in enumerate(zip(ids, kinds, ["a", "a", "a", "", None, "a"]))], "task_id string, symbol_id string, kind string, file_id string, score double, semantic_rank int")
    no = {r["id"]: r["number"] for r in numbered(by_id.select(F.col("symbol_id").alias("id")), "id").collect()}
    own = by_id.select("*", candidates.owner(F.col("symbol_id")).alias("o"), candidates.member_prefix(F.col("symbol_id")).alias("p")).collect()
    groups = {r["group"]: r["number"] for r in numbered(spark.createDataFrame([(x,) for r in own for x in (r["o"], r["p"])], "group string"), "group").collect()}
    by_no = spark.createDataFrame([("t", no[r["symbol_id"]], r["kind"], {"a": 1, "": 0, None: None}[r["file_id"]], r["score"], r["semantic_rank"], groups.get(r["o"]), groups.get(r["p"])) for r in own], "task_id string, symbol_id long, kind string, file_id long, score double, semantic_rank int, owner long, member_prefix long")
    one, two = candidates.demoted(by_id), candidates.demoted(by_no)
    back = {v: k for k, v in no.items()}
    assert sum(r["container_penalty"] > 0 for r in one.collect()) == 3
    assert rows(one.select("symbol_id", "score", "rank")) == sorted((back[r["symbol_id"]], r["score"], r["rank"]) for r in two.collect())
    picked = candidates.narrowed(two.withColumn("file_id", F.when(F.col("file_id") > 0, F.col("file_id"))), 4)
    assert rows(candidates.narrowed(one, 4).select("slot", "symbol_id")) == sorted((r["slot"], back[r["symbol_id"]]) for r in picked.collect())
