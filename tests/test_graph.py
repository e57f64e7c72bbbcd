import random

import pytest
from pyspark.sql import functions as F

from graphloom import tables
from graphloom.operators import graph
from graphloom.operators.ordering import ranked, running_sum

EDGE = "label string, src_id string, dst_id string, provenance string, ref_kind string, line int"
SYM = "symbol_id string, name string, file_id string, line int"


def e(label, a, b):
    return (label, a, b, "scip", None, 1)


def test_latest_is_total_and_folds_repeats(spark, at):
    df = spark.createDataFrame([("a", at(1), 1), ("a", at(2), 2), ("a", at(2), 3), ("a", at(2), 3), ("b", None, 9)], "k string, t timestamp_ntz, v int")
    assert sorted(map(tuple, tables.latest(df, ["k"], "t", ["v"]).select("k", "v").collect())) == [("a", 3), ("b", 9)]


def test_edges_fold_sightings_and_drop_unknown_targets(spark):
    log = spark.createDataFrame([("CALLS", "a", "b", "heuristic", None, 3), ("CALLS", "a", "b", "scip", None, 2), ("CALLS", "a", None, "scip", None, 1)], EDGE)
    assert [tuple(r) for r in tables.edges(log).collect()] == [("CALLS", "a", "b", "scip", None, 2)]


def test_neighbours_need_a_live_node(spark):
    s = spark.createDataFrame([("a", "a", "f", 1)], SYM)
    x = spark.createDataFrame([e("CALLS", "a", "z"), e("CALLS", "gone", "z"), e("REFERENCES", "a", "z")], EDGE)
    assert [(r["symbol_id"], r["neighbour_id"]) for r in graph.neighbours(x, s, "callers").collect()] == [("z", "a")]


def test_degree_counts_self_loops_twice(spark):
    x = spark.createDataFrame([e("CALLS", "a", "a"), e("CALLS", "a", "b"), e("REFERENCES", "a", "b")], EDGE)
    assert {r["symbol_id"]: r["degree"] for r in graph.degrees(x).collect()} == {"a": 4, "b": 2}


def test_walk_keeps_least_depth_in_cycles(spark):
    x = spark.createDataFrame([e("CALLS", "b", "a"), e("CALLS", "c", "b"), e("CALLS", "a", "c"), e("CALLS", "c", "a"), e("CALLS", "d", "c")], EDGE)
    roots = spark.createDataFrame([("a",)], "symbol_id string")
    assert sorted((r["symbol_id"], r["depth"]) for r in graph.call_graph(x, roots, 5).collect()) == [("b", 1), ("c", 1), ("d", 2)]


def test_blast_radius_prefers_calls(spark):
    x = spark.createDataFrame([e("REFERENCES", "b", "a"), e("CALLS", "b", "a"), e("INHERITS", "c", "b")], EDGE)
    roots = spark.createDataFrame([("a",)], "symbol_id string")
    assert sorted((r["symbol_id"], r["depth"], r["edge_type"]) for r in graph.blast_radius(x, roots).collect()) == [("b", 1, "CALLS"), ("c", 2, "INHERITS")]


def test_closure_reaches_the_fixpoint(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)] + [("n7", "n0")], "src string, dst string")
    roots = spark.createDataFrame([("n2",)], "node string")
    assert {r["node"]: r["depth"] for r in graph.closure(links, roots).collect()} == {f"n{(2 + i) % 8}": i for i in range(1, 8)}


def test_ppr_matches_plain_iteration(spark):
    nodes = [("t", "a", 0.9), ("t", "b", 0.0), ("t", "c", 0.3), ("t", "x", 0.0)]
    links = [("t", "a", "b"), ("t", "b", "c"), ("t", "c", "a"), ("t", "c", "c")]
    got = {r["symbol_id"]: r["mass"] for r in graph.ppr(spark.createDataFrame(nodes, "task_id string, symbol_id string, seed double"), spark.createDataFrame(links, "task_id string, a string, b string")).collect()}
    total = sum(s for _, _, s in nodes)
    p = {n: s / total for _, n, s in nodes}
    near = {"a": {"b", "c"}, "b": {"a", "c"}, "c": {"a", "b"}, "x": set()}
    m = dict(p)
    for _ in range(3):
        m = {n: 0.5 * p[n] + 0.5 * sum(m[k] / len(near[k]) for k in near[n]) for n in p}
    assert got == pytest.approx(m, abs=1e-9)


def test_running_sum_and_rank_over_many_partitions(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 5)}", i, rng.randint(1, 9)) for i in rng.sample(range(10_000), 900)] + [(None, 1, 5), (None, 2, 6)]
    df = spark.createDataFrame(data, "k string, o int, v int").repartition(5)
    got = {(r["k"], r["o"]): r["before"] for r in running_sum(df, ["k"], [F.col("o").desc()], "v").collect()}
    assert got == {(k, o): sum(w for j, p, w in data if j == k and p > o) for k, o, _ in data}
    ranks = {(r["k"], r["o"]): r["rank"] for r in ranked(df, ["k"], [F.col("o")]).collect()}
    assert ranks == {(k, o): 1 + sum(1 for j, p, _ in data if j == k and p < o) for k, o, _ in data}
    assert running_sum(df.where("o < 0"), ["k"], [F.col("o")], "v").count() == 0


def test_closure_has_no_bound_on_depth(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(66)], "src string, dst string")
    got = {r["node"]: r["depth"] for r in graph.closure(links, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert got == {f"n{i}": i for i in range(1, 67)}


def test_walk_from_a_hub_matches_brute_force(spark):
    """A third of the edges end at one node, and every root reaches it."""
    rng = random.Random(3)
    x = [e("CALLS", f"s{i}", "hub") for i in range(200)] + [e("CALLS", "hub", f"r{i % 5}") for i in range(5)] + [e("CALLS", f"s{rng.randrange(200)}", f"s{rng.randrange(200)}") for _ in range(400)]
    roots = spark.createDataFrame([(f"r{i}",) for i in range(5)], "symbol_id string")
    got = {(r["root_id"], r["symbol_id"]): r["depth"] for r in graph.call_graph(spark.createDataFrame(x, EDGE), roots, 2).collect()}
    callers = {}
    for _, a, b, *_ in x:
        callers.setdefault(b, set()).add(a)
    want = {}
    for i in range(5):
        seen, front = {f"r{i}"}, {f"r{i}"}
        for depth in (1, 2):
            front = {a for b in front for a in callers.get(b, ())} - seen
            seen |= front
            want |= {(f"r{i}", a): depth for a in front}
    assert got == want


def test_files_that_go_with_an_anchors_file(spark):
    """Families of names, then names of one folder that share a word; tests and the anchor's own file are left out."""
    from graphloom.operators import expand, lookup

    schema = "symbol_id string, file_id string, kind string, line int"
    files = ["a/read_order_row.py", "b/write_order_row.py", "a/read_badge.py", "a/test_read_badge.py", "c/other.py"]
    s = spark.createDataFrame([(f"s{i}{k}", f"r:{f}", "class" if k else "function", 9 - k) for i, f in enumerate(files) for k in (0, 1)], schema)
    walked = spark.createDataFrame([("t", "s00", 0.9), ("u", "s40", 0.5)], "task_id string, symbol_id string, strength double")
    got = {(r["task_id"], r["symbol_id"]): (r["rule"], r["strength"]) for r in expand.sibling_files(walked, s).collect()}
    assert got == {("t", f"s1{k}"): ("family", round(0.9 * 0.6 * 0.8, 6)) for k in (0, 1)} | {("t", f"s2{k}"): ("folder", round(0.9 * 0.6 * 0.8, 6)) for k in (0, 1)}
    imports = spark.createDataFrame([("b/write_order_row", "r:c/other.py"), ("x", "r:c/other.py"), ("x", "r:x.py")], "module string, file_id string")
    modules = spark.createDataFrame([("b/write_order_row", "r:b/write_order_row.py"), ("x", "r:x.py")], "module string, file_id string")
    assert sorted(map(tuple, lookup.file_importers(imports, modules).collect())) == [("r:b/write_order_row.py", "r:c/other.py"), ("r:x.py", "r:c/other.py")]
