from graphloom.operators import references as R

NODE = "label string, node_id string, op string, properties string, changed_at timestamp_ntz"
REF = "ref_id bigint, src_symbol_id string, name string, qualifier string, kind string, package string, repo_id string, recorded_at timestamp_ntz"
LIB = "symbol_id string, name string, package string"


def node(i, op, when, name="f", package="a.b"):
    return ("Symbol", i, op, None if op == "delete" else f'{{"name": "{name}", "package": "{package}"}}', when)


def found(spark, refs, nodes, lib=()):
    out = R.orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(nodes, NODE), spark.createDataFrame(list(lib), LIB))
    return sorted((r["ref_id"], r["side"], r["reason"]) for r in out.collect())


def test_missing_deleted_and_late(spark, at):
    nodes = [node("py::a.b::::f#1", "upsert", at(2)), node("py::a.b::::g#2", "upsert", at(1), "g"), node("py::a.b::::g#2", "delete", at(5))]
    refs = [
        (1, "py::a.b::::f#1", "f", None, "call", "a.b", "r", at(3)),  # all there
        (2, "py::a.b::::f#1", "f", "a/b", "call", "x", "r", at(1)),  # both before the first row
        (3, "nobody", "g", " a :: b ", "call", "x", "r", at(9)),  # missing source, deleted target
        (4, None, None, None, "call", "a.b", "r", at(9)),  # refers to nothing
        (5, None, "shared", "lib.x", "call", "a.b", "r", at(1)),
    ]
    got = found(spark, refs + refs[:1] + refs[2:3], nodes, [("l#1", "shared", "lib.x")])
    assert got == [(2, "source", "late"), (2, "target", "late"), (3, "source", "missing"), (3, "target", "deleted")]


def test_symbol_that_came_back_is_there(spark, at):
    nodes = [node("i#1", "upsert", at(1)), node("i#1", "delete", at(2)), node("i#1", "upsert", at(3))]
    assert found(spark, [(1, "i#1", "f", "a.b", "call", "z", "r", at(2))], nodes) == []


def test_hot_parent_and_empty_tables(spark, at):
    nodes = [node("i#1", "upsert", at(1))]
    refs = [(k, "i#1", "f", None, "call", "a.b", "r", at(2)) for k in range(3000)] + [(9999, "gone", "f", None, "call", "a.b", "r", at(2))]
    assert found(spark, refs, nodes) == [(9999, "source", "missing")]
    assert found(spark, [], nodes) == []
    assert found(spark, refs[:1], []) == [(0, "source", "missing"), (0, "target", "missing")]


def test_report_counts_per_side_and_month(spark, at):
    refs = spark.createDataFrame([(1, "x", None, None, "call", "p", "r", at(2)), (2, "i#1", None, None, "call", "p", "r", at(3))], REF)
    nodes = spark.createDataFrame([node("i#1", "upsert", at(1))], NODE)
    lib = spark.createDataFrame([], LIB)
    got = R.orphan_report(R.orphans(refs, nodes, lib), refs).collect()
    assert [(r["side"], r["month"], r["n_references"], r["n_missing"], r["n_orphans"]) for r in got] == [("source", "2024-01", 2, 1, 1)]


def test_nulls_and_clashing_columns(spark, at):
    refs = spark.createDataFrame([(None, None, None, None, None, None, None, None, "k", "s"), (1, "i#1", "f", None, None, None, None, None, "k", "s"), (2, "i#1", "f", "a.b", "call", None, None, at(5), "k", "s")], REF + ", key string, side string")
    nodes = spark.createDataFrame([(*node("i#1", "upsert", at(1)), "k", at(1)), ("Symbol", "j#2", None, None, None, "k", None), (None, None, None, None, None, None, None)], NODE + ", key string, first_at timestamp_ntz")
    lib = spark.createDataFrame([(None, None, None, "k")], LIB + ", key string")
    got = sorted((r["ref_id"], r["side"], r["reason"]) for r in R.orphans(refs, nodes, lib).collect())
    assert got == [(1, "source", "late"), (1, "target", "missing")]
