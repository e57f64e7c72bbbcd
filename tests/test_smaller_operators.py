import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import anchors, evaluation, graph, lookup, render, search, vector
from graphloom.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_routes_of_texts(spark):
    tasks = spark.createDataFrame([("t", "POST /api/users/{id} fails, see https://x.y/api/orders"), ("u", "nothing /a here"), ("v", None)], "task_id string, text string")
    routes = spark.createDataFrame([("/v1/api/users/{id}", "h1"), ("/api/orders", "h2"), ("/api/users", None)], "path string, handler_id string")
    assert rows(anchors.route(tasks, routes)) == [("t", "h1", 1.0)]


def test_common_names_only_corroborate(spark):
    generic = spark.createDataFrame([("t", "a", 0.3), ("t", "b", 0.3), ("u", "a", 0.3)], "task_id string, symbol_id string, strength double")
    found = spark.createDataFrame([("t", "a", "lexical", 0.4), ("t", "a", "usage", 0.2)], "task_id string, symbol_id string, source string, strength double")
    assert rows(anchors.corroborated(generic, found)) == [("t", "a", 0.3)]


def test_history_names_all_symbols_of_its_files(spark):
    s = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "symbol_id string, file_id string")
    assert rows(anchors.history(spark.createDataFrame([("t", "f"), ("t", "f"), ("t", None)], "task_id string, file_id string"), s)) == [("t", "a", 0.7), ("t", "b", 0.7)]


def test_shared_literals(spark):
    quote = 'x = "app.cache-key"'
    s = spark.createDataFrame([("root", f"{quote}\ny = 'only.here'\nz = \"plain\"", False), ("a", quote, False), ("b", quote, True), ("c", "nothing", False)], "symbol_id string, body string, is_test boolean").withColumn("search_text", F.col("body"))
    strong = spark.createDataFrame([("t", "root", 1.0), ("u", "root", 0.8)], "task_id string, symbol_id string, strength double")
    got = rows(anchors.shared_literals(strong, s, search.mentions_of_literals))
    assert got == [("t", "a", round(0.7 * np.sqrt(1 - 2 / 15), 6))]


def test_mass_factors(spark):
    mass = spark.createDataFrame([("t", "a", 0.4), ("t", "b", 0.1), ("t", "c", 0.1), ("t", "d", 0.0), ("u", "x", 0.0)], "task_id string, symbol_id string, mass double")
    evidence = spark.createDataFrame([("t", i, 0.5) for i in "abcd"] + [("u", "x", 0.5), ("t", "e", 0.0)], "task_id string, symbol_id string, strength double")
    assert rows(graph.mass_factors(mass, evidence)) == [("t", "a", 1.5), ("t", "b", 1.0), ("t", "c", 1.0), ("t", "d", round(2 / 3, 6))]


VEC = "ref_id long, chunk long, embedding array<double>"


def test_nearest_matches_brute_force_in_blocks_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = [(i, i % 2, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)] + [(99, 0, None), (98, 0, [0.0] * 4)]
    df = spark.createDataFrame(data, VEC)
    q = df.where("ref_id < 7").select(F.col("ref_id").alias("query_id"), "embedding")
    unit = {(i, c): np.array(v) / np.linalg.norm(v) for i, c, v in data if v and np.linalg.norm(v)}
    want = []
    for i, c, v in data[:7]:
        if np.linalg.norm(v):
            best = sorted((round(float(1 - u @ unit[i, c]), 6), r, k) for (r, k), u in unit.items())[:5]
            want += [(i, r, k, d + 0.0, n + 1) for n, (d, r, k) in enumerate(best)]
    for size in (8192, 7):
        monkeypatch.setattr(vector, "ROW_BLOCK", size)
        monkeypatch.setattr(vector, "QUERY_BLOCK", 3 if size == 7 else 512)
        got = [(a, b, c, round(d, 6) + 0.0, e) for a, b, c, d, e in rows(vector.nearest(df, q, 5))]
        assert got == sorted(want)
    assert vector.nearest(df.limit(0), q, 5).count() == 0


def test_index_finds_most_and_holds_every_row(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    data = [(i, 0, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(data, VEC)
    q = df.where("ref_id % 100 = 0").select(F.col("ref_id").alias("query_id"), "embedding")
    assert vector.in_cells(df, vector.fit_cells(df)).select("ref_id").distinct().count() == 1500
    r = vector.recall_of(vector.nearest_by_index(df, q, 10), vector.nearest(df, q, 10)).first()
    assert r["n_queries"] == 15 and r["recall"] >= 0.9
    assert vector.nearest_by_index(df.limit(0), q, 10).count() == 0


def test_candidates_of_the_model_leave_tests_out(spark):
    hits = spark.createDataFrame([(1, 10, 0.1), (1, 10, 0.3), (1, 11, 0.2), (1, 12, 0.25)], "query_id long, ref_id long, distance double")
    s = spark.createDataFrame([(10, "a", False), (11, "t", True), (12, "b", False)], "ref_id long, symbol_id string, is_test boolean")
    assert rows(vector.semantic_candidates(hits, s, 5)) == [(1, "a", 0), (1, "b", 1)]


def test_vectors_of_another_model_are_refused(spark):
    stored = spark.createDataFrame([("symbol", "m", [1.0, 2.0]), ("file", "m", [1.0, 2.0])], "kind string, model string, embedding array<double>")
    assert vector.one_model(stored, "m", 2).count() == 2
    for model, dim in (("n", 2), ("m", 3)):
        with pytest.raises(ValueError):
            vector.one_model(stored, model, dim)
    assert rows(lookup.model_of(stored)) == [("file", "m", 2, 1), ("symbol", "m", 2, 1)]


def test_replies_and_percentiles(spark):
    replies = spark.createDataFrame([("t", "f", '{"p": 0.7}'), ("t", "g", '{"p": 7}'), ("t", "h", "no json"), ("t", "i", None)], "task_id string, file_id string, reply string")
    assert rows(render.answers(replies)) == [("t", "f", 0.7), ("t", "g", 1.0), ("t", "h", 0.0), ("t", "i", 0.0)]
    x = spark.range(1).select(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]).alias("v"))
    assert x.select(evaluation.nearest_rank(F.col("v"), 0.5).alias("m"), evaluation.nearest_rank(F.col("v"), 1.0).alias("x")).first()[:] == (3, 4)


def test_route_nodes(spark):
    nodes = spark.createDataFrame([("Route", "r1", '{"http_method": "GET", "path_pattern": "/a/b"}'), ("Route", "r2", '{"path_pattern": "/c"}'), ("File", "f", None)], "label string, node_id string, properties string")
    edges = spark.createDataFrame([("ROUTES_TO", "r1", "h")], "label string, src_id string, dst_id string")
    assert rows(lookup.routes(nodes, edges, spark.createDataFrame([("/b",)], "part string"))) == [("r1", "GET", "/a/b", "h")]


def test_audit_rows_are_appended_once(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([("u", "q1"), ("u", "q2")], "user_id string, query string").write.parquet(source)
    stream = spark.readStream.schema("user_id string, query string").parquet(source)
    for _ in range(2):
        jobs.append_audit(stream, out, f"file://{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(out)) == [("u", "q1"), ("u", "q2")]
