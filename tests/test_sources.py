import json

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import linking, search, vector
from graphloom.sources import parse, scan
from graphloom.sources.versioned import VersionedTable
from graphloom.streaming import jobs


def value(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return df.select(expression.alias("x")).first()["x"]


def test_text_functions(spark):
    text = "The `runTask` helper in src/app/main.py breaks; see https://a.b/c.js and Job.cancel or HTTPServer2"
    assert value(spark, T.tokens(F.col("t")), t="a bb a https://x.y/zz c1") == ["a", "bb", "c1"]
    assert value(spark, T.split_identifier(F.col("t")), t="parseHTTPHeader_v2") == ["parse", "http", "header", "v2"]
    assert value(spark, T.file_mentions(F.col("t")), t=text) == ["src/app/main.py"]
    assert value(spark, T.qualified_references(F.col("t")), t=text) == ["main.py", "Job.cancel"]
    assert value(spark, T.phrase_terms(F.col("t")), t="the access token, access token") == ["access token"]
    assert value(spark, T.content_tokens(F.col("t")), t=None) is None
    assert value(spark, T.body_literals(F.col("t")), t="x('queue-key', \"plain\", 'a.b')") == ["queue-key"]
    assert value(spark, T.test_basenames(F.col("t")), t="a/store.ts") == ["store.test.ts", "store.test.tsx", "store.spec.ts", "store.spec.tsx"]
    assert value(spark, T.test_basenames(F.col("t")), t="tests/test_a.py") == []
    assert value(spark, T.path_tails(F.col("t")), t="A/b/c.py") == ["c.py", "b/c.py", "a/b/c.py"]


def test_windows_overlap_and_cover(spark):
    text = "\n".join(f"line {i} " + "x" * 40 for i in range(200))
    parts = scan.text_windows(text)
    assert len(parts) > 2 and all(p in text for p in parts) and text.endswith(parts[-1])
    assert scan.text_windows("") == [] and scan.text_windows(None) == [] and len(scan.text_windows("x" * 100_000)) == 12


def test_unified_diff():
    diff = "--- a/x.py\n+++ b/x.py\n@@ -10,3 +10,4 @@ f\n@@ -40,2 +41 @@\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,9 @@\n--- a/y.py\n+++ b/y.py\n@@ -5 +5 @@\n@@ -7,0 +8,2 @@\n"
    assert scan.diff_ranges(diff) == [("x.py", 10, 12), ("x.py", 40, 41), ("y.py", 5, 5), ("y.py", 7, 8)]
    assert scan.diff_ranges(None) == []


def test_scan_of_a_tree(spark, tmp_path):
    for p in ("src/a.py", "src/b.txt", "node_modules/c.js", "d.GO"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    got = sorted((r["file_id"], r["language"]) for r in scan.source_files(spark, str(tmp_path), "r").select("file_id", "language").collect())
    assert got == [("r:d.GO", "go"), ("r:src/a.py", "python")]


def test_snapshot_changes(spark):
    a = spark.createDataFrame([("x", b"1"), ("y", b"2"), ("z", b"3")], "file_id string, source binary")
    b = spark.createDataFrame([("x", b"1"), ("y", b"9"), ("w", b"3")], "file_id string, source binary")
    assert sorted(map(tuple, scan.snapshot_changes(a, b).collect())) == [("A", "w"), ("D", "z"), ("M", "y")]


PY = b'''import os
from .util import helper as h

LIMIT = 3

# NOTE: keep it small
class Job(Base):
    """A job."""
    def run(self):
        return self.stop(LIMIT)
    def stop(self, n):
        return h(n)

@app.get("/jobs")
def jobs():
    return Job()
'''


def test_python_fragments(spark):
    files = spark.createDataFrame([("r", "pkg/m.py", PY), ("r", "bad.py", b"def ("), ("r", "x.unknown", None), ("r", None, b"")], "repo_id string, path string, source binary")
    rows = parse.fragments(files).collect()
    kinds = sorted((json.loads(r["properties"])["kind"], json.loads(r["properties"])["name"]) for r in rows if r["record"] == "symbol")
    assert kinds == [("class", "Job"), ("constant", "LIMIT"), ("function", "jobs"), ("method", "run"), ("method", "stop")]
    edges = {(r["id"].split("::")[-1].split("#")[0], r["kind"], r["target"].split("::")[-1].split("#")[0]) for r in rows if r["record"] == "edge"}
    assert edges == {("run", "CALLS", "stop"), ("run", "REFERENCES", "LIMIT"), ("jobs", "CALLS", "Job"), ("jobs", "REFERENCES", "Job")}
    assert ("h", "call") in {(r["target"], r["kind"]) for r in rows if r["record"] == "ref"} and ("Base", "inherits") in {(r["target"], r["kind"]) for r in rows if r["record"] == "ref"}
    assert [r["id"] for r in rows if r["record"] == "route"] == ["route:r:GET:/jobs"]
    assert [r["file_id"] for r in rows if r["record"] == "error"] == ["r:bad.py"]
    assert len([r for r in rows if r["record"] == "note"]) == 1


SYM = "symbol_id string, name string, kind string, package string, namespace string, file_id string, line int, end_line int, is_test boolean, search_text string, signature string, docstring string, body string"


def s(i, name, package="a.b", line=1, end=9, file="r:a/b.py", text=""):
    return (i, name, "function", package, "", file, line, end, False, text, "", "", text)


def test_links_prefer_the_named_package_then_suffixes(spark):
    syms = spark.createDataFrame([s("1", "f", "svc.a.b"), s("2", "f", "c.d"), s("3", "f", "a.b")], SYM)
    refs = spark.createDataFrame([(1, "src", "f", "a/b", "call", "c.d"), (2, "src", "f", None, "call", "c.d"), (3, "src", "f", "b", "call", "zz"), (4, "2", "f", None, "call", "c.d"), (5, "src", None, None, "call", "c.d")], "ref_id bigint, src_symbol_id string, name string, qualifier string, kind string, package string")
    assert sorted((r["ref_id"], r["target_id"], r["how"]) for r in linking.link_references(refs, syms).collect()) == [(1, "3", "qualifier"), (2, "2", "package"), (3, "3", "suffix")]


def test_lines_to_symbols(spark):
    syms = spark.createDataFrame([s("outer", "o", line=1, end=20), s("inner", "i", line=5, end=8), s("late", "l", line=30, end=40)], SYM)
    notes = spark.createDataFrame([("n1", "r:a/b.py", 4), ("n2", "r:a/b.py", 99), ("n3", "other", 1)], "note_id string, file_id string, line int")
    assert sorted(map(tuple, linking.nearest_symbol(notes, syms).collect())) == [("n1", "inner"), ("n2", "late")]
    hunks = spark.createDataFrame([(1, "r:a/b.py", 6, 7), (2, "r:a/b.py", 15, 31)], "hunk_id int, file_id string, first int, last int")
    assert sorted(map(tuple, linking.changed_symbols(hunks, syms).collect())) == [(1, "inner"), (2, "late"), (2, "outer")]


def test_term_hits_match_brute_force(spark):
    syms = spark.createDataFrame([s("1", "loadConfig"), s("2", "config_loader"), s("3", "other", text="reads the configuration")], SYM)
    hits = search.term_hits(search.postings(syms), spark.createDataFrame([("config",), ("lo",)], "term string"))
    assert {r["symbol_id"]: r["tier"] for r in hits.collect()} == {"1": "b", "2": "a", "3": "d"}


def test_nearest_handles_nulls_zeros_and_ties(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [0.0, 1.0]), (4, 0, None), (5, 0, [0.0, 0.0])], "ref_id long, chunk long, embedding array<float>")
    got = vector.nearest(rows, spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>"), k=3).orderBy("rank").collect()
    assert [(r["ref_id"], r["distance"]) for r in got] == [(1, 0.0), (2, 0.0), (3, 1.0)]


def test_stream_state_survives_a_repeated_batch(spark, tmp_path, at):
    src = str(tmp_path / "in")
    schema = "run_id long, recorded_at timestamp_ntz, status string"
    spark.createDataFrame([(1, at(1), "running"), (2, at(1), "running")], schema).coalesce(1).write.parquet(src)
    root, check = f"file://{tmp_path}/state", f"{tmp_path}/check"

    def go():
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.stream_states(spark, stream, root, check, ["run_id"], "recorded_at", ["status"]).awaitTermination()
        return sorted((r["run_id"], r["status"]) for r in VersionedTable(spark, root).rows().collect())

    assert go() == [(1, "running"), (2, "running")]
    spark.createDataFrame([(1, at(2), "succeeded"), (2, at(0 + 1, 0), "old")], schema).coalesce(1).write.mode("append").parquet(src)
    assert go() == [(1, "succeeded"), (2, "running")]
    table = VersionedTable(spark, root)
    again = spark.createDataFrame([(1, at(9), "late")], schema)
    assert not jobs.fold_into(table, again, 0, ["run_id"], "recorded_at", ["status"], "stream")
    assert sorted((r["run_id"], r["status"]) for r in table.rows().collect()) == [(1, "succeeded"), (2, "running")]


def test_windows_of_events(spark, at):
    ev = spark.createDataFrame([(1, at(1, 0), "a", 1.0, 7), (2, at(1, 0), "a", 2.0, 7), (3, at(1, 5), "b", 4.0, 7)], "event_id long, ts timestamp_ntz, event_type string, value double, user_id long")
    assert sorted((r["event_type"], r["n"], r["total"]) for r in jobs.windowed_counts(ev).collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    assert jobs.sessions(ev).count() == 2
