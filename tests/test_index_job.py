from graphloom.operators import index_job as J
from graphloom.sources.versioned import VersionedTable

FILE = "repo_id string, path string, source binary, scanned_at timestamp_ntz, digest int"
STORE = b"class Store:\n    def load(self, key):\n        return self.find(key)\n\n    def find(self, key):\n        return key\n"
USE = b"from store import fetch\n\n\ndef run(x):\n    return fetch(x)\n"


def state(table):
    rows = table.rows().drop("_file", "_pos")
    nodes = {(r["label"], r["node_id"].split("#")[0]) for r in J.nodes(rows).collect()}
    edges = {(r["label"], r["src_id"].split("#")[0], r["dst_id"].split("#")[0], r["provenance"]) for r in J.edges(rows).collect()}
    return nodes, edges


def test_full_then_incremental_equals_full(spark, tmp_path, at):
    table = VersionedTable(spark, f"file://{tmp_path}/a")
    first = [("r", "store.py", STORE, at(1), 0), ("r", "./use.py", USE, at(1), 0), ("r", "old.py", b"def gone():\n    pass\n", at(1), 0), ("r", "bad.py", b"def (", at(1), 0), (None, "x.py", b"", at(1), 0), ("r", "empty.py", None, None, 0)]
    J.index(table, spark.createDataFrame(first, FILE))
    nodes, edges = state(table)
    assert ("File", "r:store.py") in nodes and ("Symbol", "python::old::::gone") in nodes and ("File", "r:bad.py") in nodes and ("File", "r:empty.py") in nodes
    assert any(label == "CALLS" and "load" in a and "find" in b and p == "treesitter" for label, a, b, p in edges)
    assert J.index(table, spark.createDataFrame(first, FILE)).version == 1
    second = [first[0], ("r", "use.py", USE, at(1), 0), ("r", "store.py", STORE + b"\n\ndef fetch(key):\n    return key\n", at(2), 0), ("r", "bad.py", b"def (", at(1), 0), ("r", "empty.py", None, None, 0)]
    J.index(table, spark.createDataFrame(second, FILE))
    whole = VersionedTable(spark, f"file://{tmp_path}/b")
    J.index(whole, spark.createDataFrame(second, FILE))
    assert table.version() == 2 and state(table) == state(whole)
    assert not any("gone" in n for _, n in state(table)[0])


def test_only_changed_files_are_parsed(spark, tmp_path, at):
    seen = f"{tmp_path}/seen"

    def provider(repo, path, text):
        with open(seen, "a") as f:
            f.write(path + "\n")
        yield "file", f"{repo}:{path}", None, None, {"path": path}

    table = VersionedTable(spark, f"file://{tmp_path}/c")
    rows = [("r", f"f{i}.py", b"x = 1\n", at(1), 0) for i in range(5)]
    J.index(table, spark.createDataFrame(rows, FILE), {"python": provider})
    open(seen, "w").close()
    J.index(table, spark.createDataFrame([*rows[:4], ("r", "f4.py", b"x = 2\n", at(2), 0)], FILE), {"python": provider})
    assert set(open(seen).read().split()) == {"f4.py"}
