import pytest
from pyspark.sql import functions as F

from graphloom.operators import incremental as I
from graphloom.sources.versioned import CommitConflict, VersionedTable, process_new

CHUNK = "pending_id bigint, kind string, ref_id string, content string, repo_id string, indexed_at_commit string, chunk int, queued_at timestamp_ntz"
RUN = "run_id bigint, repo_id string, from_commit string, to_commit string, status string, started_at timestamp_ntz, recorded_at timestamp_ntz"


def commits(spark):
    return spark.createDataFrame([("r", f"{i:08d}commit000", i) for i in range(1, 9)], "repo_id string, commit_id string, seq int")


def c(i):
    return f"{i:08d}commit000"


def pending(spark, tmp_path, chunks, runs):
    path = f"file://{tmp_path}/chunks"
    spark.createDataFrame(chunks, CHUNK).repartition(3).write.mode("overwrite").parquet(path)
    out = I.new_or_changed(spark, path, spark.createDataFrame(runs, RUN), commits(spark))
    return sorted({r["pending_id"] for r in out.collect()})


def test_covered_late_unchanged_and_failed(spark, tmp_path, at):
    runs = [
        (1, "r", None, c(3)[:12], "running", at(10), at(10)), (1, "r", None, c(3)[:12], "succeeded", at(10), at(11)),
        (2, "r", c(3), c(5), "failed", at(12), at(12)),
        (3, "r", c(6), c(7), "succeeded", at(14), at(15)), (3, "r", c(6), c(7), "succeeded", at(14), at(15)),
    ]
    chunks = [
        (1, "symbol", "s", "one", "r", c(2), 0, at(5)),  # covered by run 1
        (2, "symbol", "s", "one", "r", c(4), 0, at(6)),  # the failed run's, but unchanged
        (3, "symbol", "s", "two", "r", c(4), 0, at(6)),  # the failed run's
        (4, "symbol", "t", "x", "r", c(3), 0, at(10)),  # queued when run 1 had started
        (5, "symbol", "u", "x", "r", c(7), 0, at(1)),  # covered by run 3
        (6, "symbol", "u", "y", "r", c(6), 0, at(1)),  # run 3 begins after commit 6
        (7, "file", "u", "x", "r", "unknown", 0, at(1)),
    ]
    assert pending(spark, tmp_path, chunks + chunks[2:3], runs) == [3, 4, 6, 7]
    assert pending(spark, tmp_path, chunks, []) == [1, 2, 3, 4, 5, 6, 7]
    assert pending(spark, tmp_path, [], runs) == []


def test_ranges_by_blocks_match_brute_force(spark, at):
    import random

    rng = random.Random(4)
    ranges = [("r", a, rng.randint(a + 1, 70), at(1 + rng.randint(0, 20))) for a in (rng.randint(0, 60) for _ in range(40))]
    all_commits = spark.createDataFrame([("r", f"c{i}", i) for i in range(1, 71)], "repo_id string, commit_id string, seq int")
    got = {r["seq"]: r["covered_until"] for r in I.covered_until(spark.createDataFrame(ranges, "repo_id string, from_seq int, to_seq int, started_at timestamp_ntz"), all_commits).collect()}
    assert got == {i: max((t for _, a, b, t in ranges if a < i <= b), default=None) for i in range(1, 71)}


def table(spark, tmp_path, name):
    return VersionedTable(spark, f"file://{tmp_path}/{name}")


def numbers(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("x"))


def xs(df):
    return sorted((r["_change"], r["x"]) for r in df.collect())


def test_deltas_of_files_and_vectors(spark, tmp_path):
    t = table(spark, tmp_path, "t")
    t.append(numbers(spark, 0, 5))
    two = t.append(numbers(spark, 5, 8))
    three = t.delete(t.rows().where("x IN (1, 6)"))
    assert xs(t.changes(0)) == [("insert", x) for x in (0, 2, 3, 4, 5, 7)]
    assert xs(t.changes(1, 2)) == [("insert", 5), ("insert", 6), ("insert", 7)]
    assert xs(t.changes(2, 3)) == [("delete", 1), ("delete", 6)]
    assert xs(t.changes(3, 2)) == [("insert", 1), ("insert", 6)]
    assert xs(t.changes(2, 1)) == [("delete", 5), ("delete", 6), ("delete", 7)]
    assert three.files == two.files and sorted(r["x"] for r in t.rows(2).collect()) == list(range(8))


def test_runs_repeat_after_failure_and_never_twice(spark, tmp_path):
    source, target = table(spark, tmp_path, "s"), table(spark, tmp_path, "o")
    source.append(numbers(spark, 0, 4))

    def work(delta):
        return delta.select("x")

    def fails(delta):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_new(source, target, "s", fails)
    assert target.version() == 0
    process_new(source, target, "s", work)
    assert process_new(source, target, "s", work) is None
    source.append(numbers(spark, 4, 6))
    process_new(source, target, "s", work)
    assert sorted(r["x"] for r in target.rows().select("x").collect()) == list(range(6))
    assert target.manifest().processed == {"s": 2}


def test_concurrent_commit_is_refused(spark, tmp_path):
    t = table(spark, tmp_path, "c")
    m = t.append(numbers(spark, 0, 2))
    with pytest.raises(CommitConflict):
        t.append(numbers(spark, 2, 3), expected=m.version - 1)
    assert t.version() == 1


def test_nulls_and_clashing_columns(spark, tmp_path, at):
    rows = [(1, None, None, None, None, None, None, None, 5, at(9), "x"), (2, "file", "a", None, "r", c(1), None, at(1), 5, at(9), "x"), (3, "file", "a", None, "r", c(2), None, at(9), 5, at(9), "x"), (4, "file", "a", "new", "r", c(2), None, at(9), 5, at(9), "x")]
    path = f"file://{tmp_path}/chunks"
    spark.createDataFrame(rows, CHUNK + ", seq int, covered_until timestamp_ntz, level string").write.parquet(path)
    runs = spark.createDataFrame([(1, "r", None, c(1), "succeeded", at(5), at(6)), (2, None, None, None, None, None, None), (3, "r", "nowhere", c(8), "succeeded", at(30), at(30))], RUN)
    out = I.new_or_changed(spark, path, runs, commits(spark))
    assert sorted(r["pending_id"] for r in out.collect()) == [1, 4] and out.columns[-3:] == ["seq", "covered_until", "level"]


def test_a_second_run_reads_only_what_is_new(spark, tmp_path, at):
    """State lies between the runs: added files are marked, repositories whose runs changed are marked anew, else nothing is done."""
    root, path = f"file://{tmp_path}/job", f"file://{tmp_path}/in"
    other = spark.createDataFrame([("q", f"{i:08d}commit000", i) for i in range(1, 9)], "repo_id string, commit_id string, seq int")
    known = commits(spark).unionByName(other)

    def add(*chunks):
        spark.createDataFrame(chunks, CHUNK).coalesce(1).write.mode("append").parquet(path)

    def answer(runs):
        output = I.run(root, path, spark.createDataFrame(runs, RUN), known)
        return sorted({r["pending_id"] for r in output.rows().collect()}), output.version()

    add((1, "file", "a", "x", "r", c(1), 0, at(1)), (2, "file", "b", "x", "q", c(1), 0, at(1)))
    first = [(1, "r", None, c(2), "succeeded", at(5), at(6))]
    assert answer(first) == ([2], 1)
    assert answer(first) == ([2], 1)
    add((3, "file", "a", "y", "r", c(3), 0, at(7)), (4, "file", "a", "x", "r", c(4), 0, at(7)), (5, "file", "a", "x", "r", c(2), 0, at(9)))
    assert answer(first) == ([2, 3], 2)
    second = [*first, (2, "q", None, c(1), "succeeded", at(8), at(9)), (3, "q", c(1), c(2), "running", at(8), at(9))]
    assert answer(second) == ([3], 3)
    assert answer([*second, (4, "r", c(2), c(3), "succeeded", at(10), at(11))]) == ([4, 5], 4)
    table = VersionedTable(spark, f"{root}/state")
    assert [len(table.manifest(v).files) for v in range(1, 5)] == [1, 2, 2, 2]
    whole = I.new_or_changed(spark, path, spark.createDataFrame([*second, (4, "r", c(2), c(3), "succeeded", at(10), at(11))], RUN), known)
    assert sorted(r["pending_id"] for r in whole.collect()) == [4, 5]


def test_a_run_that_dies_before_its_commit_is_repeated(spark, tmp_path, at, monkeypatch):
    root, path = f"file://{tmp_path}/job", f"file://{tmp_path}/in"
    spark.createDataFrame([(1, "file", "a", "x", "r", c(1), 0, at(1)), (2, "file", "b", "x", "r", c(2), 0, at(1))], CHUNK).write.parquet(path)
    runs = spark.createDataFrame([(1, "r", None, c(1), "succeeded", at(5), at(6))], RUN)
    kept = VersionedTable.replace

    def dies(self, *args):
        raise RuntimeError("lost")

    monkeypatch.setattr(VersionedTable, "replace", dies)
    with pytest.raises(RuntimeError):
        I.run(root, path, runs, commits(spark))
    monkeypatch.setattr(VersionedTable, "replace", kept)
    output = I.run(root, path, runs, commits(spark))
    assert [r["pending_id"] for r in output.rows().collect()] == [2] and output.manifest().processed == {"pending": 1}
