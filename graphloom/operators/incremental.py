"""Exactly the records that are new or changed since the successful runs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import scratch_path
from graphloom.sources.versioned import Manifest, VersionedTable, list_files, positions, vectors_of
from graphloom.tables import latest

#: Hexadecimal signs of a shortened commit.
SHORT = 12
KEY = ["repo_id", "kind", "ref_id", "chunk"]


def succeeded_ranges(runs: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, from_seq, to_seq, started_at) of runs whose latest recorded state is a success.

    Commits may be written whole or shortened to 12 signs. A null ``from_commit`` is the beginning; a run whose commits aren't known
    covers nothing. Repeated rows fold into one state.
    """
    state = latest(runs, ["run_id"], "recorded_at", ["status", "repo_id", "from_commit", "to_commit", "started_at"]).where(F.col("status") == "succeeded")
    names = F.explode(F.array_distinct(F.array("commit_id", F.substring("commit_id", 1, SHORT)))).alias("c")
    at = commits.select("repo_id", "seq", names).groupBy("repo_id", "c").agg(F.min("seq").alias("seq"))
    start = at.select("repo_id", F.col("c").alias("from_commit"), F.col("seq").alias("from_seq"))
    end = at.select("repo_id", F.col("c").alias("to_commit"), F.col("seq").alias("to_seq"))
    return (
        state.join(end, ["repo_id", "to_commit"]).join(start, ["repo_id", "from_commit"], "left")
        .where(F.col("from_commit").isNull() | F.col("from_seq").isNotNull())
        .select("repo_id", F.coalesce("from_seq", F.lit(0)).alias("from_seq"), "to_seq", "started_at")
    )


def covered_until(ranges: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, commit_id, seq, covered_until): the latest start of a successful run whose range holds the commit.

    Ranges are cut into dyadic blocks, at most two a level, and a commit looks its blocks up; so neither long ranges nor
    many runs of one repository meet in a task.
    """

    def levels(top):  # numbers start at 1, so no block above the highest bit is ever needed
        return F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(top, F.lit(1)))).cast("int"))).alias("level")

    cut = ranges.select("repo_id", "started_at", (F.col("from_seq") + 1).cast("bigint").alias("a"), (F.col("to_seq") + 1).cast("bigint").alias("b"), levels(F.col("to_seq") + 1))
    size = F.expr("shiftleft(1L, level)")
    l, r = F.ceil(F.col("a") / size), F.floor(F.col("b") / size)
    blocks = (
        cut.withColumn("l", l).withColumn("r", r).where("l < r")
        .select("repo_id", "started_at", "level", F.explode(F.array_compact(F.array(F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("r") % 2 == 1, F.col("r") - 1)))).alias("block"))
        .groupBy("repo_id", "level", "block").agg(F.max("started_at").alias("started_at"))
    )
    known = commits.groupBy("repo_id", "commit_id").agg(F.min("seq").alias("seq"))
    looked = known.select("repo_id", "commit_id", "seq", levels(F.col("seq"))).withColumn("block", F.expr("shiftright(CAST(seq AS BIGINT), level)"))
    return looked.join(blocks, ["repo_id", "level", "block"], "left").groupBy("repo_id", "commit_id", "seq").agg(F.max("started_at").alias("covered_until"))


def _fingerprints(until: DataFrame) -> DataFrame:
    """(repo_id, print): what the successful runs of a repository cover, in one number."""
    return until.groupBy("repo_id").agg(F.sum(F.xxhash64("_commit", "_until").cast("decimal(38,0)")).cast("string").alias("print"))


def _written(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def advance(table: VersionedTable, chunks_path: str, runs: DataFrame, commits: DataFrame) -> Manifest:
    """Brings the state of ``table`` up to the files of ``chunks_path`` and the run log, in one commit.

    A version adopts the files and hides, by deletion vectors, every record that no successful run covers; beside it stand the
    newest covered record of each key and a fingerprint of what the runs cover per repository. Only added files are
    read, and of kept files only the records of repositories whose coverage changed (a filter on ``repo_id`` that reaches the
    scan). Removed files make everything be read anew. Nothing added and nothing changed: no new version.
    """
    spark, base = table.spark, table.manifest()
    files = list_files(spark, chunks_path)
    if set(base.files) - set(files):
        base = Manifest(base.version)
    until = covered_until(succeeded_ranges(runs, commits), commits).select("repo_id", F.col("commit_id").alias("_commit"), F.col("seq").alias("_seq"), F.col("covered_until").alias("_until"))
    prints = _fingerprints(until)
    folder = f"{table.root}/state/{uuid.uuid4().hex}"
    added, known = sorted(set(files) - set(base.files)), bool(base.state)
    if known:
        before = spark.read.parquet(base.state["prints"]).withColumnRenamed("print", "_print")
        changed = prints.join(before, "repo_id", "full").where(~F.col("print").eqNullSafe(F.col("_print"))).select("repo_id")
        changed = spark.read.parquet(_written(changed, f"{folder}/changed"))
        if not added and changed.isEmpty():
            return base
    like = spark.read.parquet(chunks_path).schema
    rows = lambda names: positions(spark.read.schema(like).parquet(*names))
    fresh = [rows(added)] if added else []
    if known and base.files:
        fresh.append(rows(base.files).join(changed, "repo_id", "left_semi"))
    columns = [*KEY, "indexed_at_commit", "queued_at", "pending_id", "content", "_file", "_pos"]
    marks = reduce(DataFrame.unionByName, [f.select(*columns) for f in fresh]).join(until.withColumnRenamed("_commit", "indexed_at_commit"), ["repo_id", "indexed_at_commit"], "left")
    seen = F.coalesce(F.col("queued_at") < F.col("_until"), F.lit(False))
    newest = marks.where(seen).select(*KEY, F.struct("_seq", "queued_at", "pending_id", "content").alias("c"))
    hidden = vectors_of(marks.where(~seen), "repo_id")
    if known:
        newest = newest.unionByName(spark.read.parquet(base.state["newest"]).join(changed, "repo_id", "left_anti"))
        hidden = hidden.unionByName(spark.read.parquet(*base.vectors).join(changed, "repo_id", "left_anti"))
    vectors = _written(hidden, f"{table.root}/vectors/{uuid.uuid4().hex}")
    state = {"newest": _written(newest.groupBy(*KEY).agg(F.max("c").alias("c")), f"{folder}/newest"), "prints": _written(prints, f"{folder}/prints")}
    return table.commit(Manifest(base.version + 1, files, [vectors], state=state))


def pending_records(table: VersionedTable, chunks_path: str, runs: DataFrame, commits: DataFrame) -> DataFrame:
    """The pending records that no successful run covers, without versions equal to the key's covered content.

    ``table`` keeps the state between runs (see ``advance``). The diff of its newest manifest with one that hides nothing gives
    the uncovered records, read from the files that hold one; the newest covered content of each key then drops versions
    without any change. Repeated rows stay repeated rows of the same ``pending_id``; unknown commits are covered by no
    run; null keys compare as equal.
    """
    spark = table.spark
    if not list_files(spark, chunks_path):
        return spark.read.parquet(chunks_path)
    now = advance(table, chunks_path, runs, commits)
    delta = table.changes(now, Manifest(now.version, now.files)).where(F.col("_change") == "insert").drop("_change", "_file", "_pos")
    newest = spark.read.parquet(now.state["newest"]).select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("c.content").alias("_content"), F.lit(True).alias("_known"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    joined = delta.join(newest, same[0] & same[1] & same[2] & same[3], "left")
    unchanged = F.coalesce(F.col("_known"), F.lit(False)) & F.col("content").eqNullSafe(F.col("_content"))
    return joined.where(~unchanged).drop(*[f"_{k}" for k in KEY], "_content", "_known")


def run(root: str, chunks_path: str, runs: DataFrame, commits: DataFrame) -> VersionedTable:
    """One incremental run below ``root``: brings the state up to date and commits the pending records together with the state
    version they are from, so a run that fails anywhere is repeated and a finished one is never repeated.

    The newest version of the returned table holds the result. If nothing changed since its commit, nothing is read.
    """
    spark = runs.sparkSession
    table, output = VersionedTable(spark, f"{root}/state"), VersionedTable(spark, f"{root}/output")
    base = output.manifest()
    found = pending_records(table, chunks_path, runs, commits)
    version = table.version()
    if base.version == 0 or base.processed.get("pending") != version:
        output.replace(found, {"pending": version}, base.version)
    return output


def new_or_changed(spark: SparkSession, chunks_path: str, runs: DataFrame, commits: DataFrame) -> DataFrame:
    """The pending records of a first run, whose state lies in a fresh folder; a job that goes on keeps its own (see ``run``)."""
    output = run(scratch_path(spark, "pending"), chunks_path, runs, commits)
    if not output.manifest().files:
        return spark.read.parquet(chunks_path).limit(0)
    return output.rows().drop("_file", "_pos")
