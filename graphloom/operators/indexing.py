"""State of the index: churn, census, coverage, merges of snapshots, job states, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.tables import latest, row_rank


def churn(changes: DataFrame, commits: DataFrame, window: int = 500) -> DataFrame:
    """(file_id, repo_id, commits): commits of a repository's last ``window`` that touched each file; a count window, not one of time.

    ``changes``: (repo_id, commit_id, file_id); ``commits``: (repo_id, commit_id, seq).
    """
    last = commits.groupBy("repo_id").agg(F.max("seq").alias("top"))
    recent = commits.join(last, "repo_id").where(F.col("seq") > F.col("top") - window).select("repo_id", "commit_id").distinct()
    return changes.distinct().join(recent, ["repo_id", "commit_id"], "left_semi").groupBy("file_id", "repo_id").agg(F.count_distinct("commit_id").alias("commits"))


def filled_churn(counts: DataFrame, files: DataFrame) -> DataFrame:
    """Every indexed file with its count; absent ones are 0, so stale counts go down."""
    return files.select("file_id").distinct().join(counts.select("file_id", "commits"), "file_id", "left").select("file_id", F.coalesce("commits", F.lit(0)).alias("churn"))


def census(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, language, files, indexed, symbols): how much of each repository the index holds.

    ``files``: (file_id, repo_id, language), once per file; a file is indexed when it has a symbol.
    """
    per = symbols.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    x = files.groupBy("file_id").agg(F.max(F.struct("repo_id", "language")).alias("f")).select("file_id", "f.*").join(per, "file_id", "left")
    return x.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"), F.count("n").alias("indexed"), F.sum(F.coalesce("n", F.lit(0))).alias("symbols"))


def index_coverage(counts: DataFrame) -> DataFrame:
    """(repo_id, files, indexed, ratio, status, weakest): share of indexed files; below 0.2 unsupported, below 0.95 partial.

    ``weakest``: the language that misses most files among those with at least 2 % of the files and less than half indexed.
    """
    total = counts.groupBy("repo_id").agg(F.sum("files").alias("files"), F.sum("indexed").alias("indexed"))
    ratio = F.round(F.coalesce(F.try_divide("indexed", "files"), F.lit(0.0)), 4)
    poor = counts.join(total.select("repo_id", F.col("files").alias("all")), "repo_id").where((F.col("files") >= 0.02 * F.col("all")) & (F.col("indexed") < 0.5 * F.col("files")))
    worst = poor.groupBy("repo_id").agg(F.min(F.struct((F.col("indexed") - F.col("files")).alias("m"), "language")).alias("w")).select("repo_id", F.col("w.language").alias("weakest"))
    return total.withColumn("ratio", ratio).withColumn("status", F.when(F.col("ratio") < 0.2, "unsupported").when(F.col("ratio") < 0.95, "partial").otherwise("full")).join(worst, "repo_id", "left")


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A snapshot with the rows of ``new`` in place of those of equal key; later rows of ``new`` must be folded before."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def without_files(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """A snapshot without everything that belongs to the files of ``gone`` (file_id)."""
    return rows.join(gone.select("file_id").distinct(), "file_id", "left_anti")


def job_states(log: DataFrame) -> DataFrame:
    """The latest recorded state of each run; a finished state is final, so later rows of it don't reopen a run."""
    final = F.col("status").isin("succeeded", "failed", "cancelled")
    rows = log.withColumn("_o", F.struct(final.cast("int"), F.when(final, -F.unix_micros(F.col("recorded_at").cast("timestamp"))).otherwise(F.unix_micros(F.col("recorded_at").cast("timestamp")))))
    return latest(rows, ["run_id"], "_o", ["status", "repo_id", "started_at", "finished_at", "recorded_at"]).drop("_o")


def claimable(states: DataFrame) -> DataFrame:
    """The oldest running run of each repository that has none finished after it: the next one to take up again."""
    done = states.where(F.col("status") == "succeeded").groupBy("repo_id").agg(F.max("started_at").alias("done_at"))
    open_runs = states.where(F.col("status") == "running").join(done, "repo_id", "left").where(F.col("done_at").isNull() | (F.col("started_at") > F.col("done_at")))
    return open_runs.select("repo_id", "run_id", "started_at", row_rank(["repo_id"], [F.col("started_at"), F.col("run_id")])).where(F.col("rank") == 1).drop("rank")
