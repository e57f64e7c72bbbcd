"""One ranking from several differently scaled scores: weighted Borda counts over competition ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.heavy_keys import heavy_keys, salted_pair
from graphloom.operators.ordering import ranked, running_sum
from graphloom.session import checkpointed
from graphloom.tables import latest

#: Scores of a candidate and whether the greater value is the better one.
SCORES = {"degree": True, "task_signal": True, "graph_distance": False, "anchor_strength": True}


def candidates(df: DataFrame, scores: dict[str, bool] = SCORES) -> DataFrame:
    """One row per (task_id, symbol_id), the one retrieved last; rows without a task or a symbol are no candidates."""
    rows = df.where(F.col("task_id").isNotNull() & F.col("symbol_id").isNotNull())
    return latest(rows, ["task_id", "symbol_id"], "retrieved_at", list(scores))


def _value(score: str, greater: bool) -> Column:
    x = F.col(score).cast("double")
    x = F.when(F.isnan(x), None).otherwise(x)
    x = F.when(x == 0, F.lit(0.0)).otherwise(x)  # one zero
    return x if greater else -x


def score_ranks(rows: DataFrame, scores: dict[str, bool] = SCORES) -> DataFrame:
    """(task_id, symbol_id, score, value, better, tied, present): per score, how many candidates of the task are
    strictly better, share the value, have a value. Only values that are there have a row; NaN and null are missing.

    Equal values are counted before anything is ordered, and the order is a range partitioning. Candidates get their
    counts back in a join on (task, score, value) in which a value that many rows share is cut into salted shares. So neither
    a task with a third of all rows nor a value shared by most of them meets in one task.
    """
    long = rows.select(
        "task_id", "symbol_id", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), _value(s, g).alias("value")) for s, g in scores.items()])).alias("x")
    ).select("task_id", "symbol_id", "x.score", "x.value").where(F.col("value").isNotNull())
    key = ["task_id", "score", "value"]
    counts = long.groupBy(*key).agg(F.count(F.lit(1)).alias("tied"))
    ordered = running_sum(counts, ["task_id", "score"], [F.col("value").desc()], "tied", "better", "present")
    left, right = salted_pair(long.withColumn("_k", F.xxhash64(*key)), ordered.withColumn("_k", F.xxhash64(*key)), "_k", ["symbol_id"])
    return left.join(right, ["_k", "_salt", *key]).drop("_k", "_salt")


def borda(df: DataFrame, weights: dict[str, float] | None = None, scores: dict[str, bool] = SCORES, within: int = 5) -> DataFrame:
    """(task_id, symbol_id, points, leads, rank): the candidates of each task in one ranking.

    With m present values of a score, the value of averaged rank r earns m - r points and a missing one the points of
    the middle rank, (m - 1) / 2; points are summed under ``weights`` (1 each by default). Equal points are ordered by
    symbol_id. A score that nobody has earns nobody points; an empty table gives an empty ranking. ``leads``: on how many
    scores the candidate has a value and fewer than ``within`` of its task are strictly better.
    """
    w = {s: float((weights or {}).get(s, 1.0)) for s in scores}
    weight = F.create_map(*[F.lit(x) for kv in w.items() for x in kv])
    rows = checkpointed(candidates(df, scores))
    ranks = score_ranks(rows, scores)
    earned = weight[F.col("score")] * (F.col("present") - (F.col("better") + (F.col("tied") + 1) / 2))
    valued = ranks.select("task_id", "symbol_id", earned.alias("points"), (F.col("better") < within).cast("int").alias("leads"), F.lit(None).cast("array<string>").alias("missing"))
    missing = F.array_compact(F.array(*[F.when(_value(s, g).isNull(), F.lit(s)) for s, g in scores.items()]))
    every = valued.unionByName(rows.select("task_id", "symbol_id", F.lit(0.0).alias("points"), F.lit(0).alias("leads"), missing.alias("missing")))
    summed = every.groupBy("task_id", "symbol_id").agg(F.sum("points").alias("points"), F.sum("leads").cast("int").alias("leads"), F.max("missing").alias("missing"))
    half = {n: w[n] * F.greatest((F.count(_value(n, g)) - 1) / 2, F.lit(0.0)) for n, g in scores.items()}  # counted map-side, one row a task
    middle = rows.groupBy("task_id").agg(F.create_map(*[x for n, v in half.items() for x in (F.lit(n), v)]).alias("middle"))
    left, right = salted_pair(summed, middle, "task_id", ["symbol_id"], heavy_keys(rows, "task_id"))
    lacking = F.aggregate("missing", F.lit(0.0), lambda total, s: total + F.coalesce(F.try_element_at("middle", s), F.lit(0.0)))
    total = left.join(right, ["task_id", "_salt"], "left").select("task_id", "symbol_id", F.round(F.col("points") + lacking, 6).alias("points"), "leads")
    return ranked(total, ["task_id"], [F.col("points").desc(), F.col("symbol_id")])


def leaders(df: DataFrame, within: int = 5, scores: dict[str, bool] = SCORES) -> DataFrame:
    """(task_id, symbol_id) of the ranking's candidates that lead on every score: none missing, fewer than ``within`` better ones."""
    return borda(df, scores=scores, within=within).where(F.col("leads") == len(scores)).select("task_id", "symbol_id")
