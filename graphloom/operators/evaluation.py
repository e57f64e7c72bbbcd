"""Retrieval quality: recall, precision, reciprocal rank, cuts at K, comparisons, where truths were lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(returned: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(task_id, k, hits, recall, precision, f1, reciprocal_rank, hit) of each task with a truth.

    ``returned``: (task_id, symbol_id, rank) from 1; ``truth``: (task_id, symbol_id). A shorter cut of a K-monotonic list is its
    prefix. A task that returned nothing scores 0.
    """
    spark = returned.sparkSession
    t = truth.select("task_id", "symbol_id").distinct()
    size = t.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_truth"))
    cut = size.join(F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int")))  # one row per K
    found = returned.join(t, ["task_id", "symbol_id"], "left_semi").groupBy("task_id").agg(F.sort_array(F.collect_list("rank")).alias("at"))
    shown = returned.groupBy("task_id").agg(F.max("rank").alias("n"))
    x = cut.join(found, "task_id", "left").join(shown, "task_id", "left")
    at = F.filter(F.coalesce("at", F.array().cast("array<int>")), lambda r: r <= F.col("k"))
    x = x.withColumn("hits", F.size(at)).withColumn("first", F.when(F.size(at) > 0, F.element_at(at, 1)))
    precision = F.coalesce(F.try_divide("hits", F.least("k", F.coalesce("n", F.lit(0)))), F.lit(0.0))
    recall = F.col("hits") / F.col("n_truth")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return x.select("task_id", "k", "hits", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), (F.col("hits") > 0).alias("hit"))


def summary(per_task: DataFrame) -> DataFrame:
    """Means per K over the tasks."""
    return per_task.groupBy("k").agg(F.count(F.lit(1)).alias("n_tasks"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "f1", "reciprocal_rank")], F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


def win_tie_loss(a: DataFrame, b: DataFrame, measure: str = "recall") -> DataFrame:
    """(k, wins, ties, losses) of system a against b, task by task."""
    x = a.select("task_id", "k", F.col(measure).alias("x")).join(b.select("task_id", "k", F.col(measure).alias("y")), ["task_id", "k"])
    return x.groupBy("k").agg(F.count(F.when(F.col("x") > F.col("y"), 1)).alias("wins"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("ties"), F.count(F.when(F.col("x") < F.col("y"), 1)).alias("losses"))


def truth_stages(truth: DataFrame, pool: DataFrame, returned: DataFrame) -> DataFrame:
    """(channel, returned, narrowed_out, not_reached): where the true symbols ended, by the channel that found them.

    ``pool``: (task_id, symbol_id, channel) with one channel a symbol.
    """
    x = truth.select("task_id", "symbol_id").distinct().join(pool.select("task_id", "symbol_id", "channel"), ["task_id", "symbol_id"], "left").join(returned.select("task_id", "symbol_id").withColumn("_r", F.lit(True)), ["task_id", "symbol_id"], "left")
    stage = F.when(F.col("_r"), "returned").when(F.col("channel").isNotNull(), "narrowed_out").otherwise("not_reached")
    stages = ["returned", "narrowed_out", "not_reached"]
    return x.groupBy(F.coalesce("channel", F.lit("none")).alias("channel")).agg(*[F.count(F.when(stage == s, 1)).alias(s) for s in stages])


def clean_text(text):
    """A change request's text without zero-width signs and Markdown escapes."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\u200b-\u200f\u2060\ufeff]", ""), r"\\([\\`*_{}\[\]()#+.!>~|-])", "$1"))


def task_variants(specs: DataFrame) -> DataFrame:
    """(spec_id, variant, text): each change request (spec_id, title, description) with its description and by its title alone."""
    title, rest = clean_text(F.coalesce("title", F.lit(""))), clean_text(F.coalesce("description", F.lit("")))
    both = F.array(F.struct(F.lit("full").alias("variant"), F.concat_ws("\n\n", F.nullif(title, F.lit("")), F.nullif(rest, F.lit(""))).alias("text")), F.struct(F.lit("title").alias("variant"), title.alias("text")))
    return specs.select("spec_id", F.explode(both).alias("v")).select("spec_id", "v.variant", "v.text").where(F.length("text") > 0)


def text_bucket(identifiers):
    """Whether a task's text names code or is prose only."""
    return F.when(F.size(F.coalesce(identifiers, F.array().cast("array<string>"))) > 0, "names_code").otherwise("prose_only")


def replayed(stored: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Metrics of stored answers (task_id, symbol_ids in order), scored anew without retrieving again."""
    ranked = stored.select("task_id", F.posexplode("symbol_ids").alias("p", "symbol_id")).groupBy("task_id", "symbol_id").agg((F.min("p") + 1).alias("rank"))
    return metrics(ranked, truth, ks)


def nearest_rank(values, share: float):
    """The value at the rounded rank of a percentile of a sorted array, halves to even."""
    return F.element_at(values, (F.bround(F.lit(share) * (F.size(values) - 1), 0) + 1).cast("int"))
