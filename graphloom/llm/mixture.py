"""Mixing sources to target weights: exact block quotas, split at random over output shards."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.tokens import token_counts
from graphloom.operators.ordering import ranked, running_sum
from graphloom.session import checkpointed, slots

#: Blocks of an output shard: more make the shards more alike.
SHARD_BLOCKS = 64
SEED = 20240229


def source_name(text: Column) -> Column:
    """One spelling of a source: lower case, underscores, no blanks around."""
    return F.regexp_replace(F.lower(F.trim(text)), "[-\\s]+", "_")


def plan(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[int, int]]:
    """Per source (full passes, tokens of the last, partial pass) of the largest mixture that the repeat caps allow.

    The mixture holds T tokens, T the least of max_repeats * available / share over all sources with a share and text.
    Shares of sources without any text can't be met; the others keep their proportions. Targets of 0 get nothing.
    """
    usable = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and totals.get(s, 0) > 0}
    weight = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    size = min(cap * totals[s] * weight / share for s, (share, cap) in usable.items())
    out = {}
    for s, (share, cap) in usable.items():
        quota = min(round(size * share / weight), cap * totals[s])
        out[s] = divmod(quota, totals[s])
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts that add up to ``quotas``: a tree of multivariate hypergeometric draws.

    Each node hands a random, exactly sized share of its blocks to its left half, drawn without replacement.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        first, n, q = stack.pop()
        if n == 1:
            out[first] = q
            continue
        left = n // 2
        take = int(q.sum()) * left // n
        drawn = rng.multivariate_hypergeometric(q, take, method="marginals") if take else np.zeros_like(q)
        stack += [(first, left, drawn), (first + left, n - left, q - drawn)]
    return out


def _sized(documents: DataFrame, **tokenizer) -> DataFrame:
    docs = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where(F.col("source").isNotNull())
    return checkpointed(token_counts(docs, ["doc_id", "source"], **tokenizer).where(F.col("n_tokens") > 0))


def mixture(documents: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = SEED, **tokenizer) -> DataFrame:
    """(shard, position, doc_id, copy, source, n_tokens): the records of the mixture in their output order.

    Sources are compared in one spelling; a null source, one without target, and texts without tokens are left out. Each
    full pass takes every document of its source once; the last pass takes whole permuted blocks and cuts one block at
    the document nearest to the quota, so a share is exact to a document. ``copy`` runs from 1 to at most the
    source's max_repeats. Repeated doc_ids are separate records. The same seed gives the same mixture.

    ``targets`` is configuration: one row per source. Totals per source and the table of blocks (``SHARD_BLOCKS`` per
    shard) are all that the driver holds; a source with a third of all rows is spread over its blocks.
    """
    spark = documents.sparkSession
    shards = shards or slots(spark)
    sized = _sized(documents, **tokenizer)
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect() if r["source"] and r["target_share"] is not None}
    totals = {r["source"]: r["t"] for r in sized.where(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    passes = plan(totals, wanted)
    size = sum(full * totals[s] + rest for s, (full, rest) in passes.items())
    block_size = max(1, size // (shards * SHARD_BLOCKS))
    rows = [(s, c + 1, max(1, math.ceil(totals[s] / block_size)), None if c < full else rest) for s, (full, rest) in passes.items() for c in range(full + (rest > 0))]
    passes_df = spark.createDataFrame(rows, "source string, copy int, n_blocks bigint, quota bigint")
    # The block of a document is a hash of it: blocks are random permuted slices of their source, disjoint by nature.
    key = F.xxhash64("doc_id", "copy", F.lit(seed))
    taken = sized.join(F.broadcast(passes_df), "source").withColumn("block", F.pmod(key, F.col("n_blocks")))  # one row per source and pass
    partial = taken.where(F.col("quota").isNotNull())
    blocks = partial.groupBy("source", "copy", "quota", "block").agg(F.sum("n_tokens").alias("t"))
    cut = running_sum(blocks, ["source", "copy"], [F.col("block")], "t")
    whole = cut.where(F.col("before") + F.col("t") <= F.col("quota")).select("source", "copy", "block")
    broken = cut.where((F.col("before") < F.col("quota")) & (F.col("before") + F.col("t") > F.col("quota"))).select("source", "copy", "block", "before")
    edge = running_sum(partial.join(broken, ["source", "copy", "block"]), ["source", "copy"], [F.xxhash64("doc_id", F.lit(seed + 1)), F.col("doc_id"), F.col("n_tokens")], "n_tokens", "inside")
    nearest = F.abs(F.col("quota") - F.col("before") - F.col("inside")) > F.abs(F.col("quota") - F.col("before") - F.col("inside") - F.col("n_tokens"))
    columns = ["source", "copy", "block", "doc_id", "n_tokens"]
    chosen = (
        taken.where(F.col("quota").isNull()).select(*columns)
        .unionByName(partial.join(whole, ["source", "copy", "block"]).select(*columns))
        .unionByName(edge.where(nearest).select(*columns))
    )
    full_blocks = [(s, c, b) for s, c, n, quota in rows if quota is None for b in range(n)]
    last_blocks = [(r["source"], r["copy"], r["block"]) for r in whole.unionByName(broken.select("source", "copy", "block")).collect()]  # at most SHARD_BLOCKS * shards rows
    place = spark.createDataFrame(_places(sorted(full_blocks + last_blocks), shards, seed), T.StructType([T.StructField("source", T.StringType()), T.StructField("copy", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType())]))
    placed = chosen.join(F.broadcast(place), ["source", "copy", "block"]).drop("block")  # as many rows as blocks
    order = [F.xxhash64("doc_id", "copy", "shard", F.lit(seed + 2)), F.col("doc_id"), F.col("copy"), F.col("n_tokens")]
    return ranked(placed, ["shard"], order, "position").select("shard", "position", "doc_id", "copy", "source", "n_tokens")


def _places(blocks: list[tuple], shards: int, seed: int) -> list[tuple]:
    """(source, copy, block, shard): each source's blocks, permuted, dealt out by the splitting tree."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[tuple]] = {}
    for b in blocks:
        by.setdefault(b[0], []).append(b)
    names = sorted(by)
    counts = split_quotas(np.array([len(by[s]) for s in names]), shards, rng) if names else np.zeros((shards, 0), int)
    out = []
    for i, s in enumerate(names):
        own = [by[s][j] for j in rng.permutation(len(by[s]))]
        shard = np.repeat(np.arange(shards), counts[:, i])
        out += [(*b, int(k)) for b, k in zip(own, shard)]
    return out


def shares(documents: DataFrame, targets: DataFrame, seed: int = SEED, **tokenizer) -> DataFrame:
    """(source, target_share, max_repeats, n_records, n_documents, most_copies, taken_tokens, actual_share) per target."""
    mixed = mixture(documents, targets, seed=seed, **tokenizer)
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    got = per_doc.groupBy("source").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_documents"), F.max("n").alias("most_copies"), F.sum("t").alias("taken_tokens"))
    total = got.agg(F.sum("taken_tokens").alias("_total"))
    names = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = names.join(got, "source", "left").fillna(0, ["n_records", "n_documents", "most_copies", "taken_tokens"])
    return out.join(F.broadcast(total)).withColumn("actual_share", F.round(F.coalesce(F.try_divide("taken_tokens", "_total"), F.lit(0.0)), 6)).drop("_total")  # one row
