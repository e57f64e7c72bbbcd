"""Traversals of the property graph: typed neighbours, degrees, bounded walks, closures, blast radius."""

from __future__ import annotations

from functools import reduce

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.heavy_keys import heavy_keys, salted_join
from graphloom.session import checkpointed, checkpointed_by
from graphloom.tables import row_rank

#: Directions of a typed neighbour join: edge labels, the side that is given, the side that is found.
DIRECTIONS = {
    "callers": (["CALLS"], "dst_id", "src_id"),
    "callees": (["CALLS"], "src_id", "dst_id"),
    "referrers": (["REFERENCES"], "dst_id", "src_id"),
    "references": (["REFERENCES"], "src_id", "dst_id"),
    "supertypes": (["INHERITS", "IMPLEMENTS"], "src_id", "dst_id"),
    "subtypes": (["INHERITS", "IMPLEMENTS"], "dst_id", "src_id"),
}


def neighbours(edges: DataFrame, symbols: DataFrame, direction: str, ids: DataFrame | None = None) -> DataFrame:
    """(symbol_id, neighbour_id, label, name, file_id, line, provenance, ref_kind) of one typed hop.

    All symbols, or those of ``ids`` (column symbol_id). Edges to nodes that are gone don't exist. Empty inputs give an
    empty result; a self-loop is its own neighbour.
    """
    labels, given, found = DIRECTIONS[direction]
    hop = edges.where(F.col("label").isin(labels)).select(F.col(given).alias("symbol_id"), F.col(found).alias("neighbour_id"), "label", "provenance", "ref_kind")
    if ids is not None:
        hop = salted_join(hop, ids.select("symbol_id").distinct(), "symbol_id", ["neighbour_id"], "left_semi")
    node = symbols.select(F.col("symbol_id").alias("neighbour_id"), "name", "file_id", "line")
    return salted_join(hop, node, "neighbour_id", ["symbol_id"]).select("symbol_id", "neighbour_id", "label", "name", "file_id", "line", "provenance", "ref_kind")


def find_references(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, caller_id, edge_type, caller_line, call_line): calls, references and routes that lead to each symbol."""
    used = edges.where(F.col("label").isin("CALLS", "REFERENCES", "ROUTES_TO")).select(F.col("dst_id").alias("symbol_id"), F.col("src_id").alias("caller_id"), F.col("label").alias("edge_type"), F.col("line").alias("call_line"))
    caller = symbols.select(F.col("symbol_id").alias("caller_id"), F.col("line").alias("caller_line"))
    kept = used.join(caller, "caller_id", "left").where(F.col("caller_line").isNotNull() | (F.col("edge_type") == "ROUTES_TO"))
    return kept.select("symbol_id", "caller_id", "edge_type", "caller_line", "call_line")


def degrees(edges: DataFrame) -> DataFrame:
    """(symbol_id, degree, n_in, n_out): edge ends at each node over all labels; a self-loop counts twice.

    Ends are counted map-side before they are shuffled, so hubs cost one row per partition.
    """
    ends = F.explode(F.array(F.struct(F.col("src_id").alias("symbol_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_id").alias("symbol_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("e")).groupBy("e.symbol_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def leaf_flags(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, has_callers, has_callees, is_leaf): a leaf is called and calls nothing."""
    calls = edges.where(F.col("label") == "CALLS")
    ends = F.explode(F.array(F.struct(F.col("src_id").alias("symbol_id"), F.lit(True).alias("calls"), F.lit(False).alias("called")), F.struct(F.col("dst_id").alias("symbol_id"), F.lit(False).alias("calls"), F.lit(True).alias("called"))))
    flags = calls.select(ends.alias("e")).groupBy("e.symbol_id").agg(F.max("e.called").alias("c"), F.max("e.calls").alias("k"))
    out = symbols.select("symbol_id").join(flags, "symbol_id", "left")
    called, calling = F.coalesce("c", F.lit(False)), F.coalesce("k", F.lit(False))
    return out.select("symbol_id", called.alias("has_callers"), calling.alias("has_callees"), (called & ~calling).alias("is_leaf"))


def walk(edges: DataFrame, roots: DataFrame, hops: int, steps: list[tuple[str, str, str]], keep: int | None = None) -> DataFrame:
    """(root_id, symbol_id, depth, via): breadth-first walk of every root at once, each node at its least depth.

    ``steps``: (edge label, given side, found side) in order of preference; the first step, then the least source, names
    ``via`` of a node. A hub's edges are cut into salted shares, and only its rows of the frontier are repeated. Depth by depth the frontier is joined with the edges and anti-joined with what was visited; each
    depth is written to the shared folder, so the plan doesn't grow. ``keep`` cuts a root's frontier to its first ids. Roots
    themselves aren't part of the result.
    """
    visited = roots.select(F.col("symbol_id").alias("root_id"), "symbol_id").distinct().withColumn("depth", F.lit(0)).withColumn("via", F.lit(None).cast("string"))
    frontier = visited
    hop = reduce(DataFrame.unionByName, [edges.where(F.col("label") == l).select(F.col(a).alias("symbol_id"), F.col(b).alias("next_id"), F.lit(f"{i}{l}").alias("step")) for i, (l, a, b) in enumerate(steps)])
    hop = checkpointed(hop)
    heavy = heavy_keys(hop, "symbol_id")
    for depth in range(1, hops + 1):
        reached = salted_join(hop, frontier.select("root_id", "symbol_id"), "symbol_id", ["next_id"], heavy=heavy).groupBy("root_id", F.col("next_id").alias("symbol_id")).agg(F.min("step").alias("step"))
        fresh = reached.join(visited.select("root_id", "symbol_id"), ["root_id", "symbol_id"], "left_anti")
        fresh = fresh.select("root_id", "symbol_id", F.lit(depth).alias("depth"), F.substring("step", 2, 100).alias("via"))
        if keep:
            fresh = fresh.select("*", row_rank(["root_id"], [F.col("symbol_id")], "_r")).where(F.col("_r") <= keep).drop("_r")
        frontier = checkpointed(fresh)
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    return visited.where("depth > 0")


def call_graph(edges: DataFrame, roots: DataFrame, hops: int, direction: str = "callers") -> DataFrame:
    """(root_id, symbol_id, depth): who calls each root, or what it calls, within ``hops``."""
    up, down = ("CALLS", "dst_id", "src_id"), ("CALLS", "src_id", "dst_id")
    return walk(edges, roots, hops, {"callers": [up], "callees": [down], "both": [up, down]}[direction]).select("root_id", "symbol_id", "depth")


def blast_radius(edges: DataFrame, roots: DataFrame, levels: int = 3) -> DataFrame:
    """(root_id, symbol_id, depth, edge_type): what a change of each root may reach, over calls, references and subtypes."""
    steps = [("CALLS", "dst_id", "src_id"), ("REFERENCES", "dst_id", "src_id"), ("INHERITS", "dst_id", "src_id"), ("IMPLEMENTS", "dst_id", "src_id")]
    return walk(edges, roots, levels, steps).withColumnRenamed("via", "edge_type")


def closure(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): all nodes that each root reaches over (src, dst) links, by least depth, to a fixpoint.

    Each round checkpoints its frontier; rounds end when it is empty. What was visited is checkpointed every 16
    rounds, so that the plan stays small.
    """
    visited = roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0))
    frontier = visited
    pairs = checkpointed(links.select("src", "dst").distinct())
    heavy = heavy_keys(pairs, "src")
    for depth in count(1):
        reached = salted_join(pairs, frontier.select("root", F.col("node").alias("src")), "src", ["dst"], heavy=heavy).select("root", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(reached.join(visited.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % 16 == 0:
            visited = checkpointed(visited)
    return visited.where("depth > 0")


def ppr(nodes: DataFrame, links: DataFrame, iterations: int = 3, restart: float = 0.5) -> DataFrame:
    """(task_id, symbol_id, mass): personalised PageRank over each task's undirected walked graph.

    ``nodes``: (task_id, symbol_id, seed); ``links``: (task_id, a, b). Mass restarts in proportion to the seeds; nodes
    without links keep theirs. Sums are rounded to 12 decimals each round, so their order doesn't matter.
    """
    total = nodes.groupBy("task_id").agg(F.sum("seed").alias("_t"))
    base = nodes.join(total, "task_id").select("task_id", "symbol_id", F.round(F.coalesce(F.try_divide("seed", "_t"), F.lit(0.0)), 12).alias("p"))
    base = checkpointed_by(base, "task_id")  # every round reads both again, a task's rows where they are
    both = links.where("a <> b").select("task_id", "a", "b").unionByName(links.where("a <> b").select("task_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = both.join(base.select("task_id", F.col("symbol_id").alias("a")), ["task_id", "a"], "left_semi").join(base.select("task_id", F.col("symbol_id").alias("b")), ["task_id", "b"], "left_semi")
    both = checkpointed_by(both.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("task_id", "a"))), "task_id")
    mass = base.withColumn("mass", F.col("p"))
    for _ in range(iterations):
        flow = both.join(mass.select("task_id", F.col("symbol_id").alias("a"), "mass"), ["task_id", "a"]).groupBy("task_id", F.col("b").alias("symbol_id")).agg(F.sum(F.round(F.col("mass") / F.col("k"), 12)).alias("f"))
        mass = base.join(flow, ["task_id", "symbol_id"], "left").select("task_id", "symbol_id", "p", F.round(restart * F.col("p") + (1 - restart) * F.coalesce("f", F.lit(0.0)), 12).alias("mass"))
    return mass.select("task_id", "symbol_id", "mass")


def mass_factors(mass: DataFrame, evidence: DataFrame, gain: float = 0.25, least: float = 2 / 3, most: float = 1.5) -> DataFrame:
    """(task_id, symbol_id, factor): how much more mass a candidate gets than its best path says, against the task's median.

    ``evidence``: (task_id, symbol_id, strength) of candidates that are no anchors. The upper median of the positive ratios is
    1; each doubling adds ``gain``; without mass the factor is ``least``. Tasks without any positive ratio have none.
    """
    x = checkpointed_by(evidence.where(F.col("strength") > 0).join(mass, ["task_id", "symbol_id"]).withColumn("r", F.col("mass") / F.col("strength")), "task_id")
    order = x.where("r > 0").select("task_id", "r", row_rank(["task_id"], [F.col("r"), F.col("symbol_id")], "k"))
    half = order.groupBy("task_id").agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("k"))
    median = order.join(half, ["task_id", "k"]).select("task_id", F.col("r").alias("m"))
    factor = F.when(F.col("r") > 0, F.least(F.greatest(1 + gain * F.log2(F.col("r") / F.col("m")), F.lit(least)), F.lit(most))).otherwise(F.lit(least))
    return x.join(median, "task_id").select("task_id", "symbol_id", F.round(factor, 6).alias("factor"))
