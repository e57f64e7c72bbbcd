"""From anchors to candidates: bounded walks with decaying evidence, neighbours in the file, parallel files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.operators.candidates import is_container
from graphloom.operators.graph import DIRECTIONS, mass_factors, ppr
from graphloom.operators.heavy_keys import salted_join
from graphloom.session import checkpointed, checkpointed_by
from graphloom.tables import row_rank

ROOT_LEAST, ROOTS, SIBLING_LEAST, SIBLINGS, FILE_SCALE = 0.3, 20, 0.7, 12, 0.8


def roots(anchors: DataFrame) -> DataFrame:
    """The anchors that are walked from: at least 0.3, the 20 strongest of a task."""
    x = anchors.where(F.col("strength") >= ROOT_LEAST).select("task_id", "symbol_id", "strength")
    return x.select("*", row_rank(["task_id"], [F.col("strength").desc(), F.col("symbol_id")])).where(F.col("rank") <= ROOTS).drop("rank")


#: Directions of the walk by the number of their rule; callers of callers are rule 2.
RULES = {1: "callers", 3: "callees", 4: "referrers", 5: "references", 6: "supertypes", 7: "subtypes"}


def _hops(frontier: DataFrame, edges: DataFrame, rules: list[int], decay: float = S.HOP_DECAY) -> DataFrame:
    """(task_id, symbol_id, rule, strength, ref_kind, provenance): one hop in all directions at once; the first parent by id gives the evidence."""
    steps = []
    for rule in rules:
        labels, given, found = DIRECTIONS[RULES[rule]]
        steps.append(F.when(F.col("label").isin(labels), F.struct(F.lit(rule).alias("rule"), F.col(given).alias("symbol_id"), F.col(found).alias("next_id"))))
    hop = edges.select(F.explode(F.array_compact(F.array(*steps))).alias("x"), "ref_kind", "provenance").select("x.*", "ref_kind", "provenance")
    reached = salted_join(hop, frontier.select("task_id", "symbol_id", "strength"), "symbol_id", ["next_id"])
    first = F.min(F.struct("symbol_id", F.col("strength").alias("s"), "ref_kind", "provenance")).alias("f")
    return reached.groupBy("task_id", F.col("next_id").alias("symbol_id"), "rule").agg(first).select("task_id", "symbol_id", "rule", F.round(F.col("f.s") * decay, 6).alias("strength"), F.col("f.ref_kind").alias("ref_kind"), F.col("f.provenance").alias("provenance"))


def siblings(walked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, symbol_id, strength): the 12 symbols nearest by line in the file of a strong anchor that is no container."""
    s = symbols.select("symbol_id", "file_id", "line", "kind")
    strong = walked.where(F.col("strength") >= SIBLING_LEAST).join(s, "symbol_id").where(~is_container(F.col("kind"))).select("task_id", F.col("symbol_id").alias("anchor_id"), "strength", "file_id", F.coalesce("line", F.lit(0)).alias("at"))
    inside = s.where(F.col("file_id").isNotNull()).select("symbol_id", "file_id", F.coalesce("line", F.lit(0)).alias("line"))
    near = salted_join(inside, strong, "file_id", ["symbol_id"]).where(F.col("symbol_id") != F.col("anchor_id"))
    ranked = near.select("*", row_rank(["task_id", "anchor_id"], [F.abs(F.col("line") - F.col("at")), F.col("symbol_id")])).where(F.col("rank") <= SIBLINGS)
    return ranked.groupBy("task_id", "symbol_id").agg(F.max(F.round(F.col("strength") * S.HOP_DECAY, 6)).alias("strength"))


def sibling_files(walked: DataFrame, symbols: DataFrame, folder_most: int = 60, family_most: int = 8, files_most: int = 24, symbols_most: int = 6) -> DataFrame:
    """(task_id, symbol_id, strength, rule): symbols of files that go with a strong anchor's file without an edge.

    Rule family: the same name without its first word, in few files; rule folder: the same folder and a shared name
    word. Files of anchors and tests are none; the first rule that names a file counts. Containers first, then by line.
    """
    name = F.regexp_replace(F.element_at(F.split("file_id", "[:/]"), -1), r"\.[^.]*$", "")
    from graphloom.functions import text as T

    parts = T.split_identifier(name)
    files = symbols.where(F.col("file_id").isNotNull()).select("file_id").distinct()
    files = files.select("file_id", T.directory(F.col("file_id")).alias("folder"), parts.alias("parts")).withColumn("family", F.concat_ws("_", F.slice("parts", 2, 20)))
    anchor = walked.where(F.col("strength") >= SIBLING_LEAST).join(symbols.select("symbol_id", "file_id"), "symbol_id").groupBy("task_id", "file_id").agg(F.max("strength").alias("strength")).join(files, "file_id")
    other = files.where(~T.is_test_path(F.regexp_replace("file_id", r"^[^:]*:", ""))).select(F.col("file_id").alias("other"), F.col("folder").alias("o_folder"), F.col("parts").alias("o_parts"), F.col("family").alias("o_family"))
    small = other.groupBy("o_family").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") <= family_most) & (F.col("o_family") != "")).select("o_family")
    flat = other.groupBy("o_folder").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= folder_most).select("o_folder")
    by_family = anchor.join(other.join(small, "o_family"), F.col("family") == F.col("o_family")).select("task_id", "other", "strength", F.lit("1:family").alias("rule"), "file_id")
    by_folder = anchor.join(other.join(flat, "o_folder"), (F.col("folder") == F.col("o_folder")) & F.arrays_overlap("parts", "o_parts")).select("task_id", "other", "strength", F.lit("2:folder").alias("rule"), "file_id")
    named = by_family.unionByName(by_folder).where(F.col("other") != F.col("file_id")).join(anchor.select("task_id", F.col("file_id").alias("other")), ["task_id", "other"], "left_anti")
    first = named.groupBy("task_id", "other").agg(F.min(F.struct("rule", (-F.col("strength")).alias("s"))).alias("f"))
    chosen = first.select("task_id", F.col("other").alias("file_id"), (-F.col("f.s")).alias("strength"), F.substring("f.rule", 3, 20).alias("rule"))
    chosen = chosen.select("*", row_rank(["task_id"], [F.col("strength").desc(), F.col("file_id")])).where(F.col("rank") <= files_most).drop("rank")
    inside = chosen.join(symbols.select("symbol_id", "file_id", "kind", "line"), "file_id")
    inside = inside.select("*", row_rank(["task_id", "file_id"], [(~is_container(F.col("kind"))).cast("int"), F.coalesce("line", F.lit(0)), F.col("symbol_id")])).where(F.col("rank") <= symbols_most)
    return inside.groupBy("task_id", "symbol_id").agg(F.max(F.round(F.col("strength") * S.HOP_DECAY * FILE_SCALE, 6)).alias("strength"), F.min("rule").alias("rule"))


def expanded(anchors: DataFrame, edges: DataFrame, symbols: DataFrame, with_files: bool = True) -> DataFrame:
    """(task_id, symbol_id, distance, is_anchor, anchor_strength, source_strength, ref_kind, provenance) of all candidates.

    Callers two hops, everything else one. A node keeps its least distance, its strongest evidence, and the kind and
    provenance of the first rule that has them (calls in, calls out, references in and out, hierarchy, file, parallel files).
    """
    walked = checkpointed(roots(anchors))
    none, seen = F.lit(None).cast("string"), walked.select("task_id", "symbol_id")
    near = _hops(walked, edges, list(RULES))
    near = checkpointed(near.join(seen.withColumn("_w", F.lit(True)), ["task_id", "symbol_id"], "left").where((F.col("rule") != 1) | F.col("_w").isNull()).drop("_w"))
    first = near.where("rule = 1")
    second = _hops(first, edges, [1]).join(seen.unionByName(first.select("task_id", "symbol_id")), ["task_id", "symbol_id"], "left_anti")
    rules = [
        (0, anchors.select("task_id", "symbol_id", "strength", none.alias("ref_kind"), none.alias("provenance")), 0),
        (None, near.withColumn("ref_kind", F.when(F.col("rule") == 4, F.col("ref_kind"))), 1), (2, second.withColumn("ref_kind", none), 2),
        (8, siblings(walked, symbols).select("*", none.alias("ref_kind"), none.alias("provenance")), 1),
    ]
    if with_files:
        rules.append((9, sibling_files(walked, symbols).select("task_id", "symbol_id", "strength", none.alias("ref_kind"), F.concat(F.lit("sibling_file:"), "rule").alias("provenance")), 1))
    all_rows = reduce(DataFrame.unionByName, [df.select("task_id", "symbol_id", "strength", "ref_kind", "provenance", (F.col("rule") if o is None else F.lit(o)).alias("rule"), F.lit(d).alias("distance")) for o, df, d in rules])
    x = all_rows.groupBy("task_id", "symbol_id").agg(
        F.min("distance").alias("distance"), F.max(F.col("rule") == 0).alias("is_anchor"), F.max(F.when(F.col("rule") == 0, F.col("strength")).otherwise(0.0)).alias("anchor_strength"), F.max("strength").alias("source_strength"),
        F.min(F.when(F.col("ref_kind").isNotNull(), F.struct("rule", "ref_kind"))).alias("k"), F.min(F.struct("rule", "provenance")).alias("p"),
    )
    live = x.join(symbols.select("symbol_id"), "symbol_id", "left_semi")
    return live.select("task_id", "symbol_id", "distance", "is_anchor", "anchor_strength", "source_strength", F.col("k.ref_kind").alias("ref_kind"), F.col("p.provenance").alias("provenance"))


def by_mass(pool: DataFrame, anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """``pool`` (see ``expanded``) with the evidence of its neighbours scaled by the mass that the walked anchors send them.

    The walked graph holds the edges between an anchor that is walked from and other candidates of its task. Anchors keep their
    strength, evidence stays at most 1.
    """
    walked = roots(anchors)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_id").alias("symbol_id"), F.col("dst_id").alias("b")), F.struct(F.col("dst_id").alias("symbol_id"), F.col("src_id").alias("b")))).alias("x")).select("x.*")  # ``ppr`` counts each link once
    links = salted_join(ends, walked.select("task_id", "symbol_id"), "symbol_id", ["b"]).join(pool.select("task_id", F.col("symbol_id").alias("b")), ["task_id", "b"], "left_semi")
    nodes = pool.select("task_id", "symbol_id").join(walked, ["task_id", "symbol_id"], "left").select("task_id", "symbol_id", F.coalesce("strength", F.lit(0.0)).alias("seed"))
    mass = ppr(nodes, checkpointed_by(links.select("task_id", F.col("symbol_id").alias("a"), "b"), "task_id"))
    factors = mass_factors(mass, pool.where(~F.col("is_anchor")).select("task_id", "symbol_id", F.col("source_strength").alias("strength")))
    scaled = F.round(F.least(F.col("source_strength") * F.coalesce("factor", F.lit(1.0)), F.lit(1.0)), 6)
    return pool.join(factors, ["task_id", "symbol_id"], "left").withColumn("source_strength", scaled).drop("factor")


def symbol_features(symbols: DataFrame, degree: DataFrame, leaf: DataFrame, churn: DataFrame) -> DataFrame:
    """(symbol_id, kind, file_id, is_test, degree, is_leaf, churn, whole, parts): what a candidate has from its symbol, whatever the task.

    Columns ``owner``, ``member_prefix`` and ``file_no`` are kept where ``symbols`` has them. Files without history have churn 0.
    """
    from graphloom.functions import text as T

    own = [c for c in ("owner", "member_prefix", "file_no") if c in symbols.columns]
    s = symbols.select("symbol_id", "kind", "file_id", "is_test", *own, T.lower(F.col("name")).alias("whole"), T.name_parts(F.col("name")).alias("parts"))
    x = s.join(degree.select("symbol_id", "degree"), "symbol_id", "left").join(leaf.select("symbol_id", "is_leaf"), "symbol_id", "left").join(churn.select("file_id", "churn"), "file_id", "left")
    return x.withColumns({"degree": F.coalesce("degree", F.lit(0)), "churn": F.coalesce("churn", F.lit(0))})


def featured(found: DataFrame, features: DataFrame, tasks: DataFrame, ranks: DataFrame) -> DataFrame:
    """Expanded symbols with all features of a candidate, ready for scoring: those of the symbol (``symbol_features``), those of
    the task (task_id, words) and the model's rank (task_id, symbol_id, semantic_rank)."""
    from graphloom.functions import text as T

    x = found.join(features, "symbol_id").join(tasks.select("task_id", "words"), "task_id")
    x = x.withColumn("task_signal", T.parts_signal(F.col("whole"), F.col("parts"), F.col("words"))).drop("whole", "parts", "words")  # texts end here
    return x.join(ranks, ["task_id", "symbol_id"], "left").withColumnsRenamed({"distance": "graph_distance"})
