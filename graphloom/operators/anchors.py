"""Evidence for symbols from a task's text, its history, its model ranks and the graph around strong evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions import text as T
from graphloom.session import checkpointed
from graphloom.tables import row_rank

#: Most matches of a name that can all be meant, and of a qualified name whose container isn't there.
EXPLICIT_MOST, FALLBACK_MOST = 8, 3
USAGE_POOL, IMPACT_LEAST, IMPACT_ROOTS = 60, 0.9, 5
#: Literals of a task's roots in all, the part of the pool that may quote one, and signs of the shortest path of a route.
LITERALS, LITERAL_SHARE, ROUTE_LEAST = 40, 4, 4


def references_of(tasks: DataFrame) -> DataFrame:
    """(task_id, container, name): qualified references and bare identifiers of task texts; a name written qualified isn't also bare."""
    q = tasks.select("task_id", F.explode(T.qualified_references(F.col("text"))).alias("r")).withColumn("p", F.split(F.regexp_replace("r", "[.:]+", "."), "[.]"))
    qualified = q.select("task_id", F.try_element_at("p", F.lit(-2)).alias("container"), F.element_at("p", -1).alias("name"))
    bare = tasks.select("task_id", F.explode(T.tokens(F.col("text"))).alias("name")).where(T.looks_like_identifier(F.col("name")))
    bare = bare.join(qualified.select("task_id", "name").distinct(), ["task_id", "name"], "left_anti").select("task_id", F.lit(None).cast("string").alias("container"), "name")
    return qualified.unionByName(bare).where(T.is_content(T.lower(F.col("name")))).distinct()


def explicit(tasks: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((task_id, symbol_id, strength) of names that were meant, the same of names too common to be).

    A name of n symbols gives 1/sqrt(n); members count half where a declaring symbol has the name too. A container in
    front of the name picks its members; without any, more than three matches are a guess. Names of more than eight symbols
    are narrowed by folder and file words of the text, else they only corroborate, with 1/log2(2 + n).
    """
    refs = references_of(tasks).withColumn("ref", F.xxhash64("container", "name"))
    segments = F.split(F.split("symbol_id", "#")[0], "::")
    path_words = T.split_identifier(F.regexp_replace(F.regexp_replace(F.coalesce("file_id", F.lit("")), r"^[^:]*:", ""), r"\.[^./]*$", ""))
    s = symbols.select("name", "symbol_id", F.lower("kind").isin(S.DECLARING_KINDS).alias("declares"), F.try_element_at(segments, F.lit(-2)).alias("inside"), path_words.alias("words"))
    m = refs.join(s, "name").join(tasks.select("task_id", T.content_tokens(F.col("text")).alias("hints")), "task_id")
    m = m.withColumn("inside_it", F.col("container").isNotNull() & (F.col("inside") == F.col("container")))
    m = m.withColumn("hinted", F.arrays_overlap(F.array_except("hints", F.concat(T.split_identifier(F.col("name")), F.array(F.lower("name")))), "words"))
    m = checkpointed(m.select("task_id", "symbol_id", "ref", "container", "declares", "inside_it", "hinted"))  # read twice by each result
    n = m.groupBy("task_id", "ref").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("inside_it"), 1)).alias("n_in"), F.count(F.when(F.col("hinted"), 1)).alias("n_hint"), F.max("declares").alias("any"), F.max(F.col("declares") & F.col("inside_it")).alias("any_in"), F.max(F.col("declares") & F.col("hinted")).alias("any_hint"))
    x = m.join(n, ["task_id", "ref"])
    x = x.where(F.when(F.col("container").isNull(), True).when(F.col("n_in") > 0, F.col("inside_it")).otherwise(F.col("n") <= FALLBACK_MOST))
    size = F.when(F.col("n_in") > 0, F.col("n_in")).otherwise(F.col("n"))
    few_hints = (F.col("n_hint") > 0) & (F.col("n_hint") <= EXPLICIT_MOST)
    meant = (size <= EXPLICIT_MOST) | (few_hints & F.col("hinted"))
    count = F.when(size <= EXPLICIT_MOST, size).otherwise(F.col("n_hint"))
    declared = F.when(size > EXPLICIT_MOST, F.col("any_hint")).when(F.col("n_in") > 0, F.col("any_in")).otherwise(F.col("any"))
    scale = F.when(declared & ~F.col("declares"), 0.5).otherwise(1.0)
    best = x.where(meant).groupBy("task_id", "symbol_id").agg(F.max(F.round(scale / F.sqrt(count), 6)).alias("strength"))
    generic = x.where(~meant & ~few_hints).groupBy("task_id", "symbol_id").agg(F.max(F.round(scale / F.log2(2 + size), 6)).alias("strength"))
    return best, generic.join(best, ["task_id", "symbol_id"], "left_anti")


def usage(mentions: DataFrame, task_words: DataFrame) -> DataFrame:
    """(task_id, symbol_id, strength): symbols whose text holds code fragments of the task; rarer fragments say more.

    ``mentions``: (word, symbol_id, n); fragments combine as independent evidence, up to the cap.
    """
    cap = S.SOURCE_CAP["usage"]
    strength = cap * F.sqrt(1 - F.col("n") / USAGE_POOL)
    found = task_words.distinct().join(mentions, "word").groupBy("task_id", "symbol_id").agg(F.sum(F.log(1 - strength)).alias("l"))
    return found.select("task_id", "symbol_id", F.round(F.least(1 - F.exp("l"), F.lit(cap)), 6).alias("strength"))


def path(mentions: DataFrame, file_hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, symbol_id, strength): symbols of files a text names; a name of n <= 4 files gives 0.85 / n.

    Of several suffixes that lead to a file the longest counts.
    """
    hits = mentions.select("task_id", F.lower("path").alias("suffix")).distinct().join(file_hits.where("n <= 4"), "suffix")
    best = hits.groupBy("task_id", "file_id").agg(F.max(F.struct(F.length("suffix").alias("l"), (-F.col("n")).alias("m"))).alias("b"))
    return best.join(symbols.select("file_id", "symbol_id"), "file_id").groupBy("task_id", "symbol_id").agg(F.max(F.round(S.SOURCE_CAP["path"] / -F.col("b.m"), 6)).alias("strength"))


def history(task_files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, symbol_id, strength): all symbols of the files that earlier work on the task touched."""
    return task_files.select("task_id", "file_id").distinct().join(symbols.select("file_id", "symbol_id"), "file_id").select("task_id", "symbol_id", F.lit(S.SOURCE_CAP["history"]).alias("strength")).distinct()


def semantic(ranks: DataFrame, scale: int = S.SEMANTIC_RANK_SCALE) -> DataFrame:
    """(task_id, symbol_id, strength) by the model's rank; tests keep their rank but give no evidence."""
    kept = ranks.where((F.col("semantic_rank") >= 0) & ~F.coalesce("is_test", F.lit(False)))
    return kept.select("task_id", "symbol_id", F.round(S.SOURCE_CAP["semantic"] / (1 + F.col("semantic_rank") / scale), 6).alias("strength"))


def impact(strong: DataFrame, edges: DataFrame, symbols: DataFrame, pool: int = USAGE_POOL) -> DataFrame:
    """(task_id, symbol_id, strength): users of the strongest symbols of a task, unless there are too many of them.

    ``strong``: (task_id, symbol_id, strength); roots have at least 0.9, five a task. A root's users are counted before
    they are joined, so that hubs never expand.
    """
    roots = strong.where(F.col("strength") >= IMPACT_LEAST).select("task_id", "symbol_id", "strength", row_rank(["task_id"], [F.col("strength").desc(), F.col("symbol_id")])).where(F.col("rank") <= IMPACT_ROOTS)
    users = edges.where(F.col("label").isin("CALLS", "REFERENCES") & (F.col("src_id") != F.col("dst_id"))).select(F.col("dst_id").alias("symbol_id"), F.col("src_id").alias("user_id"))
    users = users.join(roots.select("symbol_id").distinct(), "symbol_id", "left_semi").distinct()
    users = users.join(symbols.where(~F.col("is_test")).select(F.col("symbol_id").alias("user_id")), "user_id", "left_semi")
    counted = users.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < pool)
    few = roots.join(counted, "symbol_id").withColumn("s", S.SOURCE_CAP["impact"] * F.col("strength") * F.sqrt(1 - F.col("n") / pool))
    hit = few.join(users, "symbol_id").groupBy("task_id", F.col("user_id").alias("symbol_id")).agg(F.sum(F.log(1 - F.col("s"))).alias("l"))
    return hit.select("task_id", "symbol_id", F.round(F.least(1 - F.exp("l"), F.lit(S.SOURCE_CAP["impact"])), 6).alias("strength"))


def shared_literals(strong: DataFrame, symbols: DataFrame, mentions, pool: int = USAGE_POOL) -> DataFrame:
    """(task_id, symbol_id, strength): symbols that quote a namespaced literal of one of a task's strongest symbols.

    The first twelve literals of each of the five roots, the stronger root's first, forty a task; one that only a single symbol
    quotes couples nothing, one that a quarter of ``pool`` or more quote is a convention. ``mentions``: the look-up of
    literals in symbols, (symbols, literals, limit) to (literal, symbol_id, n).
    """
    limit = max(2, -(-pool // LITERAL_SHARE))
    roots = strong.where(F.col("strength") >= IMPACT_LEAST).select("task_id", "symbol_id", "strength", row_rank(["task_id"], [F.col("strength").desc(), F.col("symbol_id")])).where(F.col("rank") <= IMPACT_ROOTS)
    own = roots.join(symbols.select("symbol_id", T.body_literals(F.col("body")).alias("l")), "symbol_id").select("task_id", F.col("symbol_id").alias("root_id"), "strength", "rank", F.posexplode("l").alias("p", "literal"))
    first = own.groupBy("task_id", "literal").agg(F.min(F.struct("rank", "p", "strength", "root_id")).alias("f")).select("task_id", "literal", "f.*")
    kept = first.select("*", row_rank(["task_id"], [F.col("rank"), F.col("p")], "k")).where(F.col("k") <= LITERALS)
    found = mentions(symbols, kept.select("literal").distinct(), limit).where("n > 1")
    hit = kept.join(found, "literal").where(F.col("symbol_id") != F.col("root_id"))
    s = S.SOURCE_CAP["impact"] * F.col("strength") * F.sqrt(1 - F.col("n") / limit)
    total = hit.groupBy("task_id", "symbol_id").agg(F.sum(F.log(1 - s)).alias("l"))
    return total.select("task_id", "symbol_id", F.round(F.least(1 - F.exp("l"), F.lit(S.SOURCE_CAP["impact"])), 6).alias("strength"))


def corroborated(generic: DataFrame, found: DataFrame) -> DataFrame:
    """(task_id, symbol_id, strength) of names too common to be meant that another source names too; they count as source ``name``."""
    return generic.join(found.select("task_id", "symbol_id").distinct(), ["task_id", "symbol_id"], "left_semi")


def route(tasks: DataFrame, routes: DataFrame) -> DataFrame:
    """(task_id, symbol_id, strength): handlers of routes (path, handler_id) that hold a path of a text, in whole segments, at full strength.

    Every run of a route's segments is a key, so that paths are found by equality; a single short segment is no path.
    """
    text = T.without_urls(F.col("text"))
    named = tasks.select("task_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[\s\"'`(])((?:/[A-Za-z0-9_{}:-]+)+)"), F.lit(1)))).alias("part")).where(F.length("part") >= ROUTE_LEAST)
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(i, F.size(parts)), lambda j: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, j - i + 1), "/")))))
    keys = routes.where(F.col("handler_id").isNotNull() & (F.size(parts) > 0)).select(F.col("handler_id").alias("symbol_id"), F.explode(F.array_distinct(runs)).alias("part"))
    return named.join(keys, "part").select("task_id", "symbol_id", F.lit(1.0).alias("strength")).distinct()


def noisy_or(evidence: DataFrame) -> DataFrame:
    """(task_id, symbol_id, strength, sources): sources folded as independent evidence, in their fixed order.

    ``evidence``: (task_id, symbol_id, source, strength); each is limited to its source's cap and the result is rounded
    after every step, so the order is part of the definition. A symbol has at most one row a source here: the largest.
    """
    order = {s: i for i, s in enumerate(S.SOURCE_CAP)}
    number = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    cap = F.create_map(*[F.lit(x) for kv in S.SOURCE_CAP.items() for x in kv])
    per = evidence.groupBy("task_id", "symbol_id", "source").agg(F.max("strength").alias("s"))
    per = per.select("task_id", "symbol_id", F.struct(number[F.col("source")].alias("o"), F.greatest(F.least("s", cap[F.col("source")]), F.lit(0.0)).alias("s"), "source").alias("e"))
    folded = per.groupBy("task_id", "symbol_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return folded.select("task_id", "symbol_id", F.aggregate("e", F.lit(0.0), lambda p, x: F.round(1 - (1 - p) * (1 - x["s"]), 6)).alias("strength"), F.transform("e", lambda x: x["source"]).alias("sources"))
