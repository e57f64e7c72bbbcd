"""Queries of anchors, expansion, scoring, packing and evaluation, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions import text as T
from graphloom.operators import anchors, candidates, evaluation, expand, graph, indexing, pack, search
from graphloom.plans.graph_queries import _CAND, EDGE, SYM, edge, sym
from graphloom.plans.search_queries import _FILE, _ISSUE, _MENTION, _NAMED, _NOURL, _STOP, _TESTPATH, _W, _low, issues, named_paths, semantic_ranks, terms_of
from graphloom.operators.ordering import numbered
from graphloom.session import checkpointed, checkpointed_by, spread
from graphloom.tables import live_nodes, read, row_rank

K = 20


def cand(spark: SparkSession, d: str) -> DataFrame:
    return candidates.candidate_state(read(spark, d, "candidate"))


def anchors_explicit(spark: SparkSession, d: str) -> DataFrame:
    return anchors.explicit(issues(spark, d), sym(spark, d))[0]


def anchors_usage(spark: SparkSession, d: str) -> DataFrame:
    words = _task_words(issues(spark, d))
    return anchors.usage(search.mentions_of_words(sym(spark, d), words), words)


def _task_words(tasks: DataFrame) -> DataFrame:
    w = tasks.select("task_id", F.explode(T.tokens(F.col("text"))).alias("word"))
    return w.where(T.looks_like_identifier(F.col("word")) & (F.length("word") >= 4)).distinct()


def anchors_path(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of the files that texts and reports name."""
    files = live_nodes(read(spark, d, "graph_node"), "File").select(F.col("node_id").alias("file_id"))
    mentions = named_paths(spark, d)
    return anchors.path(mentions, search.files_by_suffix(files, mentions.select(F.col("path").alias("suffix")).distinct()), sym(spark, d))


def anchors_semantic(spark: SparkSession, d: str) -> DataFrame:
    return anchors.semantic(cand(spark, d))


def anchors_literals(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that quote a literal of a task's strongest anchors."""
    return anchors.shared_literals(_strong(spark, d), sym(spark, d), search.mentions_of_literals)


def _strong(spark: SparkSession, d: str) -> DataFrame:
    return cand(spark, d).where("anchor").select("task_id", "symbol_id", F.coalesce("anchor_strength", F.lit(1.0)).alias("strength"))


def anchors_impact(spark: SparkSession, d: str) -> DataFrame:
    return anchors.impact(_strong(spark, d), edge(spark, d), sym(spark, d))


def anchors_noisy_or(spark: SparkSession, d: str) -> DataFrame:
    """All evidence of the candidate tasks: named anchors, model ranks, users of strong anchors."""
    parts = [("explicit", _strong(spark, d)), ("semantic", anchors_semantic(spark, d)), ("impact", anchors_impact(spark, d))]
    rows = reduce(DataFrame.unionByName, [x.select("task_id", "symbol_id", F.lit(s).alias("source"), "strength") for s, x in parts])
    return anchors.noisy_or(rows).select("task_id", "symbol_id", "strength", F.concat_ws(",", "sources").alias("sources"))


def expand_hops(spark: SparkSession, d: str) -> DataFrame:
    return expand.expanded(_strong(spark, d), checkpointed(edge(spark, d)), checkpointed(sym(spark, d).drop("search_text", "body")), with_files=False).drop("provenance")


def siblings_same_file(spark: SparkSession, d: str) -> DataFrame:
    return expand.siblings(expand.roots(_strong(spark, d)), sym(spark, d))


def sibling_files(spark: SparkSession, d: str) -> DataFrame:
    return expand.sibling_files(expand.roots(_strong(spark, d)), sym(spark, d))


def candidates_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of every candidate taken anew from the graph."""
    e, s = edge(spark, d), sym(spark, d)
    leaf = graph.leaf_flags(e, s).select("symbol_id", F.col("is_leaf").alias("leaf"))
    deg = graph.degrees(e).select("symbol_id", F.col("degree").alias("graph_degree"))
    c = cand(spark, d).select("task_id", "symbol_id", "degree")
    return c.join(deg, "symbol_id", "left").join(leaf, "symbol_id", "left").select("task_id", "symbol_id", "degree", F.coalesce("graph_degree", F.lit(0)).alias("graph_degree"), F.coalesce("leaf", F.lit(False)).alias("leaf"))


def score_v4(spark: SparkSession, d: str) -> DataFrame:
    return candidates.ranked(candidates.scored(cand(spark, d))).select("task_id", "symbol_id", "score", "rank")


def demote_containers(spark: SparkSession, d: str) -> DataFrame:
    return candidates.demoted(candidates.scored(cand(spark, d)), 2 * K).select("task_id", "symbol_id", "score", "container_penalty", "rank")


def scope_filtered_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranking within the repositories that a task's anchors are from."""
    c = candidates.scored(cand(spark, d))
    scopes = c.where("anchor").select("task_id", "repo_id")
    return candidates.ranked(candidates.scoped(c, scopes)).select("task_id", "symbol_id", "score", "rank")


def narrow_k20(spark: SparkSession, d: str) -> DataFrame:
    return candidates.narrowed(candidates.demoted(candidates.scored(cand(spark, d)), 2 * K), K)


def narrow_jina_guard10(spark: SparkSession, d: str) -> DataFrame:
    return candidates.narrowed(candidates.demoted(candidates.scored(cand(spark, d)), 2 * K), K, S.PROFILES["jina"])


def _selected(spark: SparkSession, d: str) -> DataFrame:
    """The first K by score with their features, as (task_id, slot, ...); the part of the pipeline that SQL can follow."""
    return candidates.ranked(candidates.scored(cand(spark, d))).where(F.col("rank") <= K).withColumnRenamed("rank", "slot")


def _items(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d).select("symbol_id", "name", "signature", "docstring", "body", "line")
    chosen = narrow_k20(spark, d).join(cand(spark, d).select("task_id", "symbol_id", "graph_distance", "file_id"), ["task_id", "symbol_id"])
    return chosen.join(s, "symbol_id", "left").withColumn("tier", F.lit("full"))


def assemble_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first K by score fitted into the budget."""
    s = sym(spark, d).select("symbol_id", "name", "signature", "docstring", "body", "line")
    return pack.assembled(_selected(spark, d).select("task_id", "slot", "symbol_id", "graph_distance", "file_id").join(s, "symbol_id", "left").withColumn("tier", F.lit("full")))


def files_summary(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d).select("symbol_id", "name")
    g = pack.file_groups(_selected(spark, d).where(F.col("file_id").isNotNull()).join(s, "symbol_id", "left"))
    return g.select("task_id", "file_id", "pos", "n_symbols", "best_score", F.concat_ws(",", "names").alias("names"))


def selector_policy(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of the selected files; a file is as relevant as the strongest evidence for a symbol of it."""
    sel = _selected(spark, d).where(F.col("file_id").isNotNull()).join(sym(spark, d).select("symbol_id", "name"), "symbol_id", "left")
    p = sel.groupBy("task_id", "file_id").agg(F.max(F.coalesce("source_strength", F.lit(0.0))).alias("relevance"))
    return pack.tiered(pack.file_groups(sel), p)


def coverage_metrics(spark: SparkSession, d: str) -> DataFrame:
    a = anchors_noisy_or(spark, d).withColumn("sources", F.split("sources", ","))
    sel = _selected(spark, d).withColumn("is_test", F.coalesce("is_test", F.lit(False)))
    return pack.coverage(sel.select("task_id", "slot", "symbol_id", "score", "graph_distance", "provenance", "degree", "is_test", "repo_id"), checkpointed(a))


def confidence_level(spark: SparkSession, d: str) -> DataFrame:
    return coverage_metrics(spark, d).groupBy("confidence").agg(F.count(F.lit(1)).alias("n_tasks"))


def related_tests(spark: SparkSession, d: str) -> DataFrame:
    targets = _selected(spark, d).where("slot <= 3").select("task_id", "symbol_id", F.when(F.col("slot") == 1, "edit").otherwise("dependency").alias("role"))
    return pack.related_tests(targets, checkpointed(edge(spark, d)), checkpointed(sym(spark, d).drop("search_text", "body")))


def identifier_gaps(spark: SparkSession, d: str) -> DataFrame:
    return pack.identifier_gaps(anchors.references_of(issues(spark, d)), sym(spark, d))


def pinned_files(spark: SparkSession, d: str) -> DataFrame:
    return pack.pinned_files(anchors.references_of(issues(spark, d)), sym(spark, d))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return cand(spark, d).where(F.col("ref_kind") == "define").select("task_id", "symbol_id")


def metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    """The score's ranking held against the symbols that a task's references define."""
    return evaluation.metrics(score_v4(spark, d), _truth(spark, d), [5, 10, 20])


def metrics_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(metrics_at_k(spark, d))


def win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    """The score against the raw signal of the task."""
    by_signal = cand(spark, d).select("task_id", "symbol_id", row_rank(["task_id"], [F.col("task_signal").desc_nulls_last(), F.col("symbol_id")]))
    return evaluation.win_tie_loss(metrics_at_k(spark, d), evaluation.metrics(by_signal, _truth(spark, d), [5, 10, 20]))


def truth_stage_crosstab(spark: SparkSession, d: str) -> DataFrame:
    c = cand(spark, d)
    channel = F.when(F.col("semantic_rank").isNotNull(), "semantic").when(F.col("anchor"), "anchor").otherwise("expansion")
    return evaluation.truth_stages(_truth(spark, d), c.select("task_id", "symbol_id", channel.alias("channel")), _selected(spark, d).select("task_id", "symbol_id"))


def cube_report(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and mean score by kind and provenance, with all totals."""
    c = candidates.scored(cand(spark, d)).select(F.coalesce("kind", F.lit("?")).alias("kind"), F.coalesce("provenance", F.lit("?")).alias("provenance"), "score")
    g = c.cube("kind", "provenance").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))
    return g.select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("provenance", F.lit("*")).alias("provenance"), "n", "mean_score")


def churn_of(spark: SparkSession, d: str) -> DataFrame:
    changes = read(spark, d, "pending_chunk").where(F.col("kind") == "file").select("repo_id", F.col("indexed_at_commit").alias("commit_id"), F.col("ref_id").alias("file_id"))
    return indexing.churn(changes, read(spark, d, "repo_commit").select("repo_id", "commit_id", "seq"))


def get_context_for_task(spark: SparkSession, d: str) -> DataFrame:
    """The whole retrieval for every issue among the documents: evidence, expansion, score, demotion, selection, packing.

    (task_id, slot, symbol_id, score, detail_level, tokens), one lazy plan for all tasks but for the checkpoints. Evidence comes
    from explicit names, terms and phrases, usage, paths, the semantic ranks of the hashing encoder, the graph around strong
    anchors, shared literals, and common names that another source names too. Routes, earlier work on a task and users' scopes have no
    table here: ``anchors.route``, ``anchors.history`` and ``candidates.scoped`` take theirs from the caller.
    """
    tasks = spread(checkpointed(issues(spark, d).select("task_id", "text", T.content_tokens(F.col("text")).alias("words"))))
    named, ids, s, e = _numbered(spark, d)

    def by_number(rows: DataFrame) -> DataFrame:
        return rows.join(ids, "symbol_id").drop("symbol_id").withColumnRenamed("number", "symbol_id")

    words = _task_words(tasks)
    terms = spread(checkpointed(terms_of(tasks.select("task_id", F.explode("words").alias("term")))))
    index = checkpointed(search.postings(s))
    hits = checkpointed(search.term_hits(index, terms.select("term")))
    phrases = search.phrase_hits(index, tasks.select("task_id", F.explode(T.phrase_terms(F.col("text"))).alias("phrase")))
    mentions = tasks.select("task_id", F.explode(T.file_mentions(F.col("text"))).alias("path"))
    files = search.files_by_suffix(s.where(F.col("file_id").isNotNull()).select("file_id").distinct(), mentions.select(F.col("path").alias("suffix")).distinct())
    meant, generic = (by_number(x) for x in anchors.explicit(tasks, named))
    ranks = checkpointed(by_number(semantic_ranks(tasks, named, max(30, 2 * K))))
    semantic = anchors.semantic(ranks.withColumn("is_test", F.lit(False)))
    parts = [("semantic", semantic), ("explicit", meant), ("lexical", search.lexical_anchors(hits, terms, phrases)), ("usage", anchors.usage(search.mentions_of_words(s, words), words)), ("path", anchors.path(mentions, files, s))]
    found = checkpointed(reduce(DataFrame.unionByName, [x.select("task_id", "symbol_id", F.lit(n).alias("source"), "strength") for n, x in parts]))
    strong = checkpointed(anchors.noisy_or(found))
    near = anchors.impact(strong, e, s).unionByName(anchors.shared_literals(strong, s, search.mentions_of_literals))
    more = [("impact", near), ("name", anchors.corroborated(generic, found))]
    evidence = reduce(DataFrame.unionByName, [found, *[x.select("task_id", "symbol_id", F.lit(n).alias("source"), "strength") for n, x in more]])
    anchored = checkpointed(anchors.noisy_or(evidence))
    churn = indexing.filled_churn(churn_of(spark, d), s.where(F.col("file_id").isNotNull()))
    features = checkpointed(expand.symbol_features(s, graph.degrees(e), graph.leaf_flags(e, s), churn).drop("file_id").withColumnRenamed("file_no", "file_id"))
    pool = checkpointed_by(expand.featured(expand.expanded(anchored, e, s), features, tasks, ranks), "task_id")  # from here a task's rows stay together
    scored = candidates.scored(expand.by_mass(pool, anchored, e).withColumn("anchor", F.col("is_anchor")))
    kept = ["task_id", "symbol_id", "score", "kind", "file_id", "owner", "member_prefix", "semantic_rank", "graph_distance"]
    ranked = checkpointed_by(candidates.demoted(checkpointed_by(scored.select(kept), "task_id"), 2 * K).drop("member_prefix"), "task_id")
    named_files = F.when(F.col("file_id") > 0, F.col("file_id"))
    chosen = checkpointed(candidates.narrowed(ranked.withColumn("file_id", named_files), K))
    shown = s.select("symbol_id", "id", "name", "signature", "docstring", "body", "file_id", "line")
    items = chosen.join(ranked.select("task_id", "symbol_id", "graph_distance"), ["task_id", "symbol_id"]).join(shown, "symbol_id").withColumns({"tier": F.lit("full"), "symbol_id": F.col("id")})
    packed = pack.assembled(items)
    return packed.join(chosen.select("task_id", "slot", "score"), ["task_id", "slot"]).select("task_id", "slot", "symbol_id", "score", "detail_level", "tokens")


def _numbered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(symbols, (symbol_id, number), the symbols with numbers, the edges with numbers), each written once.

    A number stands for an id in the order of the ids, so ties fall as they do by id. Symbols keep theirs in column ``id``; ``owner``,
    ``member_prefix`` and ``file_no`` number what demotion and selection group by, a file without a name being 0.
    """
    named, linked = spread(checkpointed(sym(spark, d))), spread(checkpointed(edge(spark, d)))
    ends = linked.select(F.explode(F.array("src_id", "dst_id")).alias("symbol_id"))
    ids = checkpointed(numbered(named.select("symbol_id").unionByName(ends), "symbol_id"))
    own = {"owner": candidates.owner(F.col("symbol_id")), "member_prefix": candidates.member_prefix(F.col("symbol_id")), "file_no": F.when(F.col("file_id") != "", F.col("file_id"))}
    groups = checkpointed(numbered(named.select(F.explode(F.array(*own.values())).alias("group")), "group"))
    s = named.withColumns(own)
    for c in own:
        s = s.join(groups.select(F.col("group").alias(c), F.col("number").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    s = s.withColumn("file_no", F.when(F.col("file_id") == "", F.lit(0)).otherwise(F.col("file_no")))
    s = s.join(ids, "symbol_id").withColumnsRenamed({"symbol_id": "id", "number": "symbol_id"})
    e = linked.join(ids.select(F.col("symbol_id").alias("src_id"), F.col("number").alias("_s")), "src_id").join(ids.select(F.col("symbol_id").alias("dst_id"), F.col("number").alias("_d")), "dst_id")
    e = e.select("label", F.col("_s").alias("src_id"), F.col("_d").alias("dst_id"), "provenance", "ref_kind")
    return named, ids, spread(checkpointed(s)), checkpointed(e)


QUERIES = {
    f.__name__: f
    for f in (
        anchors_explicit, anchors_usage, anchors_path, anchors_semantic, anchors_literals, anchors_impact, anchors_noisy_or, expand_hops, siblings_same_file, sibling_files, candidates_features, score_v4, demote_containers, scope_filtered_rank, narrow_k20,
        narrow_jina_guard10, assemble_budget, files_summary, selector_policy, coverage_metrics, confidence_level, related_tests, identifier_gaps, pinned_files, metrics_at_k, metrics_recall_mrr, win_tie_loss, truth_stage_crosstab, cube_report,
        get_context_for_task,
    )
}

_C = _CAND.replace("SELECT * FROM (SELECT *, row_number()", "SELECT * REPLACE (CASE WHEN isnan(task_signal) THEN NULL ELSE task_signal END AS task_signal) FROM (SELECT *, row_number()")
_CONTAINER = ", ".join(f"'{k}'" for k in S.CONTAINER_KINDS)
_SCORED = _C + """, t AS (SELECT *, CASE WHEN coalesce(anchor, FALSE) AND coalesce(anchor_strength, 0) <= 0 THEN 1.0::DOUBLE ELSE coalesce(anchor_strength, 0) END AS ea FROM cand),
  u AS (SELECT *, greatest(coalesce(source_strength, 0), ea) AS seen FROM t), w AS (SELECT *, CASE WHEN seen > 0 THEN seen ELSE 1.0::DOUBLE END AS ev FROM u),
  scored AS (SELECT *, round(3.0::DOUBLE * CASE ref_kind WHEN 'define' THEN 1.0 WHEN 'write' THEN 0.8 WHEN 'read' THEN 0.3 WHEN 'pass' THEN 0.2 ELSE 0.3 END::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * ev) + 2.5::DOUBLE * coalesce(task_signal, 0)
    + 0.6::DOUBLE * least(ln(1 + greatest(coalesce(degree, 0), 0)) / ln(21), 1) + 2.0::DOUBLE * (1.0::DOUBLE / (1 + greatest(coalesce(graph_distance, 3), 0))) * ev - 0.5::DOUBLE * CAST(coalesce(is_leaf, FALSE) AS INTEGER)
    + 0.5::DOUBLE * CASE provenance WHEN 'scip' THEN 1.0 WHEN 'treesitter' THEN 0.8 ELSE 0.4 END::DOUBLE + 3.5::DOUBLE * ea - 2.0::DOUBLE * CAST(coalesce(is_test, FALSE) AS INTEGER)
    + 2.0::DOUBLE * CASE lower(kind) WHEN 'method' THEN 1.0 WHEN 'function' THEN 1.0 WHEN 'interface' THEN 0.4 WHEN 'protocol' THEN 0.4 WHEN 'trait' THEN 0.4 WHEN 'constructor' THEN 0.4 ELSE 0.5 END::DOUBLE
    + coalesce(CASE WHEN semantic_rank >= 0 THEN 1.0::DOUBLE / (1 + semantic_rank) END, 0) + least(ln(1 + greatest(coalesce(churn, 0), 0)) / ln(21), 1), 6) AS score FROM w),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, symbol_id) AS rank FROM scored)"""
_ITEM = """item AS (SELECT r.task_id, r.rank AS slot, r.symbol_id, coalesce(r.graph_distance, 3) AS d, coalesce(s.name, r.symbol_id) AS shown, s.signature, s.docstring, s.body, r.file_id, s.line FROM ranked r LEFT JOIN sym s USING (symbol_id) WHERE r.rank <= 20),
  txt AS (SELECT *, shown || coalesce(signature, '') || CASE WHEN length(docstring) > 0 THEN chr(10) || docstring ELSE '' END AS sig, shown || ' @ ' || coalesce(file_id, '') || ':' || coalesce(CAST(line AS VARCHAR), '') AS ref FROM item),
  cost AS (SELECT task_id, slot, symbol_id, CASE WHEN d >= 3 THEN 'reference' WHEN d = 2 THEN 'signature' ELSE 'full' END AS level, greatest(1, ceil(length(ref) / 4))::INTEGER AS least,
    greatest(1, ceil(length(CASE WHEN d >= 3 THEN ref WHEN d = 2 OR coalesce(length(body), 0) = 0 THEN sig ELSE body END) / 4))::INTEGER AS tokens FROM txt)"""
_STRONG = "strong AS (SELECT task_id, symbol_id, coalesce(anchor_strength, 1.0) AS strength FROM cand WHERE anchor)"
_IMPACT = """root AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY strength DESC, symbol_id) AS k FROM strong WHERE strength >= 0.9) WHERE k <= 5),
  used AS (SELECT DISTINCT e.dst_id AS symbol_id, e.src_id AS user_id FROM edge e JOIN sym s ON s.symbol_id = e.src_id AND NOT s.is_test WHERE e.label IN ('CALLS', 'REFERENCES') AND e.src_id <> e.dst_id),
  few AS (SELECT symbol_id, count(*) AS n FROM used GROUP BY symbol_id HAVING count(*) < 60),
  impact AS (SELECT r.task_id, u.user_id AS symbol_id, round(least(1 - exp(sum(ln(1 - 0.7::DOUBLE * r.strength * sqrt(1 - f.n / 60)))), 0.7), 6) AS strength FROM root r JOIN few f USING (symbol_id) JOIN used u USING (symbol_id) GROUP BY r.task_id, u.user_id)"""
_SEMANTIC = "semantic AS (SELECT task_id, symbol_id, round(0.9::DOUBLE / (1 + semantic_rank / 30), 6) AS strength FROM cand WHERE semantic_rank >= 0 AND NOT coalesce(is_test, FALSE))"
_NOISY = """ev AS (SELECT task_id, symbol_id, 0 AS o, 'explicit' AS source, greatest(least(strength, 1.0), 0) AS s FROM strong UNION ALL SELECT task_id, symbol_id, 5, 'semantic', least(strength, 0.9) FROM semantic UNION ALL SELECT task_id, symbol_id, 6, 'impact', least(strength, 0.7) FROM impact),
  pv AS (SELECT task_id, symbol_id, coalesce(max(s) FILTER (WHERE o = 0), 0) AS a, coalesce(max(s) FILTER (WHERE o = 5), 0) AS b, coalesce(max(s) FILTER (WHERE o = 6), 0) AS c, string_agg(source, ',' ORDER BY o) AS sources FROM ev GROUP BY task_id, symbol_id),
  f1 AS (SELECT *, round(1 - (1 - 0.0::DOUBLE) * (1 - a), 6) AS p1 FROM pv), f2 AS (SELECT *, round(1 - (1 - p1) * (1 - b), 6) AS p2 FROM f1), noisy AS (SELECT task_id, symbol_id, round(1 - (1 - p2) * (1 - c), 6) AS strength, sources FROM f2)"""
_REFS = f"""{_ISSUE}, qr AS (SELECT DISTINCT task_id, unnest(regexp_extract_all({_NOURL.format('text')}, '([A-Za-z_][A-Za-z0-9_]*(?:[.:]{{1,2}}[A-Za-z_][A-Za-z0-9_]*)+)', 1)) AS r FROM issue),
  qn AS (SELECT DISTINCT task_id, string_split(regexp_replace(r, '[.:]+', '.', 'g'), '.')[-2] AS container, string_split(regexp_replace(r, '[.:]+', '.', 'g'), '.')[-1] AS name FROM qr),
  bt AS (SELECT DISTINCT task_id, unnest(regexp_extract_all({_NOURL.format('text')}, '{_W}', 1)) AS token FROM issue),
  bare AS (SELECT task_id, CAST(NULL AS VARCHAR) AS container, token AS name FROM bt WHERE length(token) >= 3 AND {_low('token')} NOT IN ({_STOP}) AND (regexp_matches(token, '[^_]_[^_]') OR regexp_matches(token, '[0-9]') OR regexp_matches(token, '[a-z][A-Z]') OR (regexp_matches(token, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') AND length(token) >= 4))
    AND NOT EXISTS (SELECT 1 FROM qn WHERE qn.task_id = bt.task_id AND qn.name = bt.token)),
  refs AS (SELECT * FROM (SELECT * FROM qn UNION ALL SELECT * FROM bare) WHERE length(name) >= 3 AND {_low('name')} NOT IN ({_STOP}))"""
_DECL = ", ".join(f"'{k}'" for k in S.DECLARING_KINDS)

ORACLE = {
    "anchors_explicit": f"""WITH {SYM}, {_REFS}, m AS (SELECT r.*, s.symbol_id, lower(s.kind) IN ({_DECL}) AS declares, r.container IS NOT NULL AND string_split(string_split(s.symbol_id, '#')[1], '::')[-2] = r.container AS inside FROM refs r JOIN sym s ON s.name = r.name),
        n AS (SELECT *, count(*) OVER p AS n, count(*) FILTER (WHERE inside) OVER p AS n_in, bool_or(declares) OVER p AS any_d, bool_or(declares AND inside) OVER p AS any_in FROM m WINDOW p AS (PARTITION BY task_id, container, name)),
        k AS (SELECT *, CASE WHEN n_in > 0 THEN n_in ELSE n END AS size, CASE WHEN n_in > 0 THEN any_in ELSE any_d END AS declared FROM n WHERE CASE WHEN container IS NULL THEN TRUE WHEN n_in > 0 THEN inside ELSE n <= 3 END)
        SELECT task_id, symbol_id, max(round(CASE WHEN declared AND NOT declares THEN 0.5 ELSE 1.0 END::DOUBLE / sqrt(size), 6)) AS strength FROM k WHERE size <= 8 GROUP BY task_id, symbol_id""",
    "anchors_semantic": f"WITH {_C}, {_SEMANTIC} SELECT * FROM semantic",
    "anchors_impact": f"WITH {SYM}, {EDGE}, {_C}, {_STRONG}, {_IMPACT} SELECT * FROM impact",
    "anchors_noisy_or": f"WITH {SYM}, {EDGE}, {_C}, {_STRONG}, {_SEMANTIC}, {_IMPACT}, {_NOISY} SELECT * FROM noisy",
    "siblings_same_file": f"""WITH {SYM}, {_C}, {_STRONG}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY strength DESC, symbol_id) AS k FROM strong WHERE strength >= 0.3) WHERE k <= 20),
        a AS (SELECT w.task_id, w.symbol_id AS anchor_id, w.strength, s.file_id, coalesce(s.line, 0) AS at FROM w JOIN sym s USING (symbol_id) WHERE w.strength >= 0.7 AND lower(coalesce(s.kind, '')) NOT IN ({_CONTAINER})),
        n AS (SELECT a.*, s.symbol_id, row_number() OVER (PARTITION BY a.task_id, a.anchor_id ORDER BY abs(coalesce(s.line, 0) - a.at), s.symbol_id) AS k FROM a JOIN sym s ON s.file_id = a.file_id AND s.symbol_id <> a.anchor_id)
        SELECT task_id, symbol_id, max(round(strength * 0.6::DOUBLE, 6)) AS strength FROM n WHERE k <= 12 GROUP BY task_id, symbol_id""",
    "candidates_features": f"""WITH {EDGE}, {_C}, ends AS (SELECT src_id AS id FROM edge UNION ALL SELECT dst_id FROM edge), deg AS (SELECT id, count(*) AS n FROM ends GROUP BY id), live AS (SELECT DISTINCT node_id FROM (SELECT *, row_number() OVER (PARTITION BY label, node_id ORDER BY changed_at DESC, op DESC) AS rn FROM graph_node) WHERE rn = 1 AND op = 'upsert' AND label = 'Symbol')
        SELECT c.task_id, c.symbol_id, c.degree, coalesce(d.n, 0) AS graph_degree, l.node_id IS NOT NULL AND EXISTS (SELECT 1 FROM edge e WHERE e.label = 'CALLS' AND e.dst_id = c.symbol_id) AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.label = 'CALLS' AND e.src_id = c.symbol_id) AS leaf
        FROM cand c LEFT JOIN deg d ON d.id = c.symbol_id LEFT JOIN live l ON l.node_id = c.symbol_id""",
    "score_v4": f"WITH {_SCORED} SELECT task_id, symbol_id, score, rank FROM ranked",
    "demote_containers": f"""WITH {_SCORED}, top AS (SELECT task_id, file_id, kind, string_split(string_split(symbol_id, '#')[1], '::') AS p FROM ranked WHERE rank <= 40),
        own AS (SELECT DISTINCT task_id, array_to_string(p[1:len(p) - 1], '::') AS k FROM top WHERE len(p) >= 4 AND p[-2] <> ''), fil AS (SELECT DISTINCT task_id, file_id FROM top WHERE lower(kind) <> 'module' AND file_id IS NOT NULL),
        x AS (SELECT *, string_split(string_split(symbol_id, '#')[1], '::') AS p FROM ranked), y AS (SELECT *, CASE WHEN len(p) >= 4 AND p[-2] = '' THEN array_to_string(list_append(p[1:len(p) - 2], p[-1]), '::') END AS k FROM x),
        z AS (SELECT y.task_id, y.symbol_id, y.score, lower(coalesce(kind, '')) IN ({_CONTAINER}) AND CASE WHEN lower(kind) = 'module' THEN EXISTS (SELECT 1 FROM fil f WHERE f.task_id = y.task_id AND f.file_id = y.file_id) ELSE EXISTS (SELECT 1 FROM own o WHERE o.task_id = y.task_id AND o.k = y.k) END AS r FROM y),
        q AS (SELECT task_id, symbol_id, CASE WHEN r THEN 1.5 ELSE 0.0 END::DOUBLE AS container_penalty, round(score - CASE WHEN r THEN 1.5 ELSE 0.0 END::DOUBLE, 6) AS score FROM z) SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, symbol_id) AS rank FROM q""",
    "scope_filtered_rank": f"WITH {_SCORED}, scope AS (SELECT DISTINCT task_id, repo_id FROM cand WHERE anchor) SELECT s.task_id, s.symbol_id, s.score, row_number() OVER (PARTITION BY s.task_id ORDER BY s.score DESC, s.symbol_id) AS rank FROM scored s JOIN scope USING (task_id, repo_id)",
    "files_summary": f"""WITH {SYM}, {_SCORED}, sel AS (SELECT r.*, s.name FROM ranked r LEFT JOIN sym s USING (symbol_id) WHERE r.rank <= 20 AND r.file_id IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY task_id, file_id ORDER BY score DESC, symbol_id) AS k FROM sel),
        g AS (SELECT task_id, file_id, min(rank) AS first, count(*) AS n_symbols, max(score) AS best_score, coalesce(string_agg(name, ',' ORDER BY k) FILTER (WHERE k <= 6), '') AS names FROM o GROUP BY task_id, file_id) SELECT task_id, file_id, row_number() OVER (PARTITION BY task_id ORDER BY first, file_id) AS pos, n_symbols, best_score, names FROM g""",
    "assemble_budget": f"""WITH RECURSIVE {SYM}, {_SCORED}, {_ITEM}, pack AS (SELECT DISTINCT task_id, 0 AS slot, NULL::VARCHAR AS symbol_id, NULL::VARCHAR AS detail_level, 0 AS tokens, 0 AS used FROM cost
        UNION ALL SELECT c.task_id, c.slot, c.symbol_id, CASE WHEN p.used + c.tokens <= 1500 THEN c.level WHEN p.used + c.least <= 1500 THEN 'reference' END, CASE WHEN p.used + c.tokens <= 1500 THEN c.tokens WHEN p.used + c.least <= 1500 THEN c.least ELSE 0 END,
          p.used + CASE WHEN p.used + c.tokens <= 1500 THEN c.tokens WHEN p.used + c.least <= 1500 THEN c.least ELSE 0 END FROM pack p JOIN cost c ON c.task_id = p.task_id AND c.slot = p.slot + 1)
        SELECT task_id, slot, symbol_id, detail_level, tokens FROM pack WHERE detail_level IS NOT NULL""",
    "identifier_gaps": f"WITH {SYM}, {_REFS}, g AS (SELECT DISTINCT task_id, name FROM refs WHERE length(name) >= 4 AND name NOT IN (SELECT name FROM sym WHERE name IS NOT NULL)) SELECT task_id, name FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY name) AS k FROM g) WHERE k <= 5",
    "pinned_files": f"WITH {SYM}, {_REFS}, d AS (SELECT DISTINCT name, file_id FROM sym WHERE file_id IS NOT NULL), f AS (SELECT name FROM d GROUP BY name HAVING count(*) <= 4) SELECT DISTINCT r.task_id, d.file_id FROM refs r JOIN f USING (name) JOIN d USING (name) WHERE length(r.name) >= 4",
    "cube_report": f"WITH {_SCORED} SELECT coalesce(kind, '*') AS kind, coalesce(provenance, '*') AS provenance, count(*) AS n, round(avg(score), 4) AS mean_score FROM (SELECT coalesce(kind, '?') AS kind, coalesce(provenance, '?') AS provenance, score FROM scored) GROUP BY CUBE (kind, provenance)",
    "truth_stage_crosstab": f"""WITH {_SCORED} SELECT CASE WHEN semantic_rank IS NOT NULL THEN 'semantic' WHEN anchor THEN 'anchor' ELSE 'expansion' END AS channel, count(*) FILTER (WHERE rank <= 20) AS returned, count(*) FILTER (WHERE rank > 20) AS narrowed_out, 0::BIGINT AS not_reached FROM ranked WHERE ref_kind = 'define' GROUP BY 1""",
    "metrics_at_k": f"""WITH {_SCORED}, k AS (SELECT unnest([5, 10, 20]) AS k), tru AS (SELECT task_id, count(*) AS n_truth FROM cand WHERE ref_kind = 'define' GROUP BY task_id), s AS (SELECT task_id, max(rank) AS n FROM ranked GROUP BY task_id),
        h AS (SELECT tru.task_id, k.k, tru.n_truth, s.n, count(r.rank) AS hits, min(r.rank) AS first FROM tru CROSS JOIN k JOIN s USING (task_id) LEFT JOIN ranked r ON r.task_id = tru.task_id AND r.ref_kind = 'define' AND r.rank <= k.k GROUP BY ALL), x AS (SELECT *, hits / n_truth AS re, hits / least(k, n) AS pr FROM h)
        SELECT task_id, k, hits, round(re, 6) AS recall, round(pr, 6) AS precision, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, hits > 0 AS hit FROM x""",
}
_WALK = """walked AS (SELECT task_id, symbol_id, strength FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY strength DESC, symbol_id) AS k FROM strong WHERE strength >= 0.3) WHERE k <= 20)"""


def _hop_sql(name: str, frontier: str, direction: str, without: str = "") -> str:
    labels, given, found = graph.DIRECTIONS[direction]
    inside = ", ".join(f"'{x}'" for x in labels)
    skip = f" WHERE NOT EXISTS (SELECT 1 FROM ({without}) z WHERE z.task_id = q.task_id AND z.symbol_id = q.symbol_id)" if without else ""
    return f"{name} AS (SELECT * FROM (SELECT f.task_id, e.{found} AS symbol_id, round(arg_min(f.strength, f.symbol_id) * 0.6::DOUBLE, 6) AS strength, arg_min(e.ref_kind, f.symbol_id) AS ref_kind FROM {frontier} f JOIN edge e ON e.{given} = f.symbol_id AND e.label IN ({inside}) GROUP BY f.task_id, e.{found}) q{skip})"


ORACLE["expand_hops"] = f"""WITH {SYM}, {EDGE}, {_C}, {_STRONG}, {_WALK}, {_hop_sql('h1', 'walked', 'callers', 'SELECT task_id, symbol_id FROM walked')}, {_hop_sql('h2', 'h1', 'callers', 'SELECT task_id, symbol_id FROM walked UNION ALL SELECT task_id, symbol_id FROM h1')},
  {", ".join(_hop_sql(f'h_{x}', 'walked', x) for x in ('callees', 'referrers', 'references', 'supertypes', 'subtypes'))}, sib AS (WITH w AS ({ORACLE['siblings_same_file'].split('w AS (', 1)[1]}),
  u AS (SELECT task_id, symbol_id, strength, NULL AS ref_kind, 0 AS rule, 0 AS d FROM strong UNION ALL SELECT task_id, symbol_id, strength, NULL, 1, 1 FROM h1 UNION ALL SELECT task_id, symbol_id, strength, NULL, 2, 2 FROM h2 UNION ALL SELECT task_id, symbol_id, strength, NULL, 3, 1 FROM h_callees UNION ALL SELECT task_id, symbol_id, strength, ref_kind, 4, 1 FROM h_referrers
    UNION ALL SELECT task_id, symbol_id, strength, NULL, 5, 1 FROM h_references UNION ALL SELECT task_id, symbol_id, strength, NULL, 6, 1 FROM h_supertypes UNION ALL SELECT task_id, symbol_id, strength, NULL, 7, 1 FROM h_subtypes UNION ALL SELECT task_id, symbol_id, strength, NULL, 8, 1 FROM sib)
  SELECT task_id, symbol_id, min(d) AS distance, bool_or(rule = 0) AS is_anchor, max(CASE WHEN rule = 0 THEN strength ELSE 0.0 END) AS anchor_strength, max(strength) AS source_strength, max(ref_kind) AS ref_kind FROM u SEMI JOIN sym USING (symbol_id) GROUP BY task_id, symbol_id"""
ORACLE["anchors_usage"] = f"""WITH {SYM}, {_ISSUE}, bt AS (SELECT DISTINCT task_id, unnest(regexp_extract_all({_NOURL.format('text')}, '{_W}', 1)) AS word FROM issue),
  tw AS (SELECT * FROM bt WHERE length(word) >= 4 AND {_low('word')} NOT IN ({_STOP}) AND (regexp_matches(word, '[^_]_[^_]') OR regexp_matches(word, '[0-9]') OR regexp_matches(word, '[a-z][A-Z]') OR regexp_matches(word, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$'))),
  b AS (SELECT symbol_id, unnest(list_distinct(regexp_extract_all(coalesce(search_text, ''), '([A-Za-z_][A-Za-z0-9_]*)', 1))) AS word FROM sym WHERE NOT is_test), f AS (SELECT word, symbol_id, count(*) OVER (PARTITION BY word) AS n FROM b SEMI JOIN tw USING (word))
  SELECT task_id, symbol_id, round(least(1 - exp(sum(ln(1 - 0.8::DOUBLE * sqrt(1 - n / 60)))), 0.8), 6) AS strength FROM tw JOIN f USING (word) WHERE n < 60 GROUP BY task_id, symbol_id"""
ORACLE["selector_policy"] = f"""WITH {_SCORED}, sel AS (SELECT * FROM ranked WHERE rank <= 20 AND file_id IS NOT NULL), g AS (SELECT task_id, file_id, min(rank) AS first, max(coalesce(source_strength, 0)) AS relevance FROM sel GROUP BY task_id, file_id),
  p AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY first, file_id) AS pos, relevance >= 0.5 AS full_tier FROM g), n AS (SELECT *, count(*) FILTER (WHERE full_tier) OVER (PARTITION BY task_id) AS nf, row_number() OVER (PARTITION BY task_id, full_tier ORDER BY relevance DESC, pos) AS r FROM p)
  SELECT task_id, file_id, pos, relevance, CASE WHEN full_tier THEN 'full' WHEN relevance >= 0.25 AND nf + r <= 6 OR pos = 1 THEN 'stub' ELSE 'dropped' END AS tier FROM n"""
ORACLE["win_tie_loss"] = f"""WITH {_SCORED}, k AS (SELECT unnest([5, 10, 20]) AS k), tru AS (SELECT task_id, count(*) AS n_truth FROM cand WHERE ref_kind = 'define' GROUP BY task_id), sg AS (SELECT task_id, symbol_id, ref_kind, row_number() OVER (PARTITION BY task_id ORDER BY task_signal DESC NULLS LAST, symbol_id) AS rank FROM cand),
  x AS (SELECT tru.task_id, k.k, round((SELECT count(*) FROM ranked r WHERE r.task_id = tru.task_id AND r.ref_kind = 'define' AND r.rank <= k.k) / n_truth, 6) AS a, round((SELECT count(*) FROM sg r WHERE r.task_id = tru.task_id AND r.ref_kind = 'define' AND r.rank <= k.k) / n_truth, 6) AS b FROM tru CROSS JOIN k)
  SELECT k, count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a = b) AS ties, count(*) FILTER (WHERE a < b) AS losses FROM x GROUP BY k"""
_BASE = "CASE WHEN e IN ('py', 'pyi') THEN ['test_' || s || '.py', s || '_test.py'] WHEN e IN ('ts', 'tsx') THEN [s || '.test.ts', s || '.test.tsx', s || '.spec.ts', s || '.spec.tsx'] WHEN e IN ('js', 'jsx', 'mjs', 'cjs') THEN [s || '.test.js', s || '.test.jsx', s || '.test.mjs', s || '.test.cjs', s || '.spec.js', s || '.spec.jsx', s || '.spec.mjs', s || '.spec.cjs'] WHEN e = 'go' THEN [s || '_test.go'] WHEN e IN ('java', 'kt', 'scala', 'php') THEN [s || 'Test.' || e, s || 'Tests.' || e, 'Test' || s || '.' || e] WHEN e = 'cs' THEN [s || 'Tests.cs', s || 'Test.cs'] WHEN e = 'rb' THEN [s || '_spec.rb', s || '_test.rb'] ELSE [] END"
ORACLE["related_tests"] = f"""WITH {SYM}, {EDGE}, {_SCORED}, tg AS (SELECT task_id, symbol_id, CASE WHEN rank = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS wt FROM ranked WHERE rank <= 3), hop AS (SELECT DISTINCT dst_id AS symbol_id, src_id AS test_id FROM edge WHERE label IN ('CALLS', 'REFERENCES', 'INHERITS', 'IMPLEMENTS')),
  ts AS (SELECT symbol_id AS test_id, file_id AS test_file, line FROM sym WHERE is_test), ht AS (SELECT tg.*, hop.test_id, ts.test_file, ts.line FROM tg JOIN hop USING (symbol_id) JOIN ts USING (test_id)), gr AS (SELECT task_id, test_file, sum(wt) AS wt FROM (SELECT DISTINCT task_id, test_file, symbol_id, wt FROM ht) GROUP BY task_id, test_file),
  sp AS (SELECT tg.task_id, regexp_replace(y.file_id, '^[^:]*:', '') AS path FROM tg JOIN sym y USING (symbol_id) WHERE y.file_id IS NOT NULL), se AS (SELECT task_id, path, regexp_extract(string_split(path, '/')[-1], '^(.*)\\.[^.]*$', 1) AS s, lower(regexp_extract(string_split(path, '/')[-1], '\\.([^.]*)$', 1)) AS e FROM sp),
  ba AS (SELECT DISTINCT task_id, unnest({_BASE}) AS base FROM se WHERE NOT {_TESTPATH.format('path')} AND s <> '' AND NOT starts_with(s, '__')), nm AS (SELECT DISTINCT test_file, string_split(test_file, '/')[-1] AS base FROM ts), us AS (SELECT task_id, base, min(test_file) AS test_file FROM ba JOIN nm USING (base) GROUP BY task_id, base),
  tt AS (SELECT task_id, test_file, sum(wt) AS weight FROM (SELECT task_id, test_file, wt FROM gr UNION ALL SELECT task_id, test_file, 1.5::DOUBLE FROM us) GROUP BY task_id, test_file), tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY weight DESC, test_file) AS k FROM tt) WHERE k <= 2),
  rc AS (SELECT task_id, test_file, test_id, line, count(DISTINCT symbol_id) AS n FROM ht GROUP BY ALL), sh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, test_file ORDER BY n DESC, coalesce(line, 0), test_id) AS place FROM rc) WHERE place <= 2)
  SELECT tp.task_id, tp.test_file AS file_id, tp.weight, sh.test_id AS symbol_id, sh.place FROM tp LEFT JOIN sh USING (task_id, test_file)"""
_COVERAGE = f"""WITH {SYM}, {EDGE}, {_SCORED}, {_STRONG}, {_SEMANTIC}, {_IMPACT}, {_NOISY}, a AS (SELECT *, len(string_split(sources, ',')) >= 2 OR contains(sources, 'explicit') AS corr FROM noisy),
  tot AS (SELECT task_id, count(*) AS anchor_count, count(*) FILTER (WHERE strength >= 0.6) AS strong_anchor_count, count(*) FILTER (WHERE corr) AS corroborated_anchor_count, CAST(bool_or(contains(sources, 'explicit')) AS INTEGER) + CAST(bool_or(contains(sources, 'semantic')) AS INTEGER) + CAST(bool_or(contains(sources, 'impact')) AS INTEGER) AS source_count FROM a GROUP BY task_id),
  x AS (SELECT r.task_id, r.rank, r.score, r.graph_distance, r.provenance, coalesce(r.degree, 0) AS degree, coalesce(r.is_test, FALSE) AS is_test, r.repo_id, a.strength, a.corr, coalesce(a.strength >= 0.6 OR a.corr, FALSE) AS trusted FROM ranked r LEFT JOIN a USING (task_id, symbol_id) WHERE r.rank <= 20),
  g AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE trusted) AS tr, count(*) FILTER (WHERE strength IS NULL AND graph_distance <= 1) AS near, count(*) FILTER (WHERE strength < 0.35 AND NOT corr) AS weak, count(strength) AS anchored, round(coalesce(max(strength), 0), 6) AS mx, count(*) FILTER (WHERE is_test) AS tests,
    count(DISTINCT repo_id) AS repos, count(*) FILTER (WHERE graph_distance <= 2) AS conn, round(coalesce(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), max(score)), 6) AS margin, max(degree) AS deg, count(*) FILTER (WHERE provenance = 'scip') AS ps, count(*) FILTER (WHERE provenance = 'treesitter') AS pt, count(*) FILTER (WHERE provenance = 'heuristic') AS ph, bool_or(trusted) FILTER (WHERE rank = 1) AS top FROM x GROUP BY task_id),
  cov AS (SELECT g.task_id, n AS candidate_count, coalesce(anchor_count, 0) AS anchor_count, coalesce(strong_anchor_count, 0) AS strong_anchor_count, coalesce(corroborated_anchor_count, 0) AS corroborated_anchor_count, coalesce(source_count, 0) AS source_count, round(least(tr + CASE WHEN tr > 0 THEN near ELSE 0 END, n) / n, 6) AS anchor_agreement_ratio, round(weak / n, 6) AS weak_anchor_ratio,
    mx AS max_anchor_strength, round(tests / n, 6) AS test_ratio, round(conn / n, 6) AS connected_component_ratio, round(greatest(repos - 1, 0) / n, 6) AS cross_repo_edge_ratio, round((n - anchored) / n, 6) AS orphan_ratio, margin AS top_candidate_margin, round(coalesce(ps / nullif(ps + pt + ph, 0), 0), 6) AS scip_ratio, round(coalesce(pt / nullif(ps + pt + ph, 0), 0), 6) AS treesitter_ratio,
    round(coalesce(ph / nullif(ps + pt + ph, 0), 0), 6) AS heuristic_ratio, deg >= 20 AS touches_god_node, deg AS max_centrality_in_context, top AS top_is_trusted FROM g LEFT JOIN tot USING (task_id)),
  conf AS (SELECT *, CASE WHEN (max_anchor_strength < 0.35 AND corroborated_anchor_count = 0) OR weak_anchor_ratio > 0.5 OR test_ratio > 0.5 OR (source_count <= 1 AND (top_candidate_margin < 0.5 OR orphan_ratio > 0.5)) THEN 'low'
    WHEN top_is_trusted AND (strong_anchor_count >= 1 OR corroborated_anchor_count >= 1) AND anchor_agreement_ratio >= 0.6 AND weak_anchor_ratio <= 0.25 AND top_candidate_margin >= 0.5 THEN 'high' ELSE 'medium' END AS confidence FROM cov)"""
ORACLE["coverage_metrics"] = f"{_COVERAGE} SELECT * FROM conf"
ORACLE["confidence_level"] = f"{_COVERAGE} SELECT confidence, count(*) AS n_tasks FROM conf GROUP BY confidence"
ORACLE["metrics_recall_mrr"] = f"SELECT k, count(*) AS n_tasks, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(hit::INTEGER), 6) AS hit_rate FROM ({ORACLE['metrics_at_k']}) GROUP BY k"
ORACLE["anchors_path"] = f"""WITH {SYM}, {_FILE}, {_ISSUE}, {_MENTION}, {_NAMED}, s AS (SELECT DISTINCT task_id, lower(path) AS suffix FROM named), f AS (SELECT DISTINCT s.suffix, f.file_id FROM file f JOIN s ON lower(f.path) = s.suffix OR ends_with(lower(f.path), '/' || s.suffix)),
  n AS (SELECT *, count(*) OVER (PARTITION BY suffix) AS n FROM f), b AS (SELECT * FROM (SELECT s.task_id, n.file_id, n.n, row_number() OVER (PARTITION BY s.task_id, n.file_id ORDER BY length(s.suffix) DESC, n.n) AS k FROM s JOIN n USING (suffix) WHERE n.n <= 4) WHERE k = 1)
  SELECT b.task_id, y.symbol_id, max(round(0.85::DOUBLE / b.n, 6)) AS strength FROM b JOIN sym y USING (file_id) GROUP BY b.task_id, y.symbol_id"""
ORACLE["anchors_literals"] = f"""WITH {SYM}, {_C}, {_STRONG}, rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY strength DESC, symbol_id) AS k FROM strong WHERE strength >= 0.9) WHERE k <= 5),
  lb AS (SELECT symbol_id, list_filter(list_concat(regexp_extract_all(body, '"([A-Za-z_/][\\w.:/-]{{3,63}})"', 1), regexp_extract_all(body, '\'\'([A-Za-z_/][\\w.:/-]{{3,63}})\'\'', 1)), lambda x: regexp_matches(x, '[-_./:0-9]|[a-z][A-Z]')) AS l FROM sym), lf AS (SELECT symbol_id, unnest(l) AS literal, unnest(range(len(l))) AS i FROM lb),
  lu AS (SELECT symbol_id, literal, row_number() OVER (PARTITION BY symbol_id ORDER BY min(i)) AS p FROM lf GROUP BY symbol_id, literal), ow AS (SELECT rt.task_id, rt.symbol_id AS root_id, rt.strength, rt.k, lu.p, lu.literal FROM rt JOIN lu USING (symbol_id) WHERE lu.p <= 12),
  fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, literal ORDER BY k, p) AS f FROM ow) WHERE f = 1), ke AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY k, p) AS c FROM fi) WHERE c <= 40),
  q AS (SELECT symbol_id, unnest(list_distinct(list_concat(regexp_extract_all(coalesce(search_text, ''), '"([^"\\n]{{3,80}})"', 1), regexp_extract_all(coalesce(search_text, ''), '\'\'([^\'\'\\n]{{3,80}})\'\'', 1)))) AS literal FROM sym WHERE NOT is_test),
  me AS (SELECT literal, symbol_id, count(*) OVER (PARTITION BY literal) AS n FROM q) SELECT ke.task_id, me.symbol_id, round(least(1 - exp(sum(ln(1 - 0.7::DOUBLE * ke.strength * sqrt(1 - me.n / 15)))), 0.7), 6) AS strength
  FROM ke JOIN me USING (literal) WHERE me.n > 1 AND me.n < 15 AND me.symbol_id <> ke.root_id GROUP BY ke.task_id, me.symbol_id"""
