"""Queries of lookups, scopes, bounded views and rendering, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import indexing, lookup, render
from graphloom.plans import retrieval_queries as R
from graphloom.plans.graph_queries import _CAND, EDGE, NODE, SYM, edge, sym
from graphloom.plans.index_queries import ORACLE as INDEX_SQL
from graphloom.plans.index_queries import _CENSUS
from graphloom.plans.search_queries import _ISSUE, _NOURL, _STOP, _W, _low, _split, qualified_references
from graphloom.sources import parse
from graphloom.tables import live_nodes, read, read_wide


def resolve_query(spark: SparkSession, d: str) -> DataFrame:
    """What the places of unresolved references and the names of the shared library mean."""
    refs = read(spark, d, "unresolved_ref").where(F.col("line").isNotNull()).select(F.concat(F.regexp_replace("file_id", "^[^:]*:", ""), F.lit(":"), "line").alias("text"))
    texts = refs.unionByName(read(spark, d, "library_symbol").select(F.col("name").alias("text"))).distinct()
    return lookup.resolve(texts.withColumn("query_id", F.col("text")), sym(spark, d))


def resolve_repo_ids(spark: SparkSession, d: str) -> DataFrame:
    """Repositories of the documents in other spellings, found again among those of the commits."""
    docs = read(spark, d, "documents").where(F.col("repo_id").isNotNull()).select("repo_id").distinct()
    given = docs.select(F.explode(F.array("repo_id", F.upper("repo_id"), F.concat(F.regexp_replace("repo_id", "-", "_"), F.lit(".git")))).alias("given"))
    return lookup.resolve_repositories(given, read(spark, d, "repo_commit"))


def normalize_file_ids(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "source_file").select("file_id", "repo_id", "path").distinct()
    return f.select("path", lookup.normalised_file_id(F.col("repo_id"), F.col("path")).alias("file_id")).distinct()


def _scopes(spark: SparkSession, d: str) -> DataFrame:
    """Users by the last part of a repository's name."""
    return read(spark, d, "repo_commit").select(F.element_at(F.split("repo_id", "-"), -1).alias("user_id"), "repo_id").distinct()


def row_level_security(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the user "core" may see."""
    return lookup.visible(read(spark, d, "documents").select("doc_id", "repo_id"), _scopes(spark, d), "core")


def repo_graph(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = lookup.bounded_graph(live_nodes(read(spark, d, "graph_node")), edge(spark, d))
    return edges.groupBy("repo_id", "label").agg(F.count(F.lit(1)).alias("n_edges"))


def node_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Edges around each symbol of the shared library, at most 200 a direction."""
    return lookup.node_neighbours(read(spark, d, "library_symbol").select(F.col("symbol_id").alias("node_id")), edge(spark, d))


def search_names_paths(spark: SparkSession, d: str) -> DataFrame:
    terms = read(spark, d, "library_symbol").select(F.col("name").alias("term"))
    return lookup.search_names_and_paths(terms.unionByName(terms.select(F.element_at(F.split("term", "_"), -1).alias("term"))), sym(spark, d))


def file_imports(spark: SparkSession, d: str) -> DataFrame:
    return lookup.file_imports(parse.fragments(read_wide(spark, d, "source_file")))


def file_importers(spark: SparkSession, d: str) -> DataFrame:
    modules = sym(spark, d).where(F.col("file_id").isNotNull()).select(F.col("package").alias("module"), "file_id").distinct()
    return lookup.file_importers(file_imports(spark, d), modules)


def select_repos(spark: SparkSession, d: str) -> DataFrame:
    return lookup.select_repositories(R.cand(spark, d).where("anchor").select("task_id", "symbol_id"), sym(spark, d))


def suggest_change_sites(spark: SparkSession, d: str) -> DataFrame:
    """The selected symbols of each task with their place in the whole ranking."""
    ranked = R.demote_containers(spark, d).select("task_id", "symbol_id", F.col("rank").alias("pool_rank"))
    return R.narrow_k20(spark, d).join(ranked, ["task_id", "symbol_id"])


def context_trace(spark: SparkSession, d: str) -> DataFrame:
    """How many symbols of each task are left after every stage of the retrieval."""
    stages = [("pool", R.cand(spark, d)), ("scored", R.score_v4(spark, d)), ("scoped", R.scope_filtered_rank(spark, d)), ("returned", R._selected(spark, d))]
    out = None
    for i, (name, x) in enumerate(stages):
        n = x.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).select("task_id", F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def evidence_spans(spark: SparkSession, d: str) -> DataFrame:
    return render.evidence(R._items(spark, d)).drop("text")


def selector_questions(spark: SparkSession, d: str) -> DataFrame:
    return render.questions(R.files_summary(spark, d))


def render_compact(spark: SparkSession, d: str) -> DataFrame:
    items = R._selected(spark, d).join(sym(spark, d).select("symbol_id", "name", "line"), "symbol_id", "left")
    return render.compact(items, 1200)


def inspect_symbol_graph(spark: SparkSession, d: str) -> DataFrame:
    return render.inspected(read(spark, d, "library_symbol"), sym(spark, d), edge(spark, d))


def file_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Length of every file and of its outline with folded bodies."""
    files = read_wide(spark, d, "source_file").select("file_id", "source")
    return render.outlines(files, sym(spark, d)).select("file_id", F.length("outline").alias("n_chars"))


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.operators import pack
    from graphloom.plans.index_queries import index_coverage

    return pack.coverage_gaps(R._selected(spark, d).select("task_id", "symbol_id", "repo_id"), R.related_tests(spark, d), index_coverage(spark, d))


def task_text_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Issues that name code and issues of prose only."""
    from graphloom.functions import text as T
    from graphloom.operators.evaluation import text_bucket
    from graphloom.plans.search_queries import issues

    names = F.filter(T.tokens(F.col("text")), lambda t: T.looks_like_identifier(t))
    return issues(spark, d).groupBy(text_bucket(names).alias("bucket")).agg(F.count(F.lit(1)).alias("n_tasks"))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Index figures of each repository as JSON."""
    from graphloom.plans.index_queries import index_census

    g = index_census(spark, d).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("language", "files", "indexed"))).alias("languages"), F.sum("symbols").alias("symbols"))
    return g.select("repo_id", "symbols", F.to_json("languages").alias("stats"))


def churn_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every indexed file with its churn, 0 for files without."""
    files = live_nodes(read(spark, d, "graph_node"), "File").select(F.col("node_id").alias("file_id"))
    return indexing.filled_churn(R.churn_of(spark, d), files)


def reference_queries(spark: SparkSession, d: str) -> DataFrame:
    """What the qualified references of the issues mean, and the sources of unresolved references written with their owner."""
    s = sym(spark, d)
    sources = read(spark, d, "unresolved_ref").select(F.col("src_symbol_id").alias("symbol_id")).distinct()
    owned = s.where(F.length("namespace") > 0).join(sources, "symbol_id", "left_semi").select(F.concat_ws(".", "namespace", "name").alias("text"))
    texts = qualified_references(spark, d).select(F.col("reference").alias("text")).unionByName(owned).distinct()
    return lookup.resolve(texts.withColumn("query_id", F.col("text")), s)


QUERIES = {
    f.__name__: f
    for f in (
        resolve_query, resolve_repo_ids, normalize_file_ids, row_level_security, repo_graph, node_neighbors, search_names_paths, file_imports, file_importers, select_repos, suggest_change_sites, context_trace, evidence_spans,
        selector_questions, render_compact, inspect_symbol_graph, index_stats, churn_filled, reference_queries, file_outlines, coverage_gaps, task_text_buckets,
    )
}

_KEY = "replace(replace(replace(replace(regexp_replace(lower(regexp_replace({0}, '(?i)\\.git/?$', '')), '^.*/', ''), '-', ''), '_', ''), '.', ''), ' ', '')"
ORACLE = {
    "resolve_repo_ids": f"""WITH r AS (SELECT DISTINCT repo_id FROM repo_commit), g AS (SELECT DISTINCT unnest([repo_id, upper(repo_id), replace(repo_id, '-', '_') || '.git']) AS given FROM documents WHERE repo_id IS NOT NULL),
        x AS (SELECT g.given, e.repo_id AS exact, (SELECT min(repo_id) FROM r WHERE lower(r.repo_id) = lower(g.given)) AS c, (SELECT min(repo_id) FROM r WHERE {_KEY.format('r.repo_id')} = {_KEY.format('g.given')}) AS k FROM g LEFT JOIN r e ON e.repo_id = g.given)
        SELECT given, coalesce(exact, c, k, given) AS repo_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'case' WHEN k IS NOT NULL THEN 'key' ELSE 'given' END AS way FROM x""",
    "normalize_file_ids": "SELECT DISTINCT path, repo_id || ':' || regexp_replace(replace(path, '\\', '/'), '^[./]+', '') AS file_id FROM source_file",
    "row_level_security": "SELECT doc_id, repo_id FROM documents WHERE repo_id IN (SELECT repo_id FROM repo_commit WHERE string_split(repo_id, '-')[-1] = 'core')",
    "repo_graph": f"""WITH {NODE}, {EDGE}, n AS (SELECT DISTINCT repo_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, label ORDER BY node_id) AS k FROM node) WHERE k <= 5000), e AS (SELECT a.repo_id, e.label, row_number() OVER (PARTITION BY a.repo_id ORDER BY e.label, e.src_id, e.dst_id) AS k FROM edge e JOIN n a ON a.node_id = e.src_id JOIN n b ON b.node_id = e.dst_id AND b.repo_id = a.repo_id)
        SELECT repo_id, label, count(*) AS n_edges FROM e WHERE k <= 20000 GROUP BY repo_id, label""",
    "node_neighbors": f"""WITH {EDGE}, b AS (SELECT src_id AS node_id, 'out' AS direction, label, dst_id AS other_id FROM edge UNION ALL SELECT dst_id, 'in', label, src_id FROM edge), m AS (SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY label, other_id) AS k FROM b WHERE node_id IN (SELECT symbol_id FROM library_symbol)) SELECT node_id, direction, label, other_id FROM m WHERE k <= 200""",
    "select_repos": f"WITH {SYM}, {_CAND} SELECT DISTINCT c.task_id, s.repo_id FROM cand c JOIN sym s USING (symbol_id) WHERE c.anchor AND s.repo_id IS NOT NULL",
    "inspect_symbol_graph": f"""WITH {SYM}, {EDGE}, lib AS (SELECT DISTINCT symbol_id FROM library_symbol), u AS (SELECT s.symbol_id, 'definition' AS section, s.file_id AS other_id, s.line FROM sym s SEMI JOIN lib USING (symbol_id) UNION SELECT dst_id, 'callers', src_id, line FROM edge WHERE label = 'CALLS' UNION SELECT src_id, 'callees', dst_id, line FROM edge WHERE label = 'CALLS'
        UNION SELECT dst_id, 'references', src_id, line FROM edge WHERE label = 'REFERENCES' UNION SELECT dst_id, 'subtypes', src_id, line FROM edge WHERE label IN ('INHERITS', 'IMPLEMENTS'))
        SELECT symbol_id, section, other_id, line FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id, section ORDER BY other_id, coalesce(line, 0)) AS k FROM u SEMI JOIN lib USING (symbol_id)) WHERE k <= 20""",
    "task_text_buckets": f"""WITH {_ISSUE}, t AS (SELECT task_id, unnest(regexp_extract_all({_NOURL.format('text')}, '{_W}', 1)) AS w FROM issue), i AS (SELECT DISTINCT task_id FROM t WHERE length(w) >= 3 AND {_low('w')} NOT IN ({_STOP}) AND (regexp_matches(w, '[^_]_[^_]') OR regexp_matches(w, '[0-9]') OR regexp_matches(w, '[a-z][A-Z]') OR (regexp_matches(w, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') AND length(w) >= 4)))
        SELECT CASE WHEN i.task_id IS NULL THEN 'prose_only' ELSE 'names_code' END AS bucket, count(*) AS n_tasks FROM issue LEFT JOIN i USING (task_id) GROUP BY 1""",
    "churn_filled": f"WITH {NODE}, c AS (SELECT repo_id, commit_id FROM (SELECT *, max(seq) OVER (PARTITION BY repo_id) AS top FROM repo_commit) WHERE seq > top - 500), n AS (SELECT p.ref_id AS file_id, count(DISTINCT p.indexed_at_commit) AS n FROM pending_chunk p JOIN c ON c.repo_id = p.repo_id AND c.commit_id = p.indexed_at_commit WHERE p.kind = 'file' GROUP BY p.ref_id) SELECT node_id AS file_id, coalesce(n, 0) AS churn FROM node LEFT JOIN n ON n.file_id = node_id WHERE label = 'File'",
    "context_trace": f"""WITH {R._SCORED}, scope AS (SELECT DISTINCT task_id, repo_id FROM cand WHERE anchor), s AS (SELECT task_id, 0 AS stage_no, 'pool' AS stage, count(*) AS n FROM cand GROUP BY task_id UNION ALL SELECT task_id, 1, 'scored', count(*) FROM scored GROUP BY task_id
        UNION ALL SELECT task_id, 2, 'scoped', count(*) FROM scored JOIN scope USING (task_id, repo_id) GROUP BY task_id UNION ALL SELECT task_id, 3, 'returned', count(*) FROM ranked WHERE rank <= 20 GROUP BY task_id) SELECT * FROM s""",
}
_PLACED = "SELECT query_id, symbol_id, way, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_test, o, symbol_id) AS place FROM found) WHERE place <= 50"
_INSIDE = "string_split(string_split(s.symbol_id, '#')[1], '::')[-2]"
ORACLE |= {
    "resolve_query": f"""WITH {SYM}, pl AS (SELECT DISTINCT regexp_replace(file_id, '^[^:]*:', '') AS path, line FROM unresolved_ref WHERE line IS NOT NULL), sp AS (SELECT *, lower(regexp_replace(file_id, '^[^:]*:', '')) AS path FROM sym WHERE end_line IS NOT NULL AND file_id IS NOT NULL),
        found AS (SELECT p.path || ':' || p.line AS query_id, s.symbol_id, 'place' AS way, s.end_line - s.line AS o, s.is_test FROM pl p JOIN sp s ON (s.path = lower(p.path) OR ends_with(s.path, '/' || lower(p.path))) AND s.line <= p.line AND s.end_line >= p.line
        UNION SELECT l.name, s.symbol_id, 'name', 0, s.is_test FROM library_symbol l JOIN sym s ON s.name = l.name) {_PLACED}""",
    "reference_queries": f"""WITH {SYM}, {_ISSUE}, r AS (SELECT DISTINCT unnest(regexp_extract_all({_NOURL.format('text')}, '([A-Za-z_][A-Za-z0-9_]*(?:[.:]{{1,2}}[A-Za-z_][A-Za-z0-9_]*)+)', 1)) AS t FROM issue UNION SELECT namespace || '.' || name FROM sym WHERE length(namespace) > 0 AND symbol_id IN (SELECT src_symbol_id FROM unresolved_ref)),
        p AS (SELECT t, string_split(regexp_replace(t, '[.:]+', '.', 'g'), '.') AS p FROM r), m AS (SELECT p.t AS query_id, s.symbol_id, s.is_test, coalesce({_INSIDE} = p.p[-2], FALSE) AS own FROM p JOIN sym s ON s.name = p.p[-1]),
        found AS (SELECT query_id, symbol_id, CASE WHEN own THEN 'member' ELSE 'name' END AS way, 0 AS o, is_test FROM (SELECT *, bool_or(own) OVER (PARTITION BY query_id) AS anyone FROM m) WHERE own OR NOT anyone) {_PLACED}""",
    "search_names_paths": f"""WITH {SYM}, t AS (SELECT DISTINCT lower(name) AS term FROM library_symbol UNION SELECT lower(string_split(name, '_')[-1]) FROM library_symbol), w AS (SELECT symbol_id, unnest(list_distinct(list_concat([lower(name)], {_split('name')}))) AS term FROM sym),
        fp AS (SELECT DISTINCT file_id, regexp_replace(file_id, '^[^:]*:', '') AS path FROM sym WHERE file_id IS NOT NULL), fw AS (SELECT file_id, unnest(list_distinct({_split('path')})) AS term FROM fp), u AS (SELECT term, 'symbol' AS kind, symbol_id AS id FROM w SEMI JOIN t USING (term) UNION SELECT term, 'file', file_id FROM fw SEMI JOIN t USING (term))
        SELECT term, kind, id, place FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY kind DESC, id) AS place FROM u) WHERE place <= 50""",
    "index_stats": f"WITH {SYM}, {_CENSUS} SELECT repo_id, sum(symbols) AS symbols, CAST(to_json(list({{'language': language, 'files': files, 'indexed': indexed}} ORDER BY language, files, indexed)) AS VARCHAR) AS stats FROM census GROUP BY repo_id",
    "coverage_gaps": f"""WITH sel AS (WITH {R._SCORED} SELECT task_id, symbol_id, repo_id FROM ranked WHERE rank <= 20), n AS (SELECT task_id, count(*) AS n FROM sel GROUP BY task_id), rt AS (SELECT DISTINCT task_id FROM ({R.ORACLE['related_tests']})), ic AS ({INDEX_SQL['index_coverage']}),
        po AS (SELECT task_id, list_sort(list(DISTINCT repo_id))[1:3] AS u FROM sel WHERE repo_id IN (SELECT repo_id FROM ic WHERE status = 'unsupported') GROUP BY task_id), x AS (SELECT n.task_id, n.n >= 20 AS truncated, rt.task_id IS NULL AS missing_tests, coalesce(array_to_string(po.u, ','), '') AS unsupported FROM n LEFT JOIN rt USING (task_id) LEFT JOIN po USING (task_id))
        SELECT *, CASE WHEN truncated OR missing_tests OR unsupported <> '' THEN 'partial' ELSE 'complete' END AS state FROM x""",
    "selector_questions": f"SELECT task_id, file_id, CAST(to_json({{'best_score': best_score, 'file_id': file_id, 'n_symbols': n_symbols, 'names': names, 'pos': pos}}) AS VARCHAR) AS question FROM ({R.ORACLE['files_summary']})",
    "render_compact": f"""WITH RECURSIVE {SYM}, {R._SCORED}, l AS (SELECT r.task_id, r.rank AS slot, '- ' || coalesce(s.name, r.symbol_id) || ' (' || coalesce(r.file_id, '?') || ':' || coalesce(CAST(s.line AS VARCHAR), '?') || ')' AS t FROM ranked r LEFT JOIN sym s USING (symbol_id) WHERE r.rank <= 20),
        md AS (SELECT DISTINCT task_id, 0 AS slot, '' AS markdown, 0 AS shown, 0 AS left_out FROM l UNION ALL SELECT l.task_id, l.slot, CASE WHEN length(m.markdown) + length(l.t) + 1 <= 1200 THEN m.markdown || l.t || chr(10) ELSE m.markdown END,
          m.shown + CAST(length(m.markdown) + length(l.t) + 1 <= 1200 AS INTEGER), m.left_out + CAST(length(m.markdown) + length(l.t) + 1 > 1200 AS INTEGER) FROM md m JOIN l ON l.task_id = m.task_id AND l.slot = m.slot + 1)
        SELECT task_id, markdown, shown, left_out FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY slot DESC) AS k FROM md) WHERE k = 1""",
}
