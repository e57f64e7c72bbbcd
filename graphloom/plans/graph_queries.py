"""Queries of the graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.operators.references import package_of
from graphloom.session import checkpointed
from graphloom.tables import edges, live_nodes, read, symbols


def sym(spark: SparkSession, d: str) -> DataFrame:
    return symbols(read(spark, d, "graph_node"))


def edge(spark: SparkSession, d: str) -> DataFrame:
    return edges(read(spark, d, "graph_edge"))


def _direction(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = graph.neighbours(edge(spark, d), sym(spark, d), name)
        return out.drop("file_id", "line") if name not in ("referrers", "references") else out.drop("file_id", "line", "label")

    return query


def type_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    e, s = edge(spark, d), sym(spark, d)
    up = graph.neighbours(e, s, "supertypes").select("symbol_id", "neighbour_id", F.lit("super").alias("side"))
    return up.unionByName(graph.neighbours(e, s, "subtypes").select("symbol_id", "neighbour_id", F.lit("sub").alias("side"))).distinct()


def find_references_union_routes(spark: SparkSession, d: str) -> DataFrame:
    return graph.find_references(edge(spark, d), sym(spark, d))


def repo_of_symbol(spark: SparkSession, d: str) -> DataFrame:
    """The repository of each symbol; of one declared in several, the least."""
    return sym(spark, d).groupBy("symbol_id").agg(F.min(F.split("file_id", ":")[0]).alias("repo_id"))


def degree_all(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edge(spark, d))


def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edge(spark, d)).where(F.col("degree") >= 20).select("symbol_id", "degree")


def leaf_flags(spark: SparkSession, d: str) -> DataFrame:
    return graph.leaf_flags(edge(spark, d), sym(spark, d))


def counts_by_label(spark: SparkSession, d: str) -> DataFrame:
    nodes = live_nodes(read(spark, d, "graph_node")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("node"))
    return nodes.unionByName(edge(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("edge")))


def repo_stats(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each label and kind per repository."""
    kind = F.get_json_object("properties", "$.kind")
    return live_nodes(read(spark, d, "graph_node")).groupBy("repo_id", "label", F.coalesce(kind, F.lit("-")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    lang = F.get_json_object("properties", "$.language")
    return live_nodes(read(spark, d, "graph_node"), "File").groupBy("repo_id", F.coalesce(lang, F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


def _library(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "library_symbol").select("symbol_id")


def call_graph_2hop(spark: SparkSession, d: str) -> DataFrame:
    """Who calls each symbol of the shared library, directly or over one other."""
    return graph.call_graph(edge(spark, d), _library(spark, d), 2)


def call_graph_5hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_graph(edge(spark, d), _library(spark, d), 5)


def blast_radius_3(spark: SparkSession, d: str) -> DataFrame:
    return graph.blast_radius(edge(spark, d), _library(spark, d), 3)


def impact_dependents_2(spark: SparkSession, d: str) -> DataFrame:
    """Two levels of dependents with the frontier of a level cut to 50 per root."""
    steps = [("CALLS", "dst_id", "src_id"), ("REFERENCES", "dst_id", "src_id"), ("INHERITS", "dst_id", "src_id")]
    return graph.walk(edge(spark, d), _library(spark, d), 2, steps, keep=50)


def package_links(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "unresolved_ref").where(F.col("qualifier").isNotNull())
    return refs.select(package_of(F.col("qualifier")).alias("src"), F.col("package").alias("dst")).where("src <> dst").distinct()


def dependencies_closure(spark: SparkSession, d: str) -> DataFrame:
    """All packages that depend on a package of the shared library, directly or not."""
    roots = read(spark, d, "library_symbol").select(F.col("package").alias("node"))
    return graph.closure(package_links(spark, d), roots)


def ppr_reweight(spark: SparkSession, d: str) -> DataFrame:
    """Mass of each candidate in its task's graph, seeded by the anchors' strength."""
    from graphloom.operators.candidates import candidate_state

    rows = checkpointed(candidate_state(read(spark, d, "candidate")))
    nodes = rows.select("task_id", "symbol_id", F.when(F.col("anchor"), F.coalesce("anchor_strength", F.lit(1.0))).otherwise(0.0).alias("seed"))
    e = edge(spark, d).where(F.col("label") == "CALLS").select("src_id", "dst_id")
    ids = rows.select("task_id", F.col("symbol_id").alias("src_id"))
    found = ids.join(e, "src_id").join(rows.select("task_id", F.col("symbol_id").alias("dst_id")), ["task_id", "dst_id"])
    links = checkpointed(found.select("task_id", F.col("src_id").alias("a"), F.col("dst_id").alias("b")).distinct())
    return graph.ppr(nodes, links).select("task_id", "symbol_id", F.round("mass", 6).alias("mass"))


def ppr_factors(spark: SparkSession, d: str) -> DataFrame:
    """How a candidate's mass changes its evidence."""
    from graphloom.operators.candidates import candidate_state

    rows = candidate_state(read(spark, d, "candidate")).where(~F.coalesce("anchor", F.lit(False)))
    return graph.mass_factors(ppr_reweight(spark, d), rows.select("task_id", "symbol_id", F.col("source_strength").alias("strength")))


QUERIES = {f"{k}_1hop": _direction(k) for k in graph.DIRECTIONS} | {
    f.__name__: f
    for f in (
        type_hierarchy, find_references_union_routes, repo_of_symbol, degree_all, god_nodes, leaf_flags, counts_by_label, repo_stats, language_histogram,
        call_graph_2hop, call_graph_5hop, blast_radius_3, impact_dependents_2, dependencies_closure, ppr_reweight, ppr_factors,
    )
}

NODE = """node AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, node_id ORDER BY changed_at DESC, op DESC, properties DESC NULLS LAST, search_text DESC NULLS LAST) AS rn FROM graph_node) WHERE rn = 1 AND op = 'upsert')"""
SYM = NODE + """, sym AS (SELECT node_id AS symbol_id, json_extract_string(properties, '$.name') AS name, json_extract_string(properties, '$.kind') AS kind, json_extract_string(properties, '$.signature') AS signature,
  json_extract_string(properties, '$.package') AS package, json_extract_string(properties, '$.namespace') AS namespace, coalesce(json_extract_string(properties, '$.file_id'), file_id) AS file_id, repo_id,
  CAST(json_extract_string(properties, '$.line') AS INTEGER) AS line, CAST(json_extract_string(properties, '$.end_line') AS INTEGER) AS end_line, coalesce(CAST(json_extract_string(properties, '$.is_test') AS BOOLEAN), FALSE) AS is_test,
  json_extract_string(properties, '$.docstring') AS docstring, json_extract_string(properties, '$.body') AS body, json_extract_string(properties, '$.visibility') AS visibility, search_text, indexed_at_commit FROM node WHERE label = 'Symbol')"""
EDGE = "edge AS (SELECT label, src_id, dst_id, max(provenance) AS provenance, max(ref_kind) AS ref_kind, min(line) AS line FROM graph_edge WHERE dst_id IS NOT NULL GROUP BY label, src_id, dst_id)"


def _neighbour_sql(name: str) -> str:
    labels, given, found = graph.DIRECTIONS[name]
    inside = ", ".join(f"'{x}'" for x in labels)
    extra = "" if name in ("referrers", "references") else "e.label, "
    return f"WITH {SYM}, {EDGE} SELECT e.{given} AS symbol_id, e.{found} AS neighbour_id, {extra}s.name, e.provenance, e.ref_kind FROM edge e JOIN sym s ON s.symbol_id = e.{found} WHERE e.label IN ({inside})"


def _walk_sql(hops: int, labels: str, typed: bool = False, keep: int | None = None) -> str:
    """Levels as common table expressions, each without what an earlier one holds."""
    parts = ["l0 AS (SELECT DISTINCT symbol_id AS root_id, symbol_id, 0 AS depth, NULL AS via FROM library_symbol)", "v0 AS (SELECT * FROM l0)"]
    order = "CASE e.label WHEN 'CALLS' THEN '0CALLS' WHEN 'REFERENCES' THEN '1REFERENCES' WHEN 'INHERITS' THEN '2INHERITS' ELSE '3IMPLEMENTS' END"
    for i in range(1, hops + 1):
        cut = ", row_number() OVER (PARTITION BY f.root_id ORDER BY e.src_id) AS k" if keep else ""
        level = f"SELECT f.root_id, e.src_id AS symbol_id, {i} AS depth, substr(min({order}), 2) AS via{cut} FROM l{i - 1} f JOIN edge e ON e.dst_id = f.symbol_id AND e.label IN ({labels}) WHERE NOT EXISTS (SELECT 1 FROM v{i - 1} v WHERE v.root_id = f.root_id AND v.symbol_id = e.src_id) GROUP BY f.root_id, e.src_id"
        parts.append(f"l{i} AS (SELECT root_id, symbol_id, depth, via FROM ({level}){f' WHERE k <= {keep}' if keep else ''})")
        parts.append(f"v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT * FROM l{i})")
    return f"WITH {EDGE}, {', '.join(parts)} SELECT root_id, symbol_id, depth{', via' if keep else ', via AS edge_type' if typed else ''} FROM v{hops} WHERE depth > 0"


_CAND = "cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, symbol_id ORDER BY retrieved_at DESC) AS rn FROM candidate) WHERE rn = 1)"


def _ppr_sql() -> str:
    parts = []
    for i in range(1, 4):
        parts.append(f"f{i} AS (SELECT b.task_id, b.b AS symbol_id, sum(round(m.mass / o.k, 12)) AS f FROM both_ways b JOIN m{i - 1} m ON m.task_id = b.task_id AND m.symbol_id = b.a JOIN out_degree o ON o.task_id = b.task_id AND o.a = b.a GROUP BY b.task_id, b.b)")
        parts.append(f"m{i} AS (SELECT p.task_id, p.symbol_id, p.p, round(0.5 * p.p + 0.5 * coalesce(f.f, 0), 12) AS mass FROM base p LEFT JOIN f{i} f ON f.task_id = p.task_id AND f.symbol_id = p.symbol_id)")
    return f"""WITH {EDGE}, {_CAND}, n AS (SELECT task_id, symbol_id, CASE WHEN anchor THEN coalesce(anchor_strength, 1.0) ELSE 0.0 END AS seed FROM cand),
    base AS (SELECT task_id, symbol_id, round(coalesce(seed / nullif(sum(seed) OVER (PARTITION BY task_id), 0), 0), 12) AS p FROM n),
    link AS (SELECT DISTINCT x.task_id, e.src_id AS a, e.dst_id AS b FROM edge e JOIN n x ON x.symbol_id = e.src_id JOIN n y ON y.task_id = x.task_id AND y.symbol_id = e.dst_id WHERE e.label = 'CALLS' AND e.src_id <> e.dst_id),
    both_ways AS (SELECT * FROM link UNION SELECT task_id, b, a FROM link), out_degree AS (SELECT task_id, a, count(*) AS k FROM both_ways GROUP BY task_id, a),
    m0 AS (SELECT task_id, symbol_id, p, p AS mass FROM base), {", ".join(parts)} SELECT task_id, symbol_id, round(mass, 6) AS mass FROM m3"""


ORACLE = {f"{k}_1hop": _neighbour_sql(k) for k in graph.DIRECTIONS} | {
    "type_hierarchy": f"WITH {SYM}, {EDGE} SELECT DISTINCT e.src_id AS symbol_id, e.dst_id AS neighbour_id, 'super' AS side FROM edge e JOIN sym s ON s.symbol_id = e.dst_id WHERE e.label IN ('INHERITS', 'IMPLEMENTS') UNION ALL SELECT DISTINCT e.dst_id, e.src_id, 'sub' FROM edge e JOIN sym s ON s.symbol_id = e.src_id WHERE e.label IN ('INHERITS', 'IMPLEMENTS')",
    "find_references_union_routes": f"WITH {SYM}, {EDGE} SELECT e.dst_id AS symbol_id, e.src_id AS caller_id, e.label AS edge_type, s.line AS caller_line, e.line AS call_line FROM edge e JOIN sym s ON s.symbol_id = e.src_id WHERE e.label IN ('CALLS', 'REFERENCES') AND s.line IS NOT NULL",
    "repo_of_symbol": f"WITH {SYM} SELECT symbol_id, min(split_part(file_id, ':', 1)) AS repo_id FROM sym GROUP BY symbol_id",
    "degree_all": f"WITH {EDGE}, e AS (SELECT src_id AS id, 0 AS i, 1 AS o FROM edge UNION ALL SELECT dst_id, 1, 0 FROM edge) SELECT id AS symbol_id, count(*) AS degree, sum(i) AS n_in, sum(o) AS n_out FROM e GROUP BY id",
    "god_nodes": f"WITH {EDGE}, e AS (SELECT src_id AS id FROM edge UNION ALL SELECT dst_id FROM edge) SELECT id AS symbol_id, count(*) AS degree FROM e GROUP BY id HAVING count(*) >= 20",
    "leaf_flags": f"WITH {SYM}, {EDGE}, f AS (SELECT s.symbol_id, EXISTS (SELECT 1 FROM edge e WHERE e.label = 'CALLS' AND e.dst_id = s.symbol_id) AS has_callers, EXISTS (SELECT 1 FROM edge e WHERE e.label = 'CALLS' AND e.src_id = s.symbol_id) AS has_callees FROM sym s) SELECT *, has_callers AND NOT has_callees AS is_leaf FROM f",
    "counts_by_label": f"WITH {NODE}, {EDGE} SELECT label, count(*) AS n, 'node' AS what FROM node GROUP BY label UNION ALL SELECT label, count(*), 'edge' FROM edge GROUP BY label",
    "repo_stats": f"WITH {NODE} SELECT repo_id, label, coalesce(json_extract_string(properties, '$.kind'), '-') AS kind, count(*) AS n FROM node GROUP BY ALL",
    "language_histogram": f"WITH {NODE} SELECT repo_id, coalesce(json_extract_string(properties, '$.language'), 'unknown') AS language, count(*) AS n_files FROM node WHERE label = 'File' GROUP BY ALL",
    "call_graph_2hop": _walk_sql(2, "'CALLS'"),
    "call_graph_5hop": _walk_sql(5, "'CALLS'"),
    "blast_radius_3": _walk_sql(3, "'CALLS', 'REFERENCES', 'INHERITS', 'IMPLEMENTS'", typed=True),
    "impact_dependents_2": _walk_sql(2, "'CALLS', 'REFERENCES', 'INHERITS'", keep=50),
    "dependencies_closure": """WITH RECURSIVE link AS (SELECT DISTINCT replace(replace(replace(qualifier, ' ', ''), '::', '.'), '/', '.') AS src, package AS dst FROM unresolved_ref WHERE qualifier IS NOT NULL),
        reach(root, node, depth) USING KEY (root, node) AS (SELECT DISTINCT package, package, 0 FROM library_symbol UNION SELECT r.root, l.dst, r.depth + 1 FROM reach r JOIN link l ON l.src = r.node AND l.src <> l.dst LEFT JOIN recurring.reach k ON k.root = r.root AND k.node = l.dst WHERE k.node IS NULL)
        SELECT root, node, depth FROM reach WHERE depth > 0""",
    "ppr_reweight": _ppr_sql(),
    "ppr_factors": f"""WITH {_CAND}, x AS (SELECT c.task_id, c.symbol_id, p.mass / c.source_strength AS r FROM cand c JOIN ({_ppr_sql()}) p USING (task_id, symbol_id) WHERE NOT coalesce(c.anchor, FALSE) AND c.source_strength > 0),
        o AS (SELECT task_id, r, row_number() OVER (PARTITION BY task_id ORDER BY r, symbol_id) AS k, count(*) OVER (PARTITION BY task_id) AS n FROM x WHERE r > 0), m AS (SELECT task_id, r AS m FROM o WHERE k = n // 2 + 1)
        SELECT task_id, symbol_id, round(CASE WHEN r > 0 THEN least(greatest(1 + 0.25 * log2(r / m), 2 / 3.0::DOUBLE), 1.5) ELSE 2 / 3.0::DOUBLE END, 6) AS factor FROM x JOIN m USING (task_id)""",
}
