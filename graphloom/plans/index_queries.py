"""Queries of linking, index state, jobs and snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import indexing, linking
from graphloom.operators.references import package_of
from graphloom.plans.graph_queries import EDGE, NODE, SYM, edge, sym
from graphloom.plans.retrieval_queries import churn_of
from graphloom.plans.search_queries import _TESTPATH
from graphloom.sources import parse, scan
from graphloom.streaming import jobs
from graphloom.tables import latest, live_nodes, read


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "unresolved_ref")


def link_refs_priority(spark: SparkSession, d: str) -> DataFrame:
    return linking.link_references(_refs(spark, d), sym(spark, d))


def link_stats(spark: SparkSession, d: str) -> DataFrame:
    """References seen and resolved, per kind."""
    linked = link_refs_priority(spark, d).select("ref_id").distinct().withColumn("ok", F.lit(True))
    refs = _refs(spark, d).select("ref_id", "kind").distinct()
    return refs.join(linked, "ref_id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("refs"), F.count("ok").alias("resolved"))


def module_to_file(spark: SparkSession, d: str) -> DataFrame:
    modules = _refs(spark, d).where(F.col("qualifier").isNotNull()).select(package_of(F.col("qualifier")).alias("module"))
    return linking.modules_to_files(sym(spark, d), modules)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed pairs of names: calls that an index of the compiler has seen."""
    e = edge(spark, d).where(F.col("provenance") == "scip").select("src_id", "dst_id")
    s = sym(spark, d).select("symbol_id", "name")
    return e.join(s.select(F.col("symbol_id").alias("src_id"), F.col("name").alias("src_name")), "src_id").join(s.select(F.col("symbol_id").alias("dst_id"), F.col("name").alias("dst_name")), "dst_id").select("src_name", "dst_name").distinct()


def scip_unambiguous(spark: SparkSession, d: str) -> DataFrame:
    return linking.confirmed_edges(_pairs(spark, d), sym(spark, d))


def scip_elevation(spark: SparkSession, d: str) -> DataFrame:
    out = linking.elevated(edge(spark, d), sym(spark, d), _pairs(spark, d))
    return out.groupBy("label", "provenance").agg(F.count(F.lit(1)).alias("n"))


def bridge_join(spark: SparkSession, d: str) -> DataFrame:
    """Public native symbols that scripts refer to by name."""
    s = sym(spark, d).withColumn("language", F.split("symbol_id", "::")[0])
    native = s.where(F.col("language").isin("cpp", "rust", "csharp") & (F.col("visibility") == "public")).select("name", "symbol_id")
    script = s.where(F.col("language").isin("javascript", "typescript")).select("symbol_id")
    used = _refs(spark, d).where(F.col("name").isNotNull()).select("name", F.col("src_symbol_id").alias("symbol_id")).join(script, "symbol_id", "left_semi")
    return linking.bridges(native, used)


def note_asof_join(spark: SparkSession, d: str) -> DataFrame:
    notes = live_nodes(read(spark, d, "graph_node"), "DesignNote").select(F.col("node_id").alias("note_id"), "file_id", F.get_json_object("properties", "$.line").cast("int").alias("line"))
    return linking.nearest_symbol(notes, sym(spark, d))


def design_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes of each symbol, in the order of their lines."""
    notes = live_nodes(read(spark, d, "graph_node"), "DesignNote").select(F.col("node_id").alias("note_id"), F.get_json_object("properties", "$.kind").alias("kind"), F.get_json_object("properties", "$.text").alias("text"))
    return note_asof_join(spark, d).join(notes, "note_id")


def hunk_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Innermost symbols around the three lines from each unresolved reference on."""
    hunks = _refs(spark, d).where(F.col("line").isNotNull()).select(F.col("ref_id").alias("hunk_id"), "file_id", F.col("line").alias("first"), (F.col("line") + 2).alias("last"))
    return linking.changed_symbols(hunks, sym(spark, d))


def churn_last_500(spark: SparkSession, d: str) -> DataFrame:
    return churn_of(spark, d)


def _source_files(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "source_file").select("file_id", "repo_id", F.coalesce("language", F.lit("unknown")).alias("language"))


def index_census(spark: SparkSession, d: str) -> DataFrame:
    return indexing.census(_source_files(spark, d), sym(spark, d))


def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    return indexing.index_coverage(index_census(spark, d))


def job_fsm_state(spark: SparkSession, d: str) -> DataFrame:
    return latest(read(spark, d, "index_run"), ["run_id"], "recorded_at", ["status", "repo_id", "started_at", "finished_at"])


def job_claim_oldest(spark: SparkSession, d: str) -> DataFrame:
    return indexing.claimable(job_fsm_state(spark, d))


def repo_watermark(spark: SparkSession, d: str) -> DataFrame:
    """The last commit a succeeded run reached, per repository."""
    done = latest(read(spark, d, "index_run"), ["run_id"], "recorded_at", ["status", "repo_id", "to_commit"]).where(F.col("status") == "succeeded")
    c = read(spark, d, "repo_commit").select("repo_id", F.substring("commit_id", 1, 12).alias("c"), "seq", "commit_id").distinct()
    return done.withColumn("c", F.substring("to_commit", 1, 12)).join(c, ["repo_id", "c"]).groupBy("repo_id").agg(F.max(F.struct("seq", "commit_id")).alias("m")).select("repo_id", F.col("m.seq").alias("seq"), F.col("m.commit_id").alias("commit_id"))


def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    """The node snapshot at the middle of 2024 merged with everything later: the same state as folding the whole log."""
    log = read(spark, d, "graph_node")
    cut = F.lit("2024-07-01 00:00:00").cast("timestamp_ntz")
    values = ["op", "properties", "search_text", "repo_id", "file_id", "indexed_at_commit"]
    old = latest(log.where(F.col("changed_at") < cut), ["label", "node_id"], "changed_at", values)
    new = latest(log.where(F.col("changed_at") >= cut), ["label", "node_id"], "changed_at", values)
    return indexing.merged(old, new, ["label", "node_id"]).where(F.col("op") == "upsert").select("label", "node_id", "changed_at", "repo_id")


def delete_file_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the symbols without the files that are test files."""
    from graphloom.functions import text as T

    gone = live_nodes(read(spark, d, "graph_node"), "File").where(T.is_test_path(F.regexp_replace("node_id", r"^[^:]*:", ""))).select(F.col("node_id").alias("file_id"))
    return indexing.without_files(sym(spark, d), gone).select("symbol_id", "file_id")


def chunk_versions(spark: SparkSession, d: str) -> DataFrame:
    """Newest version of each embedding chunk by commit order."""
    p = read(spark, d, "pending_chunk").join(read(spark, d, "repo_commit").select("repo_id", F.col("commit_id").alias("indexed_at_commit"), "seq").distinct(), ["repo_id", "indexed_at_commit"])
    g = p.groupBy("repo_id", "kind", "ref_id", "chunk").agg(F.max(F.struct("seq", "queued_at", "pending_id")).alias("m"))
    return g.select("repo_id", "kind", "ref_id", "chunk", F.col("m.seq").alias("seq"), F.col("m.pending_id").alias("pending_id"))


def parse_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Records that parsing all source files gives, by kind and language."""
    out = parse.fragments(read(spark, d, "source_file"))
    return out.groupBy("record", F.coalesce("kind", F.lit("-")).alias("kind"), F.coalesce(scan.language_of(F.col("file_id")), F.lit("-")).alias("language")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files"))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files added since the middle of 2024, by the scans before and after."""
    f = read(spark, d, "source_file").select("file_id", "source", "scanned_at")
    cut = F.lit("2024-07-01 00:00:00").cast("timestamp_ntz")
    return scan.snapshot_changes(f.where(F.col("scanned_at") < cut), f).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of every symbol's text under its header."""
    s = sym(spark, d)
    items = s.select(F.col("symbol_id").alias("ref_id"), F.concat_ws(" ", "name", "signature").alias("header"), F.col("search_text").alias("text"))
    return scan.chunks(items).select("ref_id", "chunk", F.length("content").alias("n_chars"))


def full_index(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a first index of the scanned files, by repository and label."""
    from graphloom.operators import index_job
    from graphloom.session import scratch_path
    from graphloom.sources.versioned import VersionedTable
    from graphloom.tables import read_wide

    table = VersionedTable(spark, scratch_path(spark, "index"))
    index_job.index(table, read_wide(spark, d, "source_file"))
    return index_job.nodes(table.rows()).groupBy("repo_id", "label").agg(F.count_distinct("node_id").alias("n_nodes"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return jobs.windowed_counts(read(spark, d, "events"), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (
        link_refs_priority, link_stats, module_to_file, scip_unambiguous, scip_elevation, bridge_join, note_asof_join, design_notes, hunk_interval_join, churn_last_500, index_census, index_coverage, job_fsm_state, job_claim_oldest,
        repo_watermark, incremental_merge, delete_file_subgraph, chunk_versions, parse_fragments, snapshot_diff, embed_chunks, full_index, event_windows,
    )
}

_LINK = """ex0 AS (SELECT symbol_id AS target_id, string_split(package, '.') AS parts, unnest(list_filter([name, CASE WHEN length(namespace) > 0 THEN namespace || '.' || name END], lambda x: x IS NOT NULL)) AS name FROM sym WHERE package IS NOT NULL AND name IS NOT NULL),
  ex1 AS (SELECT target_id, name, parts, unnest(range(len(parts))) AS rank FROM ex0), ex AS (SELECT target_id, name, rank, array_to_string(parts[rank + 1:], '.') AS package FROM ex1),
  kn AS (SELECT DISTINCT ref_id, src_symbol_id, name, qualifier, package, CASE kind WHEN 'call' THEN 'CALLS' WHEN 'reference' THEN 'REFERENCES' WHEN 'inherits' THEN 'INHERITS' WHEN 'implements' THEN 'IMPLEMENTS' END AS label FROM unresolved_ref WHERE name IS NOT NULL AND src_symbol_id IS NOT NULL),
  tr AS (SELECT ref_id, src_symbol_id, name, label, 0 AS way, replace(replace(replace(qualifier, ' ', ''), '::', '.'), '/', '.') AS package FROM kn WHERE qualifier IS NOT NULL AND label IS NOT NULL UNION ALL SELECT ref_id, src_symbol_id, name, label, 1, package FROM kn WHERE label IS NOT NULL),
  linked AS (SELECT * FROM (SELECT tr.*, ex.target_id, ex.rank, row_number() OVER (PARTITION BY ref_id, label, src_symbol_id ORDER BY ex.rank, way, ex.target_id) AS k FROM tr JOIN ex USING (package, name) WHERE ex.target_id <> tr.src_symbol_id) WHERE k = 1)"""
_PAIRS = "pair AS (SELECT DISTINCT a.name AS src_name, b.name AS dst_name FROM edge e JOIN sym a ON a.symbol_id = e.src_id JOIN sym b ON b.symbol_id = e.dst_id WHERE e.provenance = 'scip')"
_NOTE = "note AS (SELECT node_id AS note_id, file_id, CAST(json_extract_string(properties, '$.line') AS INTEGER) AS at_line, json_extract_string(properties, '$.kind') AS kind, json_extract_string(properties, '$.text') AS text FROM node WHERE label = 'DesignNote')"
_NEAR = """near AS (SELECT note_id, coalesce(arg_min(symbol_id, (line, symbol_id)) FILTER (WHERE line >= at_line), arg_min(symbol_id, (-line, symbol_id)) FILTER (WHERE line < at_line)) AS symbol_id FROM note n JOIN sym s ON s.file_id = n.file_id WHERE s.line IS NOT NULL GROUP BY note_id)"""
_CENSUS = "f AS (SELECT file_id, max((repo_id, coalesce(language, 'unknown'))) AS r FROM source_file GROUP BY file_id), f2 AS (SELECT file_id, r[1] AS repo_id, r[2] AS language FROM f), n AS (SELECT file_id, count(*) AS n FROM sym GROUP BY file_id), census AS (SELECT repo_id, language, count(*) AS files, count(n) AS indexed, sum(coalesce(n, 0)) AS symbols FROM f2 LEFT JOIN n USING (file_id) GROUP BY repo_id, language)"
_STATE = "state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY recorded_at DESC, status DESC) AS k FROM index_run) WHERE k = 1)"

ORACLE = {
    "link_refs_priority": f"WITH {SYM}, {_LINK} SELECT ref_id, label, src_symbol_id, target_id, CASE WHEN rank > 0 THEN 'suffix' WHEN way = 0 THEN 'qualifier' ELSE 'package' END AS how FROM linked",
    "link_stats": f"WITH {SYM}, {_LINK} SELECT kind, count(*) AS refs, count(l.ref_id) AS resolved FROM (SELECT DISTINCT ref_id, kind FROM unresolved_ref) r LEFT JOIN (SELECT DISTINCT ref_id FROM linked) l USING (ref_id) GROUP BY kind",
    "module_to_file": f"WITH {SYM}, m AS (SELECT DISTINCT replace(replace(replace(qualifier, ' ', ''), '::', '.'), '/', '.') AS module FROM unresolved_ref WHERE qualifier IS NOT NULL), f AS (SELECT package AS module, min(file_id) AS file_id FROM sym WHERE file_id IS NOT NULL GROUP BY package HAVING count(DISTINCT file_id) = 1) SELECT module, file_id FROM m JOIN f USING (module)",
    "scip_unambiguous": f"WITH {SYM}, {EDGE}, {_PAIRS}, one AS (SELECT name, min(symbol_id) AS id, min(kind) AS kind FROM sym GROUP BY name HAVING count(*) = 1) SELECT DISTINCT CASE WHEN b.kind IN ('function', 'method', 'constructor') THEN 'CALLS' ELSE 'REFERENCES' END AS label, a.id AS src_id, b.id AS dst_id FROM pair p JOIN one a ON a.name = p.src_name JOIN one b ON b.name = p.dst_name WHERE a.id <> b.id",
    "scip_elevation": f"WITH {SYM}, {EDGE}, {_PAIRS} SELECT e.label, CASE WHEN p.src_name IS NOT NULL THEN 'scip' ELSE e.provenance END AS provenance, count(*) AS n FROM edge e LEFT JOIN sym a ON a.symbol_id = e.src_id LEFT JOIN sym b ON b.symbol_id = e.dst_id LEFT JOIN pair p ON p.src_name = a.name AND p.dst_name = b.name GROUP BY 1, 2",
    "bridge_join": f"WITH {SYM}, s AS (SELECT *, string_split(symbol_id, '::')[1] AS lang FROM sym), u AS (SELECT DISTINCT r.name, r.src_symbol_id FROM unresolved_ref r JOIN s ON s.symbol_id = r.src_symbol_id WHERE s.lang IN ('javascript', 'typescript')) SELECT DISTINCT 'CALLS' AS label, u.src_symbol_id AS src_id, n.symbol_id AS dst_id, 'heuristic' AS provenance, 'bridge' AS synthesized_by FROM u JOIN s n ON n.name = u.name AND n.lang IN ('cpp', 'rust', 'csharp') AND n.visibility = 'public' WHERE n.symbol_id <> u.src_symbol_id",
    "note_asof_join": f"WITH {SYM}, {_NOTE}, {_NEAR} SELECT * FROM near",
    "design_notes": f"WITH {SYM}, {_NOTE}, {_NEAR} SELECT near.note_id, near.symbol_id, note.kind, note.text FROM near JOIN note USING (note_id)",
    "hunk_interval_join": f"""WITH {SYM}, h AS (SELECT DISTINCT ref_id AS hunk_id, file_id, line AS a, line + 2 AS b FROM unresolved_ref WHERE line IS NOT NULL), x AS (SELECT h.hunk_id, s.symbol_id, s.line AS s, s.end_line AS e FROM h JOIN sym s ON s.file_id = h.file_id AND s.line <= h.b AND s.end_line >= h.a)
        SELECT hunk_id, symbol_id FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.hunk_id = x.hunk_id AND y.symbol_id <> x.symbol_id AND x.s <= y.s AND x.e >= y.e AND (x.s < y.s OR x.e > y.e))""",
    "churn_last_500": "WITH c AS (SELECT repo_id, commit_id FROM (SELECT *, max(seq) OVER (PARTITION BY repo_id) AS top FROM repo_commit) WHERE seq > top - 500) SELECT p.ref_id AS file_id, p.repo_id, count(DISTINCT p.indexed_at_commit) AS commits FROM pending_chunk p JOIN c ON c.repo_id = p.repo_id AND c.commit_id = p.indexed_at_commit WHERE p.kind = 'file' GROUP BY p.ref_id, p.repo_id",
    "index_census": f"WITH {SYM}, {_CENSUS} SELECT * FROM census",
    "index_coverage": f"""WITH {SYM}, {_CENSUS}, t AS (SELECT repo_id, sum(files) AS files, sum(indexed) AS indexed FROM census GROUP BY repo_id), w AS (SELECT c.repo_id, arg_min(c.language, (c.indexed - c.files, c.language)) AS weakest FROM census c JOIN t USING (repo_id) WHERE c.files >= 0.02 * t.files AND c.indexed < 0.5 * c.files GROUP BY c.repo_id)
        SELECT repo_id, files, indexed, round(indexed / files, 4) AS ratio, CASE WHEN round(indexed / files, 4) < 0.2 THEN 'unsupported' WHEN round(indexed / files, 4) < 0.95 THEN 'partial' ELSE 'full' END AS status, weakest FROM t LEFT JOIN w USING (repo_id)""",
    "job_fsm_state": f"WITH {_STATE} SELECT run_id, recorded_at, status, repo_id, started_at, finished_at FROM state",
    "job_claim_oldest": f"WITH {_STATE}, d AS (SELECT repo_id, max(started_at) AS done_at FROM state WHERE status = 'succeeded' GROUP BY repo_id) SELECT repo_id, run_id, started_at FROM (SELECT s.*, row_number() OVER (PARTITION BY s.repo_id ORDER BY s.started_at, s.run_id) AS r FROM state s LEFT JOIN d USING (repo_id) WHERE s.status = 'running' AND (d.done_at IS NULL OR s.started_at > d.done_at)) WHERE r = 1",
    "repo_watermark": f"WITH {_STATE} SELECT s.repo_id, max(c.seq) AS seq, arg_max(c.commit_id, c.seq) AS commit_id FROM state s JOIN repo_commit c ON c.repo_id = s.repo_id AND substr(c.commit_id, 1, 12) = substr(s.to_commit, 1, 12) WHERE s.status = 'succeeded' GROUP BY s.repo_id",
    "delete_file_subgraph": f"""WITH {SYM}, gone AS (SELECT node_id AS file_id FROM node WHERE label = 'File' AND {_TESTPATH.format("regexp_replace(node_id, '^[^:]*:', '')")}) SELECT symbol_id, file_id FROM sym WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM gone)""",
    "snapshot_diff": "SELECT 'A' AS status, count(DISTINCT file_id) AS n FROM source_file WHERE file_id NOT IN (SELECT file_id FROM source_file WHERE scanned_at < TIMESTAMP '2024-07-01 00:00:00') HAVING count(*) > 0",
    "event_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "incremental_merge": f"WITH {NODE} SELECT label, node_id, changed_at, repo_id FROM node",
    "chunk_versions": "SELECT repo_id, kind, ref_id, chunk, seq, pending_id FROM (SELECT p.*, c.seq, row_number() OVER (PARTITION BY p.repo_id, p.kind, p.ref_id, p.chunk ORDER BY c.seq DESC, p.queued_at DESC, p.pending_id DESC) AS k FROM pending_chunk p JOIN repo_commit c ON c.repo_id = p.repo_id AND c.commit_id = p.indexed_at_commit) WHERE k = 1",
}
