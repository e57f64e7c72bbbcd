"""Queries of the general data operators: heavy keys, new records, orphan references; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import heavy_keys as hk
from graphloom.operators import incremental, references
from graphloom.tables import read

#: Distinct (label, src_id) from which a target counts as a hub.
HUB_MEMBERS = 50


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    counts = hk.distinct_counts(read(spark, d, "graph_edge"), "dst_id", ["label", "src_id"])
    return counts.where(F.col("n_distinct") >= HUB_MEMBERS).select("dst_id")


def p5_edge_profile(spark: SparkSession, d: str) -> DataFrame:
    """Complete results per target: rows, sightings by label, first and last sighting, rows seen late."""
    late = F.col("seen_at") > F.col("linked_at") + F.expr("INTERVAL 7 DAYS")
    partial = {
        "_rows": F.count(F.lit(1)), "_calls": F.count(F.when(F.col("label") == "CALLS", 1)), "_refs": F.count(F.when(F.col("label") == "REFERENCES", 1)),
        "_late": F.count(F.when(late, 1)), "_first": F.min("linked_at"), "_last": F.max("seen_at"),
    }
    final = {
        "n_rows": F.sum("_rows"), "n_calls": F.sum("_calls"), "n_references": F.sum("_refs"), "n_late": F.sum("_late"), "first_linked": F.min("_first"), "last_seen": F.max("_last"),
    }
    return hk.aggregate(read(spark, d, "graph_edge").select("dst_id", "label", "linked_at", "seen_at", "src_id"), "dst_id", partial, final)


def p5_candidate_profile(spark: SparkSession, d: str) -> DataFrame:
    """Complete results per candidate symbol: rows, greatest degree, tasks that name it."""
    rows = read(spark, d, "candidate").select("symbol_id", "degree", "task_id")
    partial = {"_rows": F.count(F.lit(1)), "_degree": F.max("degree")}
    heavy = hk.heavy_keys(rows, "symbol_id")
    profile = hk.aggregate(rows, "symbol_id", partial, {"n_rows": F.sum("_rows"), "degree": F.max("_degree")}, heavy)
    tasks = hk.distinct_counts(rows, "symbol_id", ["task_id"], heavy).select("symbol_id", F.col("n_distinct").alias("n_tasks"))
    return profile.join(tasks, "symbol_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.new_or_changed(spark, f"{d}/pending_chunk.parquet", read(spark, d, "index_run"), read(spark, d, "repo_commit")).select("pending_id").distinct()


def p6_pending_by_repo(spark: SparkSession, d: str) -> DataFrame:
    rows = incremental.new_or_changed(spark, f"{d}/pending_chunk.parquet", read(spark, d, "index_run"), read(spark, d, "repo_commit"))
    return rows.distinct().groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("n_records"), F.min("queued_at").alias("oldest"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(read(spark, d, "unresolved_ref"), read(spark, d, "graph_node"), read(spark, d, "library_symbol"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_id", "side").distinct()


def p7_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d), read(spark, d, "unresolved_ref"))


QUERIES = {
    f.__name__: f for f in (p5_found, p5_edge_profile, p5_candidate_profile, p6_found, p6_pending_by_repo, p7_found, p7_orphan_report)
}

_RUNS = """
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY recorded_at DESC, status DESC) AS rn FROM index_run) WHERE rn = 1 AND status = 'succeeded'),
span AS (SELECT r.repo_id, coalesce(f.seq, 0) AS from_seq, t.seq AS to_seq, r.started_at FROM run r
  JOIN repo_commit t ON t.repo_id = r.repo_id AND substr(t.commit_id, 1, 12) = substr(r.to_commit, 1, 12)
  LEFT JOIN repo_commit f ON f.repo_id = r.repo_id AND substr(f.commit_id, 1, 12) = substr(r.from_commit, 1, 12)
  WHERE r.from_commit IS NULL OR f.seq IS NOT NULL),
rec AS (SELECT DISTINCT p.*, c.seq FROM pending_chunk p LEFT JOIN repo_commit c ON c.repo_id = p.repo_id AND c.commit_id = p.indexed_at_commit),
marked AS (SELECT r.*, EXISTS (SELECT 1 FROM span s WHERE s.repo_id = r.repo_id AND r.seq > s.from_seq AND r.seq <= s.to_seq AND r.queued_at < s.started_at) AS covered FROM rec r),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, kind, ref_id, chunk ORDER BY seq DESC, queued_at DESC, pending_id DESC) AS rn FROM marked WHERE covered) WHERE rn = 1),
found AS (SELECT m.* FROM marked m LEFT JOIN newest n ON n.repo_id = m.repo_id AND n.kind = m.kind AND n.ref_id = m.ref_id AND n.chunk = m.chunk
  WHERE NOT m.covered AND (n.content IS NULL OR n.content <> m.content))
"""
_ORPHANS = """
state AS (SELECT node_id, min(changed_at) AS first_at, arg_max(op, changed_at) <> 'delete' AS live FROM graph_node WHERE label = 'Symbol' GROUP BY node_id),
named AS (SELECT *, string_split(node_id, '::')[2] AS package, regexp_replace(string_split(node_id, '::')[-1], '#[0-9a-f]*$', '') AS name FROM state),
parent AS (SELECT 'source' AS side, node_id AS k, first_at, live FROM named
  UNION ALL SELECT 'target', package || '|' || name, first_at, live FROM named
  UNION ALL SELECT 'target', package || '|' || name, TIMESTAMP '0001-01-01 00:00:00', TRUE FROM library_symbol),
valid AS (SELECT side, k, min(first_at) AS first_at, min(first_at) FILTER (WHERE live) AS live_at FROM parent GROUP BY side, k),
ref AS (SELECT DISTINCT ref_id, 'source' AS side, src_symbol_id AS k, recorded_at FROM unresolved_ref WHERE src_symbol_id IS NOT NULL
  UNION ALL SELECT DISTINCT ref_id, 'target', replace(replace(replace(coalesce(qualifier, package), ' ', ''), '::', '.'), '/', '.') || '|' || name, recorded_at FROM unresolved_ref WHERE name IS NOT NULL),
judged AS (SELECT r.*, v.first_at, v.live_at, v.live_at IS NULL OR v.live_at > r.recorded_at AS orphan FROM ref r LEFT JOIN valid v ON v.side = r.side AND v.k = r.k)
"""

ORACLE = {
    "p5_found": "SELECT dst_id FROM graph_edge WHERE dst_id IS NOT NULL GROUP BY dst_id HAVING count(DISTINCT (label, src_id)) >= 50",
    "p5_edge_profile": """SELECT dst_id, count(*) AS n_rows, count(*) FILTER (WHERE label = 'CALLS') AS n_calls, count(*) FILTER (WHERE label = 'REFERENCES') AS n_references,
        count(*) FILTER (WHERE seen_at > linked_at + INTERVAL 7 DAY) AS n_late, min(linked_at) AS first_linked, max(seen_at) AS last_seen
        FROM graph_edge WHERE dst_id IS NOT NULL GROUP BY dst_id""",
    "p5_candidate_profile": "SELECT symbol_id, count(*) AS n_rows, max(degree) AS degree, count(DISTINCT task_id) AS n_tasks FROM candidate WHERE symbol_id IS NOT NULL GROUP BY symbol_id",
    "p6_found": f"WITH {_RUNS} SELECT DISTINCT pending_id FROM found",
    "p6_pending_by_repo": f"WITH {_RUNS} SELECT repo_id, kind, count(*) AS n_records, min(queued_at) AS oldest FROM found GROUP BY repo_id, kind",
    "p7_found": f"WITH {_ORPHANS} SELECT DISTINCT ref_id, side FROM judged WHERE orphan",
    "p7_orphan_report": f"""WITH {_ORPHANS} SELECT side, strftime(recorded_at, '%Y-%m') AS month, count(*) AS n_references,
        count(*) FILTER (WHERE orphan AND first_at IS NULL) AS n_missing, count(*) FILTER (WHERE orphan AND first_at IS NOT NULL AND live_at IS NULL) AS n_deleted,
        count(*) FILTER (WHERE orphan AND live_at IS NOT NULL) AS n_late, count(*) FILTER (WHERE orphan) AS n_orphans,
        CASE side WHEN 'source' THEN 'graph_node' ELSE 'graph_node+library_symbol' END AS table_name
        FROM judged GROUP BY side, strftime(recorded_at, '%Y-%m')""",
}
